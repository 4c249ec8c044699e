"""Substring dedup by super-k-mer partitioning (operator 8).

A window is ``window`` consecutive words of one document. Its minimiser is the
smallest hash among its ``gram``-word runs (leftmost on a tie), a function of
the window's words alone. Consecutive windows with the same minimiser position
form a super-k-mer: one packed string of words. Each block of documents sends
every distinct super-k-mer once to the bucket that owns the minimiser, with the
smallest doc_id that has it; the bucket expands the windows, sorts them, compares the words of those
that stand together, and answers with the smallest doc_id over the corpus for
each window. Words that share a hash are compared as bytes first and named apart.

A minimiser that many different super-k-mers share (words around a common
passage) would make one bucket large. Their bytes are counted first; windows of
minimisers beyond a bound go by 128 bits of their own hash (two pairs of
polynomials over words that are named by two pairs), dealt over all shards.

Defined results: null text has no words; a text shorter than a window loses
nothing; a null doc_id counts as larger than any other and never makes another
document lose words; rows that repeat a doc_id are separate rows; extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import kernel as K

LAST = np.iinfo(np.int64).max
LOW = K.U(0xFFFFFFFF)
#: Bytes of distinct super-k-mers that one minimiser may send to its bucket.
HEAVY_BYTES = 8 << 20


class _Block:
    """The words, windows and super-k-mers of a block; ``texts``: and the words themselves, each followed by one space."""

    def __init__(self, table: pa.Table, window: int, gram: int, texts: bool = True):
        data, offsets = K.flat(table["text"])
        self.ids = table["doc_id"].fill_null(LAST).to_numpy()
        hashes, start, end, self.first = K.words_of(data, offsets)
        self.at = np.concatenate(([0], np.cumsum(end - start + 1)))
        self.norm = _joined(data, start, end, self.at) if texts else b""
        del start, end
        n = max(0, len(hashes) - window + 1)
        self.doc = K.owner(self.first)
        grams = K.run_hash(hashes, gram)
        value = (grams & ~LOW) | np.arange(len(grams), dtype=K.U)
        best = K.sliding_min(value, window - gram + 1)[:n] if n else value[:0]
        self.starts = np.flatnonzero(K.within(self.first, window, n)) if n else np.zeros(0, np.int64)
        best = best[self.starts]
        spot = (best & LOW).astype(np.int64)
        new = np.concatenate(([True], (spot[1:] != spot[:-1]) | (np.diff(self.starts) != 1))) if len(spot) else np.zeros(0, bool)
        self.run = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.begin = self.starts[head]
        self.length = np.diff(np.append(head, len(spot)))
        self.mini = K.mix(best[head] >> K.U(32))
        self.key = K.span_hash(K.prefix_hash(hashes), self.begin, self.begin + self.length + window - 1)
        self.window = window
        self.hashes = hashes


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> bytes:
    """All words, each followed by one space; ``at``: where each begins (one entry more)."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    out = np.full(at[-1], 0x20, np.uint8)
    gap = np.ones(at[-1], bool)
    gap[at[1:] - 1] = False
    out[gap] = data[inside]
    return out.tobytes()


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's values."""
    order, heads = B.groups(keys)
    return keys[order][heads], np.add.reduceat(values[order], heads) if len(heads) else values[:0]


def _heavy(docs: DataFrame, text: str, n: int, window: int, gram: int, bound: int) -> np.ndarray:
    """Minimisers whose super-k-mers pass half of ``bound``. A partition leaves out those too small in it for n of them to make up the other half, so none beyond ``bound`` is missed unless partitions are smaller than blocks. At most the super-k-mers' bytes / (bound / 2) values come to the driver."""

    @K.tidy_batches
    def count(batches):
        minis, sizes = np.zeros(0, K.U), np.zeros(0, np.int64)
        for batch in K.regroup(batches, B.BLOCK_BYTES):
            b = _Block(pa.Table.from_batches([batch]), window, gram, texts=False)
            one = np.unique(b.key, return_index=True)[1]
            size = b.at[b.begin[one] + b.length[one] + window - 1] - b.at[b.begin[one]]
            minis, sizes = _sums(np.concatenate((minis, b.mini[one])), np.concatenate((sizes, size)))
        some = sizes * (2 * n) >= bound
        yield pa.RecordBatch.from_pydict({"mini": minis[some].view(np.int64), "bytes": sizes[some]})

    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "mini long, bytes long")
    found = rows.groupBy("mini").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") * 2 >= bound).collect()
    return np.array([r.mini for r in found], np.int64).view(K.U)


def _distinct(b: _Block, shards: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct super-k-mers by (bucket, hash): a run of each, its bucket, its smallest doc_id, and the distinct one of each run, -1 for those of heavy minimisers."""
    light = np.flatnonzero(~np.isin(b.mini, heavy))
    bucket, key = (b.mini[light] % K.U(shards)).astype(np.int64), b.key[light]
    order = np.lexsort((key, bucket))
    k, s = key[order], bucket[order]
    head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))) if len(k) else np.zeros(0, np.int64)
    index = np.full(len(b.mini), -1, np.int64)
    own = light[order]
    index[own] = np.cumsum(np.isin(np.arange(len(order)), head, assume_unique=True)) - 1 if len(order) else 0
    ids = b.ids[b.doc[b.begin]]
    least = np.minimum.reduceat(ids[own], head) if len(head) else ids[:0]
    return own[head], s[head], least, index


def _apart(b: _Block, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of heavy minimisers: their places among the block's windows, their distinct hashes, a second hash and the smallest doc_id of each, and the distinct one of each window."""
    at = np.flatnonzero(index[b.run] < 0)
    from_ = b.starts[at]
    keys = K.span_hash(K.prefix_hash(b.hashes), from_, from_ + b.window) if len(at) else np.zeros(0, K.U)
    order, heads = B.groups(keys)
    ids = b.ids[b.doc[b.starts[at]]]
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
    one = b.starts[at][order][heads]
    second = np.zeros(0, np.int64)
    if len(at):
        words, _ = K.word_hashes(np.frombuffer(b.norm, np.uint8), np.array([0, len(b.norm)]), seed=1)
        second = K.span_hash(K.prefix_hash(words, 1), one, one + b.window, 1).view(np.int64)
    return at, keys[order][heads], second, np.minimum.reduceat(ids[order], heads) if len(heads) else ids[:0], which


def _messages(b: _Block, block: int, n: int, heavy: np.ndarray) -> pa.Table:
    """Super-k-mers to the shards 0 to n - 1, single windows of heavy minimisers by their hash to the n after them."""
    runs, bucket, least, index = _distinct(b, n, heavy)
    rows: dict[str, list] = {"shard": [], "block": [], "keys": [], "data": []}
    a, z = b.at[b.begin[runs]].tolist(), (b.at[b.begin[runs] + b.length[runs] + b.window - 1] - 1).tolist()
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        text = b"\n".join([b.norm[a[i] : z[i]] for i in range(cuts[s], cuts[s + 1])]) + b"\n"
        rows["shard"].append(int(s))
        rows["block"].append(block)
        rows["keys"].append(len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True))
        rows["data"].append(K.pack(least[cuts[s] : cuts[s + 1]]))
    _, keys, second, smallest, _ = _apart(b, index)
    return pa.concat_tables([pa.table(rows, schema=B._SCHEMA), B.send(block, keys, n, second, smallest, base=n)])


def _windows(table: pa.Table) -> pa.Table:
    keys, message, (second, own), _ = B.received(table, 2)
    order = np.lexsort((second, keys))
    k, t = keys[order], second[order]
    heads = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]))))
    return B.answer(table, message, _least(own, order, heads))


def _least(own: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The smallest value of each one's group."""
    out = np.empty(len(own), np.int64)
    if len(own):
        out[order] = np.repeat(np.minimum.reduceat(own[order], heads), np.diff(np.append(heads, len(own))))
    return out


def sort_windows(ids: np.ndarray, starts: np.ndarray, window: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads) of windows of word names grouped by what they hold: by hash first, then all words of neighbours are compared, by their names."""
    order, heads = B.groups(keys)
    inner = np.ones(len(order), bool)
    inner[heads] = False
    b = np.flatnonzero(inner)
    x, y = starts[order[b - 1]], starts[order[b]]
    same = np.ones(len(b), bool)
    for k in range(window):
        same &= ids[x + k] == ids[y + k]
    if not same.all():  # different windows of one hash: their groups are put together anew
        group = np.cumsum(~inner) - 1
        for g in np.unique(group[b[~same]]):
            members = np.flatnonzero(group == g)
            rows = sorted((ids[starts[i] : starts[i] + window].tolist(), i) for i in order[members].tolist())
            order[members] = [i for _, i in rows]
            inner[members] = [k > 0 and rows[k][0] == rows[k - 1][0] for k in range(len(rows))]
        heads = np.flatnonzero(~inner)
    return order, heads


def _bucket(table: pa.Table, window: int) -> pa.Table:
    texts = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in table["keys"].to_pylist()]
    docs = [K.unpack(x, np.int64) for x in table["data"].to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    end = np.flatnonzero((data == 0x20) | (data == 0x0A))  # one after each word
    first = np.concatenate(([0], np.flatnonzero(data[end] == 0x0A) + 1))
    hashes = K.local_names(data, np.concatenate(([0], end[:-1] + 1)), end)
    del end
    starts = np.flatnonzero(K.within(first, window))
    line = K.owner(first)[starts]
    own = np.concatenate(docs)[line]
    order, heads = sort_windows(hashes, starts, window, K.rolling(hashes, window)[starts])
    message = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[line]
    return B.answer(table, message, _least(own, order, heads))


def deduplicate(docs: DataFrame, window: int = 50, gram: int = 4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: Sequence[str] = (), bound: int = HEAVY_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text: the whole text where nothing is removed, else the kept words joined by one space. ``keep``: further columns of the input. ``bound``: bytes from which a minimiser's windows are dealt out."""
    n = B.block_count(docs, text_col)

    blocks = B.in_blocks(docs, n, id_col, text_col, keep)
    heavy = _heavy(docs, text_col, n, window, gram, bound)

    @K.tidy
    def make(key, table):
        return _messages(_Block(table, window, gram), key[0].as_py(), n, heavy)

    @K.tidy
    def reply(key, table):
        return _bucket(table, window) if key[0].as_py() < n else _windows(table)

    @K.tidy
    def finish(key, table, answers):
        b = _Block(table, window, gram)
        runs, _, _, index = _distinct(b, n, heavy)
        least = B.replies(answers)
        at = np.concatenate(([0], np.cumsum(b.length[runs])))
        head = np.concatenate(([0], np.cumsum(b.length)))[:-1]
        mine = np.empty(len(b.starts), np.int64)
        some = np.flatnonzero(index[b.run] >= 0)
        mine[some] = least[at[index[b.run[some]]] + some - head[b.run[some]]]
        apart, _, _, _, which = _apart(b, index)
        mine[apart] = least[at[-1] + which]
        hit = b.starts[b.ids[b.doc[b.starts]] > mine]
        gone = K.covered(hit, hit + window, len(b.doc))
        gone_by = np.concatenate(([0], np.cumsum(gone)))
        first, removed, kept, texts = b.first, gone_by[b.first[1:]] - gone_by[b.first[:-1]], [], []
        column = table["text"].to_pylist() if with_text else None
        sizes = np.diff(b.at)
        for i in range(len(first) - 1):
            x, y = first[i], first[i + 1]
            text = b.norm[b.at[x] : max(b.at[x], b.at[y] - 1)]
            if removed[i]:
                stay = np.repeat(~gone[x:y], sizes[x:y])
                text = np.frombuffer(b.norm, np.uint8)[b.at[x] : b.at[y]][stay].tobytes()[:-1]
            kept.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode() if removed[i] else column[i])
        out = {"doc_id": table["doc_id"], "n_words": np.diff(first), "n_removed": removed, "kept_sha256": kept}
        return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}) | {c: table[c] for c in keep})

    answers = B.ask(blocks, make, reply)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    schema = T.StructType([*schema, *(docs.schema[c] for c in keep)])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
