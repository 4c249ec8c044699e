"""Exact duplicate substrings by prefix-free parsing (operator 7).

A rolling hash over ``gram`` bytes marks a trigger wherever it is the smallest
of some ``span`` consecutive positions, so a trigger falls into every ``span``
bytes and phrases stay short. All windows of ``width`` bytes whose first
``span`` positions have the same trigger start in one phrase; with the bytes
that its last window reaches it forms a dictionary phrase. The parse is the
sequence of triggers.

A window is d bytes of its phrase before the trigger (a suffix of a dictionary
phrase) and the text from the trigger on (a suffix of the parse). Corpus order
compares the dictionary suffix first and the parse suffix next, so windows are
equal exactly where their dictionary suffixes of d bytes are equal and their
parse suffixes have a common prefix of width - d bytes.

1. Dictionary: blocks send the names (128 bits, by two pairs of bases) of their distinct phrases,
   sharded by the ``width - span + 1`` bytes from the trigger on, which every
   window of the phrase holds. A phrase that occurs twice has only repeated
   windows. One that occurs once can share windows only with phrases of the
   same trigger context.
2. Order: of phrases that share a trigger context, single ones and one copy of
   each repeated one go, as bytes, to the shard of the context. It makes the
   suffix array of the parse (triggers by the bytes from them on) with its
   longest common prefixes, and that of the dictionary (phrases by the bytes
   before the trigger, read backwards), and combines both for each d.
   Bytes are compared, not hashes.

A context that very many different phrases share (the middle of a passage that
a third of all documents hold) would make one shard large: beyond HEAVY phrases,
counted in step 1, its windows are dealt over all shards by 128 bits of their
own hash instead.

Defined results: null text is empty; a text shorter than ``width`` loses
nothing; matches never cross rows; a null or repeated doc_id is a row like any
other; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import kernel as K

LOW = K.U(0xFFFFFFFF)
REPEATED, FIRST, SHARED, CROWDED = 1, 2, 4, 8
#: Phrases of one trigger context that one shard puts in order.
HEAVY = 20_000


class _Parse:
    """Phrases of a block: window starts, the phrase of each, and the hashes of the trigger context and of the whole phrase."""

    def __init__(self, table: pa.Table, width: int, span: int, gram: int):
        self.data, self.offsets = K.flat(table["text"])
        n, self.width = len(self.data), width
        windows = max(0, n - width + 1)
        ok = K.within(self.offsets, width, windows) if windows else np.zeros(0, bool)
        self.starts = np.flatnonzero(ok)
        if len(self.starts):
            value = (K.rolling(self.data, gram) & ~LOW) | np.arange(n - gram + 1, dtype=K.U)
            spot = (K.sliding_min(value, span)[self.starts] & LOW).astype(np.int64)
        else:
            spot = self.starts
        new = np.concatenate(([True], (spot[1:] != spot[:-1]) | (np.diff(self.starts) != 1))) if len(spot) else np.zeros(0, bool)
        self.phrase = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.length = np.diff(np.append(head, len(spot)))
        self.begin = self.starts[head]
        self.trigger = spot[head]
        prefix = K.prefix_hash(self.data)
        self.context = K.span_hash(prefix, self.trigger, self.trigger + width - span + 1)
        self.whole = K.span_hash(prefix, self.begin, self.begin + self.length + width - 1)
        self.other = K.span_hash(K.prefix_hash(self.data, 1), self.begin, self.begin + self.length + width - 1, 1)

    def dictionary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One phrase of each distinct (context, whole) in that order, how often it occurs here, and the distinct one of each phrase."""
        order = np.lexsort((self.other, self.whole, self.context))
        c, w, o = self.context[order], self.whole[order], self.other[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]) | (o[1:] != o[:-1]))) if len(c) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return order[head], np.diff(np.append(head, len(order))), index

    def chosen(self, marks: np.ndarray, distinct: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases to be put in order, by context and names, and those of crowded contexts: single ones that share a context, and one copy of each repeated one. Every read of a block may bring its rows in another order, so nothing hangs on theirs."""
        own = marks[index]
        first = np.zeros(len(index), bool)
        first[distinct] = True
        ask = ((own & SHARED) > 0) & (((own & REPEATED) == 0) | (((own & FIRST) > 0) & first))
        crowded = (own & CROWDED) > 0
        calm = np.flatnonzero(ask & ~crowded)
        return calm[np.argsort(index[calm])], np.flatnonzero(ask & crowded)

    def windows(self, phrases: np.ndarray) -> np.ndarray:
        """Places among ``starts`` of all windows of these phrases, in their order."""
        head = np.cumsum(self.length) - self.length
        return _runs(head[phrases], self.length[phrases])

    def loose(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of crowded contexts: distinct hashes, a second hash and the count of each, and the distinct one of each window."""
        at = self.starts[self.windows(phrases)]
        one, two = (K.span_hash(K.prefix_hash(self.data, seed), at, at + self.width, seed) for seed in (0, 1))
        order = np.lexsort((two, one))
        new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))) if len(at) else np.zeros(0, bool)
        head, back = np.flatnonzero(new), np.empty(len(at), np.int64)
        back[order] = np.cumsum(new) - 1
        return one[order][head], two[order][head].view(np.int64), np.diff(np.append(head, len(at))), back

    def pack(self, block: int, phrases: np.ndarray, n: int) -> pa.Table:
        """Phrases (sorted by context) as bytes to the shards of their contexts: bytes before the trigger, windows, then the text."""
        shard = (self.context[phrases] >> K.U(32)) * K.U(n) >> K.U(32)
        cuts = np.searchsorted(shard, np.arange(n + 1, dtype=K.U))
        rows: dict[str, list] = {"shard": [], "block": [], "keys": [], "data": []}
        for s in np.flatnonzero(np.diff(cuts)):
            some = phrases[cuts[s] : cuts[s + 1]]
            rows["shard"].append(int(s))
            rows["block"].append(block)
            rows["keys"].append(K.pack(self.data[_runs(self.begin[some], self.length[some] + self.width - 1)]))
            rows["data"].append(K.pack(np.concatenate([self.trigger[some] - self.begin[some], self.length[some]])))
        return pa.table(rows, schema=B._SCHEMA)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 .. start + size - 1 for each pair, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _mark(table: pa.Table, heavy: int) -> pa.Table:
    context, source, (whole, other, count), block = B.received(table, 3)
    block = np.array(block, np.int64)[source] if len(source) else source
    order = np.lexsort((block, other, whole, context))
    c, w, o = context[order], whole[order], other[order]
    newc = np.concatenate(([True], c[1:] != c[:-1]))
    new = newc | np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])))
    head, headc = np.flatnonzero(new), np.flatnonzero(newc)
    total = np.add.reduceat(count[order], head)
    kinds = np.add.reduceat(new.astype(np.int64), headc)[np.cumsum(newc) - 1]
    out = REPEATED * (total >= 2)[np.cumsum(new) - 1] + FIRST * new + SHARED * (kinds >= 2) + CROWDED * (kinds > heavy)
    values = np.empty(len(out), np.int8)
    values[order] = out
    return B.answer(table, source, values, np.int8)


def _count(table: pa.Table) -> pa.Table:
    keys, source, (two, count), _ = B.received(table, 2)
    order = np.lexsort((two, keys))
    k, t = keys[order], two[order]
    head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]))))
    total = np.repeat(np.add.reduceat(count[order], head), np.diff(np.append(head, len(keys))))
    values = np.empty(len(keys), np.int8)
    values[order] = total >= 2
    return B.answer(table, source, values, np.int8)


def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in order, and the common prefix of each with the one before it (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        b = min(len(rows), a + (1 << 16))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def repeated(text: np.ndarray, before: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Which windows of these phrases (all in one array, in turn) occur twice among them? ``before``: bytes up to the trigger. Orders the parse and the dictionary and combines them."""
    size = windows + width - 1
    begin = np.cumsum(size) - size
    after = size - before
    first = np.cumsum(windows) - windows
    # parse: the text from each trigger on; dictionary: the text before it, backwards. What is shorter is filled with zeros, which no comparison below reaches
    parse = np.zeros((len(size), width), np.uint8)
    parse[np.repeat(np.arange(len(size)), after), _runs(np.zeros(len(size), np.int64), after)] = text[_runs(begin + before, after)]
    back = np.zeros((len(size), max(1, int(before.max(initial=0)))), np.uint8)
    back[np.repeat(np.arange(len(size)), before), np.repeat(before, before) - 1 - _runs(np.zeros(len(size), np.int64), before)] = text[_runs(begin, before)]
    right, prefix = suffix_array(parse)
    left, suffix = suffix_array(back)
    out = np.zeros(int(windows.sum()), bool)
    parse_class, word_class = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for d in range(int(before.max(initial=0)) + 1):
        some = np.flatnonzero((before >= d) & (before - windows < d))
        if len(some) < 2:
            continue
        parse_class[right] = np.cumsum(prefix < width - d)
        word_class[left] = np.cumsum(suffix < d) if d else 0
        key = word_class[some] * (len(size) + 1) + parse_class[some]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = some[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        out[first[twice] + before[twice] - d] = True
    return out


def _order(table: pa.Table, width: int) -> pa.Table:
    texts = [K.unpack(x, np.uint8) for x in table["keys"].to_pylist()]
    shape = [K.unpack(x, np.int64).reshape(2, -1) for x in table["data"].to_pylist()]
    before, windows = np.concatenate(shape, axis=1)
    hit = repeated(np.concatenate(texts), before, windows, width)
    return B.answer(table, np.repeat(np.arange(len(shape)), [int(s[1].sum()) for s in shape]), hit, np.int8)


def remove_repeats(docs: DataFrame, width: int = 200, span: int = 100, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (binary: the remaining bytes). ``heavy``: phrases from which a context's windows are dealt out."""
    if gram > width - span + 1:
        raise ValueError("a trigger's bytes must lie inside every window that it opens")
    n = B.block_count(docs, text_col)

    @K.tidy
    def make(key, table):
        p = _Parse(table, width, span, gram)
        distinct, count, _ = p.dictionary()
        return B.send(key[0].as_py(), p.context[distinct], n, p.whole[distinct].view(np.int64), p.other[distinct].view(np.int64), count)

    @K.tidy
    def reply(key, table):
        return _mark(table, heavy)

    @K.tidy
    def make_suffixes(key, table, answers):
        p = _Parse(table, width, span, gram)
        distinct, _, index = p.dictionary()
        calm, crowded = p.chosen(B.replies(answers, np.int8), distinct, index)
        block = key[0].as_py() if key[0].as_py() is not None else 0
        keys, two, count, _ = p.loose(crowded)
        return pa.concat_tables([p.pack(block, calm, n), B.send(block, keys, n, two, count, base=n)])

    @K.tidy
    def reply_suffixes(key, table):
        return _order(table, width) if key[0].as_py() < n else _count(table)

    @K.tidy
    def finish(key, table, answers):
        p = _Parse(table, width, span, gram)
        distinct, _, index = p.dictionary()
        shard = answers["shard"].to_numpy()
        marks = B.replies(answers.filter(pa.array(shard < n)), np.int8)
        calm, crowded = p.chosen(marks, distinct, index)
        met = B.replies(answers.filter(pa.array(shard >= n)), np.int8) > 0
        hit = ((marks[index] & REPEATED) > 0)[p.phrase] if len(p.phrase) else np.zeros(0, bool)
        ordered = p.windows(calm)
        hit[ordered] |= met[: len(ordered)]
        if len(crowded):
            hit[p.windows(crowded)] |= met[len(ordered) :][p.loose(crowded)[3]]
        at = p.starts[hit]
        gone = K.covered(at, at + width, len(p.data))
        by = np.concatenate(([0], np.cumsum(gone)))
        edge = gone & ~np.concatenate(([False], gone[:-1]))
        inside = p.offsets[(p.offsets > 0) & (p.offsets < len(gone))]
        edge[inside] = gone[inside]
        edges = np.concatenate(([0], np.cumsum(edge)))
        a, z = p.offsets[:-1], p.offsets[1:]
        kept = [p.data[x:y].tobytes() if not r else p.data[x:y][~gone[x:y]].tobytes() for x, y, r in zip(a, z, by[z] - by[a])]
        out = {"doc_id": table["doc_id"], "n_bytes": z - a, "n_removed": by[z] - by[a], "n_spans": edges[z] - edges[a], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    blocks = B.in_blocks(docs, n, id_col, text_col)
    marks = B.ask(blocks, make, reply)
    suffixes = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(make_suffixes, B.MESSAGE)
    met = suffixes.groupBy("shard").applyInArrow(reply_suffixes, B.MESSAGE)
    both = marks.unionByName(met.withColumn("shard", F.col("shard") + n))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)
