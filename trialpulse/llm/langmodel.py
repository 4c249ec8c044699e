"""Language-model scoring over an Elias-Fano n-gram trie (operator 2).

The model is a trigram model with Dirichlet smoothing: P(w | context) =
(c(context w) + mu P(w | shorter context)) / (c(context) + mu), down to the
unigram (c + 0.5) / (N + 0.5 (V + 1)).

1. Words: blocks of documents send every distinct word once, with its count in
   training rows, to the shard that owns the word's 64-bit name. The shard
   numbers its words, frequent ones first, and answers with numbers and corpus
   counts. N and V are sums over shards.
2. N-grams, named by the numbers of their words and by nothing shorter: blocks
   send their distinct bigrams with the words that follow them, to the shard of
   the bigram. Where a bigram's words are both frequent (HEAVY), its
   continuations are dealt over all shards, so no shard is hot.
3. A shard adds the counts up and packs what occurs in training rows as its part
   of the model: a trie of Elias-Fano levels with quantised probabilities c / N,
   in a memory map. Its answers are read from that trie by successor search.

build() writes the same parts as a table, and score_texts() reads other texts by
it. No model passes through the driver.

Defined results: null or empty text is the single token "end"; a null doc_id
hashes as the empty string, which is a training row; repeated rows are rows;
with no training rows, counts are 0; extra columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import kernel as K
from . import trie as T

START, END = K.U(0x5354415254), K.U(0x454E44)
#: A bigram whose two words are both at least this frequent has its continuations dealt over all shards.
HEAVY = 1_000_000


def remainder(ids: list, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``mod``."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids], np.int64)


class _Block:
    """Tokens of a block, padded by two starts and one end a text, and its distinct n-grams."""

    def __init__(self, table: pa.Table, mod: int, held: int):
        data, offsets = K.flat(table["text"])
        hashes, first = K.word_hashes(K.fold(data), offsets)
        rows = len(first) - 1
        self.held = remainder(table["doc_id"].to_pylist(), mod) == held
        self.first = first + 3 * np.arange(rows + 1)
        tokens = np.full(self.first[-1], START, K.U)
        inside = np.ones(len(tokens), bool)
        inside[self.first[:-1]] = inside[self.first[:-1] + 1] = inside[self.first[1:] - 1] = False
        tokens[inside] = hashes
        tokens[self.first[1:] - 1] = END
        train = np.repeat(~self.held, np.diff(self.first))
        self.words, ids = np.unique(tokens, return_inverse=True)
        n = len(self.words)
        head = np.zeros(len(tokens), bool)
        head[self.first[:-1]] = True
        self.pair_at = np.flatnonzero(~head)  # the second token of each bigram
        self.pairs, pair = np.unique(ids[self.pair_at - 1] * n + ids[self.pair_at], return_inverse=True)
        pair_of = np.zeros(len(tokens), np.int64)
        pair_of[self.pair_at] = pair
        second = np.zeros(len(tokens), bool)
        second[self.first[:-1] + 1] = True
        self.at = np.flatnonzero(~head & ~second)  # every scored token
        code = pair_of[self.at - 1] * n + ids[self.at]
        self.triples, self.triple = np.unique(code, return_inverse=True)
        spot = np.empty(len(self.triples), np.int64)
        spot[self.triple] = np.arange(len(code))
        self.context, self.last = pair_of[self.at - 1][spot], pair_of[self.at][spot]
        self.ids, self.n = ids, n
        # an n-gram counts in training rows; the first of two starts is no token
        self.counts = [np.bincount(ids[~head & train], minlength=n), np.bincount(pair[train[self.pair_at]], minlength=len(self.pairs)), np.bincount(self.triple[train[self.at]], minlength=len(self.triples))]


def _send_words(words: np.ndarray, counts: np.ndarray, block: int, shards: int) -> pa.Table:
    """A message to every shard, as every shard has a part of N and V to answer with."""
    sent = B.send(block, words, shards, counts)
    none = np.setdiff1d(np.arange(shards), sent["shard"].to_numpy())
    return pa.concat_tables([sent, pa.table({"shard": none, "block": np.full(len(none), block), "keys": [b""] * len(none), "data": [b""] * len(none)}, schema=B._SCHEMA)])


def _number(table: pa.Table, shard: int, shards: int) -> tuple[pa.Table, pa.Table]:
    """Answers (numbers, then counts; in ``keys`` the shard's part of N and V), and the shard's words for keeping."""
    keys, source, (count,), blocks = B.received(table, 1)
    order, head = B.groups(keys)
    sums = np.add.reduceat(count[order], head) if len(head) else count
    words = keys[order][head]
    token = words != START
    part = np.array([sums[token].sum(), (sums[token] > 0).sum()], np.int64)
    number = np.empty(len(words), np.int64)
    number[np.lexsort((words, -sums))] = np.arange(len(words)) * shards + shard
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
    cuts = np.searchsorted(source, np.arange(len(blocks) + 1))
    data = [K.pack(np.concatenate((number[w], sums[w]))) for w in (which[cuts[i] : cuts[i + 1]] for i in range(len(blocks)))]
    answers = pa.table({"shard": table["shard"], "block": table["block"], "keys": pa.array([K.pack(part)] * len(blocks), pa.binary()), "data": pa.array(data, pa.binary())}, schema=B._SCHEMA)
    seen = sums > 0
    kept = pa.table({"shard": [shard], "block": [0], "keys": [K.pack_sorted(words[seen])], "data": [K.pack(np.concatenate((number[seen], sums[seen])))]}, schema=B._SCHEMA)
    return answers, kept


class _Words:
    """What the word shards answered to a block: numbers and corpus counts in the order of its words, N and V."""

    def __init__(self, answers: pa.Table):
        order = np.argsort(np.array(answers["shard"].to_pylist(), np.int64), kind="stable")
        data, part = answers["data"].to_pylist(), answers["keys"].to_pylist()
        got = [K.unpack(data[i], np.int64).reshape(2, -1) for i in order]
        self.number, self.count = np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.int64)
        self.total, self.distinct = (int(x) for x in sum((K.unpack(x, np.int64) for x in part), np.zeros(2, np.int64)))


class _Grams:
    """How a block's bigrams and trigrams are dealt to shards, and in what order."""

    def __init__(self, b: _Block, words: _Words, shards: int):
        self.b, self.shards = b, shards
        self.first, self.second, last = b.pairs // b.n, b.pairs % b.n, b.triples % b.n
        n = words.number
        self.A, self.B, self.C = n[self.first], n[self.second], n[last]
        name = K.mix(self.A.view(K.U) * K.GRAM + self.B.view(K.U))
        shard2 = self._shard(name)
        frequent = np.minimum(words.count[self.first], words.count[self.second]) >= HEAVY
        apart = frequent[b.context]
        shard3 = np.where(apart, self._shard(K.mix(name[b.context] * K.GRAM + self.C.view(K.U))), shard2[b.context])
        # words that a stored model doesn't hold have no number, and what holds them isn't asked for
        known2 = (self.A >= 0) & (self.B >= 0)
        known3 = known2[b.context] & (self.C >= 0)
        self.pairs = _sorted(np.flatnonzero(known2), shard2, self.A, self.B)
        place = np.zeros(len(known2), np.int64)
        place[self.pairs] = np.arange(len(self.pairs))
        near = np.flatnonzero(known3 & ~apart)
        self.near = near[_order(place[b.context[near]], self.C[near])]
        self.apart = _sorted(np.flatnonzero(known3 & apart), shard3, name[b.context].view(np.int64), self.C)
        self.children = np.bincount(b.context[near], minlength=len(known2))
        at = np.arange(shards + 1)
        self.cuts = [np.searchsorted(x, at) for x in (shard2[self.pairs], shard3[self.near], shard3[self.apart])]

    def _shard(self, name: np.ndarray) -> np.ndarray:
        return ((name >> K.U(32)) * K.U(self.shards) >> K.U(32)).astype(np.int64)

    def send(self, block: int, total: int) -> pa.Table:
        c2, c3, ctx = self.b.counts[1], self.b.counts[2], self.b.context
        p, q, r = self.pairs, self.near, self.apart
        columns = (self.A[p], self.B[p], c2[p], self.children[p], self.C[q], c3[q], self.A[ctx[r]], self.B[ctx[r]], self.C[r], c3[r])
        where = (0, 0, 0, 0, 1, 1, 2, 2, 2, 2)
        rows: dict[str, list] = {"shard": [], "block": [], "keys": [], "data": []}
        for s in range(self.shards):
            parts = [c[self.cuts[w][s] : self.cuts[w][s + 1]] for c, w in zip(columns, where)]
            if len(parts[0]) or len(parts[6]):
                parts[0] = np.diff(parts[0], prepend=0)
                rows["shard"].append(s)
                rows["block"].append(block)
                rows["keys"].append(K.pack_columns([*parts, np.array([total])]))
                rows["data"].append(b"")
        return pa.table(rows, schema=B._SCHEMA)

    def counts(self, answers: pa.Table, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of bigrams and trigrams, as the trie gives them."""
        order = np.argsort(np.array(answers["shard"].to_pylist(), np.int64), kind="stable")
        shard, data = answers["shard"].to_pylist(), answers["data"].to_pylist()
        two, three = np.full(len(self.b.pairs), T.UNSEEN, "<u2"), np.full(len(self.b.triples), T.UNSEEN, "<u2")
        for i in order:
            got, s, at = K.unpack(data[i], "<u2"), shard[i], 0
            for into, names, cut in ((two, self.pairs, self.cuts[0]), (three, self.near, self.cuts[1]), (three, self.apart, self.cuts[2])):
                some = names[cut[s] : cut[s + 1]]
                into[some] = got[at : at + len(some)]
                at += len(some)
        return T.restore(two) * total, T.restore(three) * total


def _sorted(rows: np.ndarray, shard: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rows = rows[_order(a[rows], b[rows])]
    return rows[np.argsort(shard[rows].astype(np.uint16 if len(shard) and shard.max() < 1 << 16 else np.int64), kind="stable")]


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order of different pairs of numbers, by one sort where a pair fits a word."""
    if len(a) and 0 <= a.min() and a.max() < 1 << 31 and b.max() < 1 << 32:
        return np.argsort(a << 32 | b)
    return np.lexsort((b, a))


class _Shard:
    """The n-grams that a shard received."""

    def __init__(self, table: pa.Table):
        parts = [K.unpack_columns(x) for x in table["keys"].to_pylist()]
        self.total = int(parts[0][10][0])
        A = np.concatenate([np.cumsum(p[0]) for p in parts])
        B, c2, near, C, c3, hA, hB, hC, h3 = (np.concatenate([p[i] for p in parts]) for i in range(1, 10))
        self.sizes = [(len(p[0]), len(p[4]), len(p[6])) for p in parts]
        a, b = np.concatenate((A, hA)), np.concatenate((B, hB))
        c, n3 = np.concatenate((C, hC)), np.concatenate((c3, h3))
        # the distinct n-grams, in order, and which of them each one sent is
        self.words = int(max(a.max(), b.max(), c.max(initial=0))) + 1
        self.heads = np.unique(a)
        self.two, back = np.unique(np.searchsorted(self.heads, a) * self.words + b, return_inverse=True)
        self.pair = back[: len(A)]
        self.three, self.triple = np.unique(np.concatenate((np.repeat(self.pair, near), back[len(A) :])) * self.words + c, return_inverse=True)
        self.n2 = np.bincount(self.pair, c2, minlength=len(self.two))
        self.n3 = np.bincount(self.triple, n3, minlength=len(self.three))

    def trie(self) -> bytes:
        """What occurs in training rows, as an Elias-Fano trie of probabilities count / N."""
        some2, some3 = self.n2 > 0, self.n3 > 0
        below = self.three[some3] // self.words
        some2[below] = True  # contexts of continuations that were dealt apart
        place = np.cumsum(some2) - 1
        two = self.two[some2]
        with np.errstate(divide="ignore"):
            p2, p3 = np.log10(self.n2[some2] / max(1, self.total)), np.log10(self.n3[some3] / max(1, self.total))
        return T.Trie.pack(self.words, (self.heads[two // self.words], two % self.words, p2), (place[below], self.three[some3] % self.words, p3))

    def answer(self, table: pa.Table, trie: T.Trie) -> pa.Table:
        """Quantised values of every message's bigrams, continuations and continuations dealt apart; the trie is asked once for each distinct n-gram."""
        node = trie.context(self.heads[self.two // self.words], self.two % self.words)
        two = trie.bigrams(node)[self.pair]
        three = trie.trigrams(node[self.three // self.words], self.three % self.words)[self.triple]
        data, at = [], [0, 0, sum(n for _, n, _ in self.sizes)]
        for size in self.sizes:
            data.append(K.pack(np.concatenate([x[i : i + n] for x, i, n in zip((two, three, three), at, size)])))
            at = [i + n for i, n in zip(at, size)]
        return pa.table({"shard": table["shard"], "block": table["block"], "keys": pa.array([b""] * table.num_rows, pa.binary()), "data": pa.array(data, pa.binary())}, schema=B._SCHEMA)


def _scores(b: _Block, words: _Words, grams: _Grams, answers: pa.Table, mu2: float, mu3: float, ids) -> pa.Table:
    c1 = words.count
    c2, c3 = grams.counts(answers, words.total)
    mass = words.total + 0.5 * (words.distinct + 1)
    p1 = (c1 + 0.5) / mass
    base = np.log10(p1)
    p2 = (c2 + mu2 * p1[grams.second]) / (np.maximum(c1[grams.first], c2) + mu2)
    p3 = np.log10((c3 + mu3 * p2[b.last]) / (np.maximum(c2[b.context], c3) + mu3))
    cuts = b.first - 2 * np.arange(len(b.first))
    tokens = b.ids[b.at]

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, cuts[:-1]) if len(cuts) > 1 else values[:0]

    return pa.table(
        {
            "doc_id": ids,
            "held_out": b.held,
            "n_tokens": np.diff(cuts),
            "n_known": by_row((c1[tokens] > 0).astype(np.int64)),
            "train_tokens": np.full(len(cuts) - 1, words.total, np.int64),
            "base_score": by_row(base[tokens]),
            "score": by_row(p3[b.triple]),
        }
    )


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _ask_words(blocks: DataFrame, shards: int, mod: int, held: int) -> DataFrame:
    @K.tidy
    def make(key, table):
        return _send_words(*_word_counts(table, mod, held), key[0].as_py(), shards)

    return blocks.groupBy("block").applyInArrow(make, B.MESSAGE)


def _word_counts(table: pa.Table, mod: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a block, the two marks included, and their counts in training rows."""
    data, offsets = K.flat(table["text"])
    hashes, first = K.word_hashes(K.fold(data), offsets)
    train = remainder(table["doc_id"].to_pylist(), mod) != held
    marks, texts = np.array([START, END], K.U), int(train.sum())
    names, back = np.unique(np.concatenate((hashes, marks)), return_inverse=True)
    return names, np.bincount(back, np.concatenate((np.repeat(train, np.diff(first)), [texts, texts])), minlength=len(names)).astype(np.int64)


def _ask_grams(blocks: DataFrame, words: DataFrame, shards: int, mod: int, held: int) -> DataFrame:
    @K.tidy
    def make(key, table, answers):
        w = _Words(answers)
        return _Grams(_Block(table, mod, held), w, shards).send(key[0].as_py(), w.total)

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(make, B.MESSAGE)


def _finish(blocks: DataFrame, words: DataFrame, grams: DataFrame, shards: int, mod: int, held: int, mu2: float, mu3: float) -> DataFrame:
    @K.tidy
    def score(key, table, answers):
        shard = answers["shard"].to_numpy()
        far = answers.filter(pa.array(shard >= shards)).set_column(0, "shard", pa.array(shard[shard >= shards] - shards))
        w, b = _Words(answers.filter(pa.array(shard < shards))), _Block(table, mod, held)
        return _scores(b, w, _Grams(b, w, shards), far, mu2, mu3, table["doc_id"])

    both = words.unionByName(grams.withColumn("shard", F.col("shard") + shards))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, SCORES)


def score_documents(docs: DataFrame, mod: int = 5, held: int = 1, mu2: float = 500.0, mu3: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows whose remainder isn't ``held``."""
    shards = B.block_count(docs, text_col)
    blocks = B.in_blocks(docs, shards, id_col, text_col)

    @K.tidy
    def number(key, table):
        return _number(table, key[0].as_py(), shards)[0]

    @K.tidy
    def reply(key, table):
        got = _Shard(table)
        return got.answer(table, T.mapped(got.trie()))

    words = _ask_words(blocks, shards, mod, held).groupBy("shard").applyInArrow(number, B.MESSAGE)
    grams = _ask_grams(blocks, words, shards, mod, held).groupBy("shard").applyInArrow(reply, B.MESSAGE)
    return _finish(blocks, words, grams, shards, mod, held, mu2, mu3)


def build(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the model of all rows of ``docs`` under ``to``: words/ and grams/, a row a shard, whose ``data`` of grams is the trie's levels as they are mapped."""
    shards = B.block_count(docs, text_col)
    blocks = B.in_blocks(docs, shards, id_col, text_col)

    @K.tidy
    def keep(key, table):
        return _number(table, key[0].as_py(), shards)[1]

    @K.tidy
    def number(key, table):
        return _number(table, key[0].as_py(), shards)[0]

    @K.tidy
    def pack(key, table):
        got = _Shard(table)
        return pa.table({"shard": [key[0].as_py()], "block": [got.total], "keys": [b""], "data": [got.trie()]}, schema=B._SCHEMA)

    asked = _ask_words(blocks, shards, 1, 1)
    asked.groupBy("shard").applyInArrow(keep, B.MESSAGE).withColumn("block", F.lit(shards).cast("long")).write.parquet(f"{to}/words")
    _ask_grams(blocks, asked.groupBy("shard").applyInArrow(number, B.MESSAGE), shards, 1, 1).groupBy("shard").applyInArrow(pack, B.MESSAGE).write.parquet(f"{to}/grams")


def score_texts(docs: DataFrame, model: str, mu2: float = 500.0, mu3: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of score_documents for any texts, by a model that build() wrote: its shards answer from their tries. held_out is true: nothing is learnt here."""
    spark, schema = docs.sparkSession, B.MESSAGE
    stored, tries = (spark.read.schema(schema).parquet(f"{model}/{x}") for x in ("words", "grams"))
    shards = int(stored.agg(F.max("block")).first()[0] or 1)
    blocks = B.in_blocks(docs, B.block_count(docs, text_col), id_col, text_col)

    @K.tidy
    def look_up(key, table, kept):
        keys, source, _, blocks_ = B.received(table, 1)
        have = K.unpack_sorted(kept["keys"][0].as_py()) if kept.num_rows else np.zeros(0, K.U)
        value = K.unpack(kept["data"][0].as_py(), np.int64).reshape(2, -1) if kept.num_rows else np.zeros((2, 0), np.int64)
        at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
        known = have[at] == keys if len(have) else np.zeros(len(keys), bool)
        number, count = (np.where(known, v[at], d) if len(have) else np.full(len(keys), d) for v, d in zip(value, (-1, 0)))
        token = have != START
        part = K.pack(np.array([value[1][token].sum(), token.sum()], np.int64))
        cuts = np.searchsorted(source, np.arange(len(blocks_) + 1))
        data = [K.pack(np.concatenate((number[a:b], count[a:b]))) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"shard": table["shard"], "block": table["block"], "keys": pa.array([part] * len(blocks_), pa.binary()), "data": pa.array(data, pa.binary())}, schema=B._SCHEMA)

    @K.tidy
    def reply(key, table, kept):
        if not table.num_rows:
            return table
        got = _Shard(table)
        return got.answer(table, T.mapped(kept["data"][0].as_py() if kept.num_rows else T.Trie.pack(1, (np.zeros(0, np.int64),) * 3, (np.zeros(0, np.int64),) * 3)))

    words = _ask_words(blocks, shards, 1, 0).groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(look_up, schema)
    grams = _ask_grams(blocks, words, shards, 1, 0).groupBy("shard").cogroup(tries.groupBy("shard")).applyInArrow(reply, schema)
    return _finish(blocks, words, grams, shards, 1, 0, mu2, mu3)
