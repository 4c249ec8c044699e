"""N-gram Jaccard join (operator 1).

A text's set is its distinct shingles of ``size`` words (A-Z folded). Texts
with equal sets form a class; classes are joined:

* rare-first order: shingles are ordered by how many texts of the corpus hold
  them, counted exactly through the exchange of blocks and shards, then by hash.
  A shingle that no other text holds can't meet anything and leaves the prefix.
* prefix filter: a pair at the threshold shares a shingle among the first
  |x| - ceil(t |x|) + 1 of each side.
* length and positional filters are applied to every meeting in a prefix, a
  suffix filter (counts per hash range bound the overlap) before the merge.
* one verification a pair.

A prefix shingle that k classes hold would give k^2 / 2 pairs. Components need
fewer: a first round pairs every holder with the one in which the shingle comes
earliest (for copies of one text, the least altered), a second round only pairs
holders that the first left in different components. No pair that could join
two components is skipped, so components are those of all links.

Links are decided on whole sets of 64-bit shingle hashes, whose words are hashed
modulo two primes; classes have names of 128 bits. Defined results: null or empty text has no shingle, is its own
component and links with nothing; a text shorter than a shingle has its whole
word sequence as its only one; a null doc_id takes part and is never a
component's name unless there is no other; repeated rows stay rows; extra
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import kernel as K
from .shared import looked_up, staged


def shingle_sets(texts: pa.Array, size: int):
    """By slices of a batch: (rows from, distinct shingle hashes sorted within each text, shingles before each text)."""
    data, offsets = K.flat(texts)
    for a, b in K.slices(offsets):
        words, first = K.word_hashes(K.fold(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
        grams = K.run_hash(words, size)
        at = np.flatnonzero(K.within(first, size, len(grams)))
        doc, value = K.owner(first)[at], grams[at]
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            doc = np.concatenate((doc, short))
            value = np.concatenate((value, K.span_hash(K.prefix_hash(words), first[short], first[short + 1])))
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))) if len(doc) else np.zeros(0, bool)
        doc, value = doc[new], value[new]
        yield a, value, np.searchsorted(doc, np.arange(b - a + 1))


def _fold_sums(values: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, K.U)
    np.cumsum(K.mix(values ^ K.U(salt)), out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _rarity(count: np.ndarray) -> np.ndarray:
    """A count of texts in a byte: itself up to 100, then four steps for each doubling."""
    return np.where(count <= 100, count, np.minimum(255, 100 + 4 * np.log2(np.maximum(count, 1) / 100))).astype(np.uint8)


class _Sets:
    """The shingle sets of a block: (doc, value) sorted, sizes, 128-bit names, and one document of each class."""

    def __init__(self, table: pa.Table, size: int):
        values, firsts, done = [], [np.zeros(1, np.int64)], 0
        for _, value, first in shingle_sets(table["text"], size):
            values.append(value)
            firsts.append(first[1:] + done)
            done += len(value)
        self.value = np.concatenate(values) if values else np.zeros(0, K.U)
        self.first = np.concatenate(firsts)
        self.n = np.diff(self.first)
        self.doc = K.owner(self.first)
        names = np.column_stack([K.mix(_fold_sums(self.value, self.first, salt)) for salt in (0xA5A5A5A5, 0x5A5A5A5A)])
        self.names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(np.ascontiguousarray(names).tobytes())]).cast(pa.binary())
        fresh = np.zeros(len(self.n), bool)
        fresh[np.unique(np.ascontiguousarray(names).view("V16").ravel(), return_index=True)[1]] = True
        self.fresh = fresh & (self.n > 0)
        self.kept = np.flatnonzero(self.fresh[self.doc])
        self.keys, self.back, self.count = np.unique(self.value[self.kept], return_inverse=True, return_counts=True)

    def prefixes(self, rarity: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, shingle, position) of the prefixes in rare-first order, without what only one text holds."""
        rare = rarity[self.back]
        order = np.lexsort((self.value[self.kept], rare, self.doc[self.kept]))
        doc, token, rare = self.doc[self.kept][order], self.value[self.kept][order], rare[order]
        pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
        length = self.n[doc]
        take = (pos < length - -(-share * length // 100) + 1) & (rare > 1)
        return doc[take], token[take], pos[take]


_SEEN = "doc_id long, cls binary, n int, items binary, token long, pos int"


def _survey(docs: DataFrame, size: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: every document (token null) with its class, its set's size and, where it meets others, its set; and the prefix of every class of a block."""
    shards = B.block_count(docs, text_col)
    blocks = B.in_blocks(docs, shards, id_col, text_col)

    @K.tidy
    def make(key, table):
        sets = _Sets(table, size)
        return B.send(key[0].as_py(), sets.keys, shards, sets.count)

    @K.tidy
    def reply(key, table):
        keys, source, (count,), _ = B.received(table, 1)
        order, head = B.groups(keys)
        rarity = np.empty(len(keys), np.uint8)
        rarity[order] = np.repeat(_rarity(np.add.reduceat(count[order], head)), np.diff(np.append(head, len(keys))))
        return B.answer(table, source, rarity, np.uint8)

    @K.tidy
    def finish(key, table, answers):
        sets = _Sets(table, size)
        doc, token, pos = sets.prefixes(B.replies(answers, np.uint8), share)
        meets = np.zeros(len(sets.n), bool)
        meets[doc] = True
        items = [K.pack_sorted(sets.value[sets.first[i] : sets.first[i + 1]]) if meets[i] else None for i in range(len(meets))]
        k, m = len(meets), len(doc)
        return pa.table(
            {
                "doc_id": pa.chunked_array([*table["doc_id"].chunks, pa.nulls(m, pa.int64())]),
                "cls": pa.chunked_array([pa.compute.if_else(pa.array(sets.n > 0), sets.names, pa.scalar(None, pa.binary())), sets.names.take(pa.array(doc))]),
                "n": np.concatenate((sets.n, sets.n[doc])).astype(np.int32),
                "items": pa.chunked_array([pa.array(items, pa.binary()), pa.nulls(m, pa.binary())]),
                "token": pa.chunked_array([pa.nulls(k, pa.int64()), pa.array(token.view(np.int64))]),
                "pos": np.concatenate((np.full(k, -1), pos)).astype(np.int32),
            }
        )

    answers = B.ask(blocks, make, reply)
    return staged(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, _SEEN), "sets")


def _may_link(n1, p1, n2, p2, share: int):
    """Length filter, and the positional filter: what is left after the shared shingle must reach the overlap that the threshold needs."""
    need = F.ceil(F.lit(share) * (n1 + n2) / F.lit(100 + share))
    return (100 * F.least(n1, n2) >= share * F.greatest(n1, n2)) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= need)


def _verify(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs whose sets are similar: suffix filter, then the merge."""

    @K.tidy_batches
    def check(batches):
        for batch in batches:
            a, b = [], []
            for x, y, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                s, t = K.unpack_sorted(left), K.unpack_sorted(right)
                need = -(-share * (len(s) + len(t)) // (100 + share))
                bits = max(0, min(len(s), len(t)).bit_length() - 1)
                if bits:
                    shift = K.U(64 - bits)
                    if np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=1 << bits), np.bincount((t >> shift).astype(np.int64), minlength=1 << bits)).sum() < need:
                        continue
                if 100 * (same := len(np.intersect1d(s, t, assume_unique=True))) >= share * (len(s) + len(t) - same):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of (a, b): the smallest vertex reachable. Labels take their neighbours' and their own label's label until nothing changes."""
    edges = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.v).select(edges.a.alias("v"), "root")
        jump = labels.alias("x").join(labels.alias("y"), F.col("x.root") == F.col("y.v")).select("x.v", F.col("y.root"))
        best = near.union(jump).groupBy("v").agg(F.min("root").alias("best"))
        both = staged(labels.join(best, "v").select("v", F.least("root", "best").alias("root"), (F.col("best") < F.col("root")).alias("moved")), "labels")
        labels = both.select("v", "root")
        if not both.where("moved").head(1):
            return labels


def similar(docs: DataFrame, share: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; links are 100 * intersection >= share * union."""
    seen = _survey(docs, size, share, id_col, text_col)
    rows = seen.where("token is null").select("doc_id", "cls", "n")
    spread = seen.where("token is not null").select("token", "cls", "n", "pos").repartition("token").distinct()
    first = F.struct("pos", "n", "cls")
    hubs = spread.groupBy("token").agg(F.count("*").alias("holders"), F.min(first).alias("hub")).where("holders > 1")
    met = staged(spread.join(hubs.select("token", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")), "token"), "met")
    # the sets of classes that meet another
    sets = staged(seen.where("items is not null").join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "items").dropDuplicates(["cls"]), "items")

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    c = F.col
    stars = met.where(c("cls") != c("hub")).where(_may_link(c("n"), c("pos"), c("hub_n"), c("hub_pos"), share)).select(*pair(c("cls"), c("hub"))).distinct()
    known = components(staged(_verify(stars, sets, share), "links"))

    # holders of a shingle that are still apart; equal (component, length, position) meet as one
    held = met.join(known, met.cls == known.v, "left").select("token", "cls", "n", "pos", F.coalesce("root", "cls").alias("root"))
    apart = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    held = staged(held.join(apart, "token"), "held")
    kinds = held.select("token", "root", "n", "pos").distinct()
    x, y = kinds.alias("x"), kinds.alias("y")
    meet = x.join(y, (c("x.token") == c("y.token")) & (c("x.root") < c("y.root")) & _may_link(c("x.n"), c("x.pos"), c("y.n"), c("y.pos"), share))
    meet = meet.select(c("x.token").alias("token"), *(c(f"{s}.{k}").alias(f"{k}_{s}") for s in "xy" for k in ("root", "n", "pos")))
    for s in "xy":
        side = held.select("token", *(c(k).alias(f"{k}_{s}") for k in ("root", "n", "pos")), c("cls").alias(f"cls_{s}"))
        meet = meet.join(side, ["token", *(f"{k}_{s}" for k in ("root", "n", "pos"))])
    pairs = meet.select(*pair(c("cls_x"), c("cls_y"))).distinct()
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    bridges = _verify(pairs, sets, share)
    links = bridges.unionByName(known.where("v <> root").select(c("v").alias("a"), c("root").alias("b")))
    final = components(links)

    # a class's smallest doc_id, a component's smallest, and back to classes and rows
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    classes = staged(classes.join(final, classes.cls == final.v, "left").select("cls", "low", F.coalesce("root", "cls").alias("root")), "classes")
    linked = looked_up(classes, classes.groupBy("root").agg(F.min("low").alias("name")), "root").select("cls", "name")
    named = looked_up(rows.where("cls is not null"), linked, "cls")
    out = named.select("doc_id", "n", "name").unionByName(rows.where("cls is null").select("doc_id", "n", F.lit(None).cast("long").alias("name")))
    return out.select("doc_id", c("n").cast("long").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))
