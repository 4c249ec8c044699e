"""Conversation prefix trie from a Cartesian tree (operator 13).

1. A turn is named by 128 bits of the SHA-256 of its role and text, a
   conversation by its turns' names one after another. Equal conversations form
   a class (count, smallest id, words of each turn).
2. Classes are sorted by name into ranges (blocks), so a prefix stands before
   what continues it. L[i], the longest common prefix of class i and the one
   before it, comes from the sorted stream; at the edges of blocks from a table
   of their first and last names.
3. Internal nodes are intervals of classes that share L[i] turns: they reach from
   the nearest smaller L on the left to the nearest smaller on the right. A stack
   finds both inside a block. What has none there, at most one place for each
   value, goes by the minima of the blocks to the nearest block that has one, and
   is answered from that block's running minima.
4. Places of equal L that have the same smaller one on the left are one node, so
   nodes merge by (left end, depth). A leaf of the Cartesian tree is one class.
   A node stands for all depths from its parent's to its own: those are expanded.
5. Members, leaves and saved tokens of an interval are differences of prefix sums
   over classes, the smallest member a minimum over parts of blocks. Children are
   counted by parent.

The driver gets a few numbers a block (sizes, sums, minima). What goes in one row
is a conversation's names, 16 bytes a turn, never its texts; ids of a class are
hashed as a sorted stream of chunks.

Defined results: rows without conv_id belong to no conversation and are left
out; null role or text is empty; turns of one number (or of none) come in the
order of their names; repeated rows are turns of their own; a conversation whose
rebuilt form is empty ends at the root; an empty table has no node. Extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import looked_up, staged

NAME = 16
#: Bytes of names in a block of sorted classes.
BLOCK_BYTES = 4 << 20
#: Ids of a class that are joined to one chunk.
CHUNK = 8192
MOST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id and its turns in order: number, name, words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, NAME)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col("turn"), name.alias("name"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20) -> DataFrame:
    """conv_id, key (names in a row), words: the first crc32(conv_id) % 4 turns of conversation conv_id - conv_id % every, then its own after as many."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(convs.schema["turns"].dataType))
    seq = both.select("conv_id", F.concat(head, own).alias("seq"))
    return seq.select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda t: F.hex(t["name"])), "")).alias("key"), F.transform("seq", lambda t: t["words"]).alias("words"))


def _endings(members: DataFrame) -> DataFrame:
    """cls, ends: SHA-256 of the class's ids in ascending order. Ids are sorted over all partitions and joined to chunks; only a class's chunks come together, and stream."""

    @K.tidy_batches
    def chunks(batches):
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            cls = batch.column("cls").to_pylist()
            cut = [i for i in range(len(cls)) if i == 0 or cls[i] != cls[i - 1]]
            cut = sorted({*cut, *(j for i, z in zip(cut, [*cut[1:], len(cls)]) for j in range(i, z, CHUNK))})
            yield pa.RecordBatch.from_pydict({"cls": pa.array([cls[i] for i in cut], pa.binary()), "first": ids[cut], "ids": [",".join(map(str, ids[i:z].tolist())) for i, z in zip(cut, [*cut[1:], len(cls)])]})

    @K.tidy_batches
    def digest(batches):
        last, sha = None, None
        for batch in batches:
            done, ends = [], []
            for cls, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist()):
                if cls != last:
                    if sha:
                        done.append(last)
                        ends.append(sha.hexdigest())
                    last, sha = cls, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"cls": pa.array(done, pa.binary()), "ends": pa.array(ends, pa.string())})
        if sha:
            yield pa.RecordBatch.from_pydict({"cls": pa.array([last], pa.binary()), "ends": [sha.hexdigest()]})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = members.repartitionByRange(parts, "cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(chunks, "cls binary, first long, ids string")
    return joined.repartition(parts, "cls").sortWithinPartitions("cls", "first").select("cls", "ids").mapInArrow(digest, "cls binary, ends string")


def common(a: bytes, b: bytes) -> int:
    """Turns that two names begin with alike."""
    n = min(len(a), len(b)) // NAME
    if a[: n * NAME] == b[: n * NAME]:
        return n
    x, y = (np.frombuffer(z, f"V{NAME}", n) for z in (a, b))
    return int(np.argmax(x != y))


_SORTED = "block int, place long, lcp long, cls binary, edge binary, last binary, words array<long>, members long, low long"


@K.tidy_batches
def _stream(batches):
    """Classes of a block in their order: place and common prefix with the one before. One more row, at place -1, has their number and the first and the last name."""
    first, last, place, block = None, None, 0, None
    for batch in batches:
        keys, lcp = batch.column("key").to_pylist(), []
        for key in keys:
            lcp.append(-1 if last is None else common(last, key))
            first, last = key if first is None else first, key
        n = len(keys)
        if n:
            block = batch.column("block")[0].as_py()
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "place": np.arange(place, place + n), "lcp": np.array(lcp, np.int64), "cls": batch.column("cls"), "edge": pa.nulls(n, pa.binary()), "last": pa.nulls(n, pa.binary()), **{c: batch.column(c) for c in ("words", "members", "low")}})
        place += n
    if place:
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "place": [-1], "lcp": [place], "cls": pa.array([None], pa.binary()), "edge": [first], "last": [last], "words": pa.array([None], pa.list_(pa.int64())), "members": [0], "low": [0]})


@K.tidy_batches
def _edges(batches):
    """block, n, lcp with the last class of the block before (-1 for the first)."""
    before = None
    for batch in batches:
        lcp = []
        for edge, last in zip(batch.column("edge").to_pylist(), batch.column("last").to_pylist()):
            lcp.append(-1 if before is None else common(before, edge))
            before = last
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "n": batch.column("lcp"), "lcp": np.array(lcp, np.int64)})


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value to the left of each, -1 where there is none."""
    out, stack = np.empty(len(values), np.int64), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] >= v:
            stack.pop()
        out[i] = stack[-1][1] if stack else -1
        stack.append((v, i))
    return out


def smaller_after(values: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value to the right of each, their number where there is none."""
    return len(values) - 1 - smaller_before(values[::-1])[::-1]


class Minima:
    """Minima over ranges of a row of numbers, from those over powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def over(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Over each [a, z); the largest number where that is empty."""
        out = np.full(len(a), MOST)
        size = z - a
        for k, level in enumerate(self.levels):
            some = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            if len(some):
                out[some] = np.minimum(level[a[some]], level[z[some] - (1 << k)])
        return out

    def nearest_below(self, at: np.ndarray, value: np.ndarray, left: bool) -> np.ndarray:
        """The nearest place before (after) each ``at`` with a number below ``value``; -1 (their number) where there is none. Halves the stretch that certainly has none."""
        n = len(self.levels[0])
        edge = at.copy() if left else at + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            some = np.flatnonzero(edge - step >= 0 if left else edge + step <= n)
            start = edge[some] - step if left else edge[some]
            clear = some[level[start] >= value[some]]
            edge[clear] += -step if left else step
        return edge - 1 if left else edge


class _Block:
    """The classes of a block: common prefixes, words up to each depth, and sums before each place."""

    def __init__(self, table: pa.Table, border: int):
        t = table.filter(pc.greater_equal(table["place"], 0)).sort_by("place")
        self.lcp = t["lcp"].to_numpy().copy()
        self.lcp[0] = border
        self.n = len(self.lcp)
        self.members, self.low = t["members"].to_numpy(), t["low"].to_numpy()
        self.cls = t["cls"]
        words = t["words"].to_pylist()
        self.depth = np.array([len(w) for w in words], np.int64)
        self.words = [np.concatenate(([0], np.cumsum(np.array(w, np.int64)))).astype(np.int64) for w in words]
        all_ = np.array([w[-1] for w in self.words], np.int64)
        shared = np.array([w[max(0, d)] for w, d in zip(self.words, self.lcp.tolist())], np.int64)
        self.fresh = all_ - shared
        self.total = self.members * all_
        self.before, self.after = smaller_before(self.lcp), smaller_after(self.lcp)

    def leaves(self, following: int) -> np.ndarray:
        """Which classes does no other continue? ``following``: the next block's first common prefix."""
        return np.append(self.lcp[1:], following) < self.depth

    def sums(self, following: int) -> np.ndarray:
        """Rows: members, leaves, words times members, words of nodes, before each place and in all."""
        return np.stack([np.concatenate(([0], np.cumsum(x))) for x in (self.members, self.leaves(following), self.total, self.fresh)]).astype(np.int64)


SUMS = ("members", "leaves", "total", "fresh")
_SURVEY = "kind int, block int, value long, upper long, place long, low long, " + ", ".join(f"{c} long" for c in SUMS)


def _survey(b: _Block, block: int, following: int) -> pa.Table:
    """Of a block: its sums and minima (kind 0); running minima from its right end (1) and from its left (2), each with the values that it answers, up to ``upper``, the sums before it and the smallest member between it and that end; values that have no smaller one on the left (3) and on the right (4)."""
    sums = b.sums(following)
    rows = [(0, int(b.lcp.min()), 0, b.n, int(b.low.min()), *sums[:, -1].tolist())]
    for kind, order in ((1, range(b.n - 1, -1, -1)), (2, range(b.n))):
        upper, low = MOST, MOST
        for i in order:
            low = min(low, int(b.low[i])) if kind == 1 else low
            if b.lcp[i] < upper:
                rows.append((kind, int(b.lcp[i]), upper, i, low, *sums[:, i].tolist()))
                upper = int(b.lcp[i])
            low = low if kind == 1 else min(low, int(b.low[i]))
    for kind, none in ((3, b.before < 0), (4, b.after == b.n)):
        rows += [(kind, v, 0, 0, 0, 0, 0, 0, 0) for v in np.unique(b.lcp[none]).tolist()]
    kinds, *rest = zip(*rows)
    names = ["value", "upper", "place", "low", *SUMS]
    return pa.table({"kind": pa.array(kinds, pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), **{c: pa.array(v, pa.int64()) for c, v in zip(names, rest)}})


class _Whole:
    """What the driver knows of all blocks, by their order: first place, sums before, minima."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.block)
        self.number = {r.block: i for i, r in enumerate(rows)}
        self.start = np.concatenate(([0], np.cumsum([r.place for r in rows]))).astype(np.int64)
        self.before = {c: np.concatenate(([0], np.cumsum([r[c] for r in rows]))).astype(np.int64) for c in SUMS}
        self.value, self.low = Minima(np.array([r.value for r in rows])), Minima(np.array([r.low for r in rows]))
        self.count = len(rows)


class _Whole:
    """What the driver knows of all blocks, by their order: first place, sums before, minima."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.block)
        self.blocks = np.array([r.block for r in rows] + [-1], np.int32)
        self.number = {r.block: i for i, r in enumerate(rows)}
        self.start = np.concatenate(([0], np.cumsum([r.place for r in rows]))).astype(np.int64)
        self.before = np.stack([np.concatenate(([0], np.cumsum([r[c] for r in rows]))) for c in SUMS]).astype(np.int64)
        self.value, self.low = Minima(np.array([r.value for r in rows])), Minima(np.array([r.low for r in rows]))


_ANSWER = "block int, kind int, value long, place long, at long, low long, " + ", ".join(f"{c} long" for c in SUMS)


def _answers(survey: DataFrame, whole: _Whole) -> DataFrame:
    """For each open value of a block: the place of the nearest smaller one outside, its value, the sums before it, and the smallest member on the way there."""

    @K.tidy_batches
    def aim(batches):
        for batch in batches:
            value, left = batch.column("value").to_numpy(), batch.column("kind").to_numpy() == 3
            at = np.array([whole.number[x] for x in batch.column("block").to_pylist()], np.int64)
            target = np.where(left, whole.value.nearest_below(at, value, True), whole.value.nearest_below(at, value, False))
            between = whole.low.over(np.where(left, target + 1, at + 1), np.where(left, at, target))
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "kind": batch.column("kind"), "value": value, "target": whole.blocks[target], "start": whole.start[target], "between": between, **{f"o_{c}": x[target] for c, x in zip(SUMS, whole.before)}})

    asked = survey.where("kind >= 3 and value >= 0").select("block", "kind", "value").mapInArrow(aim, "block int, kind int, value long, target int, start long, between long, " + ", ".join(f"o_{c} long" for c in SUMS))
    q, c = asked.alias("q"), survey.where("kind in (1, 2)").alias("c")
    met = q.join(c, (F.col("q.target") == F.col("c.block")) & (F.col("q.kind") == F.col("c.kind") + 2) & (F.col("c.value") < F.col("q.value")) & (F.col("q.value") <= F.col("c.upper")))
    inside = met.select("q.block", "q.kind", "q.value", (F.col("c.place") + F.col("start")).alias("place"), F.col("c.value").alias("at"), F.least("between", "low").alias("low"), *((F.col(s) + F.col(f"o_{s}")).alias(s) for s in SUMS))
    beyond = asked.where("target < 0").select("block", "kind", "value", F.col("start").alias("place"), F.lit(-1).cast("long").alias("at"), F.col("between").alias("low"), *(F.col(f"o_{s}").alias(s) for s in SUMS))
    return inside.unionByName(beyond)


_TREE = "kind int, start long, lo long, hi long, up long, low long, shared long, words array<long>, cls binary, " + ", ".join(f"{c} long" for c in SUMS)


def _tree(b: _Block, offset: int, before: np.ndarray, following: int, answers: list[dict]) -> pa.Table:
    """Nodes of the Cartesian tree that this block has a place of, for all depths lo to hi (kind 0; ``up``: the common prefix at their left end), and the block's classes with the place of the nearest smaller common prefix in ``lo`` and their length in ``hi`` (kind 1)."""
    sums = b.sums(following) + before[:, None]
    given = {(a["kind"], a["value"]): a for a in answers}
    rows, lcp, seen, local, known = [], b.lcp.tolist(), set(), [], []

    def node(i, start, up, lo, hi, sums_):
        w = b.words[i]
        rows.append([0, start, lo, hi, up, 0, int(w[max(0, up)]), w[np.maximum(np.arange(lo, hi + 1) - 1, 0)].tolist(), None, *sums_.tolist()])

    for i, (v, x, z) in enumerate(zip(lcp, b.before.tolist(), b.after.tolist())):
        left, right = given.get((3, v)) if x < 0 else None, given.get((4, v)) if z == b.n else None
        start, up = (left["place"], left["at"]) if left else (offset + x, lcp[x]) if x >= 0 else (-1, -1)
        after = lcp[i + 1] if i + 1 < b.n else following
        if max(v, after) < b.depth[i] or b.depth[i] == 0 > max(v, after):
            node(i, offset + i, v, max(v, after) + 1, int(b.depth[i]), sums[:, i + 1] - sums[:, i])
            local.append((i, i + 1))
            known.append(MOST)
        if v >= 0 and (start, v) not in seen:  # places of equal prefixes in one interval are one node
            seen.add((start, v))
            down = right["at"] if right else lcp[z]
            ends = [np.array([a[c] for c in SUMS], np.int64) if a else sums[:, k] for a, k in ((left, x), (right, z))]
            node(i, start, up, max(up, down) + 1, v, ends[1] - ends[0])
            local.append((max(x, 0), z))
            known.append(min(left["low"] if left else MOST, right["low"] if right else MOST))
        rows.append([1, offset + i, start, int(b.depth[i]), v, 0, 0, None, b.cls[i].as_py(), 0, 0, 0, 0])
    least = iter(np.minimum(Minima(b.low).over(*np.array(local, np.int64).reshape(-1, 2).T), np.array(known, np.int64)).tolist())
    for row in rows:
        if row[0] == 0:
            row[5] = next(least)
    kind, start, lo, hi, up, low, shared, words, cls, *counts = zip(*rows)
    out = {"start": start, "lo": lo, "hi": hi, "up": up, "low": low, "shared": shared} | dict(zip(SUMS, counts))
    out = {c: pa.array(v, pa.int64()) for c, v in out.items()} | {"kind": pa.array(kind, pa.int32()), "words": pa.array(words, pa.list_(pa.int64())), "cls": pa.array(cls, pa.binary())}
    return pa.table({c.split()[0]: out[c.split()[0]] for c in _TREE.split(", ")})


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(turns: DataFrame, every: int = 20, id_col: str = "conv_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    convs = staged(conversations(turns, id_col), "conversations")
    seqs = staged(rebuilt(convs, every).withColumn("cls", F.substring(F.unhex(F.sha2("key", 256)), 1, NAME)), "rebuilt")
    blocks = math.ceil((seqs.agg(F.sum(F.octet_length("key") + NAME)).first()[0] or 0) / block_bytes)
    if not blocks:
        return spark.createDataFrame([], _RESULT)
    classes = seqs.groupBy("cls").agg(F.count("*").alias("members"), F.min("conv_id").alias("low"), F.first("key").alias("key"), F.first("words").alias("words"))
    sorted_ = classes.repartitionByRange(blocks, "key").sortWithinPartitions("key").withColumn("block", F.spark_partition_id())
    ordered = staged(sorted_.select("block", "cls", "key", "words", "members", "low").mapInArrow(_stream, _SORTED), "ordered")
    edges = ordered.where("place < 0").select("block", "lcp", "edge", "last").coalesce(1).sortWithinPartitions("block")  # a row a block
    edges = sorted(edges.mapInArrow(_edges, "block int, n long, lcp long").collect())
    border = {r.block: r.lcp for r in edges}
    following = dict(zip(border, [*list(border.values())[1:], -1]))
    rows = ordered.drop("edge", "last")

    @K.tidy
    def look(key, table):
        block = key[0].as_py()
        return _survey(_Block(table, border[block]), block, following[block])

    survey = staged(rows.groupBy("block").applyInArrow(look, _SURVEY), "survey")
    whole = _Whole(survey.where("kind = 0").collect())  # a row a block

    @K.tidy
    def make(key, table, answers):
        block = table["block"][0].as_py()
        at = whole.number[block]
        return _tree(_Block(table, border[block]), int(whole.start[at]), whole.before[:, at], following[block], answers.to_pylist())

    answers = staged(_answers(survey, whole), "answers")
    tree = staged(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(make, _TREE), "tree")

    # a node's parent stands at the same left end, or at the nearest smaller prefix before it
    c = F.col
    classes = tree.where("kind = 1").select("start", c("lo").alias("smaller"), c("hi").alias("length"), "cls").join(_endings(seqs.select("cls", "conv_id")), "cls")
    nodes = tree.where("kind = 0").drop("kind", "cls").dropDuplicates(["start", "hi"])  # at most one copy from each block
    nodes = nodes.join(classes.drop("cls"), "start")
    at = F.when(c("lo") > 0, F.concat_ws(":", F.when(c("lo") - 1 > c("up"), c("start")).otherwise(c("smaller")), c("lo") - 1))
    nodes = staged(nodes.withColumns({"own": F.concat_ws(":", "start", "hi"), "parent": at}), "nodes")
    children = nodes.where("parent is not null").groupBy(c("parent").alias("own")).agg(F.count("*").alias("children"))
    nodes = staged(nodes.join(children, "own", "left"), "nodes")
    under = looked_up(nodes.where("parent is not null"), nodes.select(c("own").alias("parent"), c("low").alias("above")), "parent")
    every_node = under.unionByName(nodes.where("parent is null").withColumn("above", F.lit(None).cast("long")))
    deep = every_node.select("*", F.explode(F.sequence("lo", "hi")).alias("depth"))
    last, w = c("depth") == c("hi"), F.element_at("words", (c("depth") - c("lo") + 1).cast("int"))
    return deep.select(
        c("low").alias("conv_id"),
        "depth",
        F.when(c("depth") == c("lo"), c("above")).otherwise(c("low")).alias("parent_conv_id"),
        c("members").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        c("leaves").alias("n_leaves"),
        (c("total") - c("members") * w - c("fresh") - c("shared") + w).alias("saved_tokens"),
        F.when(last & (c("hi") == c("length")), c("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )
