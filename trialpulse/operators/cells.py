"""CLU-4: DBSCAN on a graph of grid cells.

Cells are cubes whose diagonal is eps, so points of one cell are neighbours of
each other: a cell with enough points has only core points, and the core points
of a cell are one cluster. What is linked is cells, not points:

1. Points are packed by cell into chunks of bounded size.
2. Cells are near when the gap between them is at most eps. Candidates meet by
   the cubes of side eps in the first three dimensions.
3. Points of sparse cells count their neighbours in near cells, chunk by chunk.
4. Two near cells with core points are linked if a core point of one is within
   eps of a core point of the other. First each cell's first chunk is tried,
   which links most; whole cells only meet where components are still apart.
5. Components of cells, named by their smallest core key; a border point takes
   the smallest name among its core neighbours.

No row is a pair of points. A dense cell is many chunks in many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans.tables import staged

#: Points of a chunk.
CHUNK = 1024


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """How many rows of y lie within eps of each row of x."""
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 128):
        d = x[a : a + 128, None, :] - y[None]
        out[a : a + 128] = ((d * d).sum(2) <= eps * eps).sum(1)
    return out


def _counted(pairs: DataFrame, d: int, eps: float, carried: list[str] = ()) -> DataFrame:
    """key, within and the ``carried`` columns: for the points of ``keys`` and ``x`` how many of ``y`` are neighbours, where there are any."""
    types = {f.name: f.dataType for f in pairs.schema}
    schema = "key " + types["keys"].elementType.simpleString() + ", within long" + "".join(f", {c} {types[c].simpleString()}" for c in carried)

    def count(batches):
        for batch in batches:
            rows, many = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                within = _within(*(z.values.to_numpy().reshape(-1, d) for z in (x, y)), eps)
                rows.append(np.flatnonzero(within))
                many.append(within[rows[-1]])
            keys = batch.column("keys")
            start = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *(r + start[i] for i, r in enumerate(rows))]))
            own = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([keys.flatten().take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *many])), *(batch.column(c).take(own) for c in carried)], ["key", "within", *carried])

    return pairs.select("keys", "x", "y", *carried).mapInArrow(count, schema)


def _packed(points: DataFrame) -> DataFrame:
    """keys and x (their coordinates in a row) of each chunk of each cell."""
    rows = points.groupBy("cell", "chunk").agg(F.collect_list(F.struct("key", "x")).alias("p"))
    return rows.select("cell", "chunk", F.transform("p", lambda p: p["key"]).alias("keys"), F.flatten(F.transform("p", lambda p: p["x"])).alias("x"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex that edges (v, u) lead to. Labels take their neighbours' and their own label's label until none moves."""
    both = staged(edges.select("v", "u").union(edges.select("u", "v")).distinct(), "edges")
    labels = staged(vertices.select("v", F.col("v").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "root"), "u").select("v", "root")
        jump = labels.alias("x").join(labels.alias("y"), F.col("x.root") == F.col("y.v")).select("x.v", F.col("y.root"))
        best = near.union(jump).groupBy("v").agg(F.min("root").alias("best"))
        new = staged(labels.join(best, "v").select("v", F.least("root", "best").alias("root"), (F.col("best") < F.col("root")).alias("moved")), "labels")
        labels = new.select("v", "root")
        if not new.where("moved").head(1):
            return labels


def _near_cells(cells: DataFrame, d: int) -> DataFrame:
    """cell, other: different cells whose gap is at most the diagonal of a cell."""
    reach = math.isqrt(d) + 1  # cells between the corners of two near ones, in one dimension
    cubes = [F.floor(F.col("cell")[i] / reach).alias(f"g{i}") for i in range(min(3, d))]
    a = b = cells.select("cell", *cubes)
    for i in range(len(cubes)):
        b = b.withColumn(f"g{i}", F.explode(F.array(*(F.col(f"g{i}") + step for step in (-1, 0, 1)))))
    met = a.join(b.withColumnRenamed("cell", "other"), [f"g{i}" for i in range(len(cubes))]).where(F.col("cell") != F.col("other"))
    gap = F.zip_with("cell", "other", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)))
    return met.where(F.aggregate(gap, F.lit(0).cast("long"), lambda t, g: t + g * g) <= d).select("cell", "other")


def dbscan(points: DataFrame, key: str, dims: list[str], eps: float, least: int, chunk: int = CHUNK) -> DataFrame:
    """(key, cluster_id), -1 for noise; clusters are numbered by their smallest core key. Keys are taken to be unique."""
    d = len(dims)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    x = F.array(*(F.col(c).cast("double") for c in dims))
    rows = points.select(F.col(key).alias("key"), x.alias("x")).withColumn("cell", F.transform("x", lambda v: F.floor(v / side)))
    rows = staged(rows, "points")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    rows = staged(rows.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / chunk))), "chunked")
    near = staged(_near_cells(rows.groupBy("cell").agg(F.first("n").alias("n")), d), "near")
    packed = staged(_packed(rows), "packed")

    # core points: all of dense cells, and those of sparse ones with enough neighbours
    c = F.col
    others = packed.select(c("cell").alias("other"), c("x").alias("y"))
    sparse = rows.where(c("n") < least)
    asked = _packed(sparse).join(near, "cell").join(others, "other")
    more = _counted(asked, d, eps).groupBy("key").agg(F.sum("within").alias("more"))
    core = rows.join(more, "key", "left").where(c("n") + F.coalesce("more", F.lit(0)) >= least).select("key", "x", "cell", "chunk")
    core = staged(core, "core")
    names = core.groupBy("cell").agg(F.min("key").alias("v"), F.min("chunk").alias("first"))
    chunks = staged(_packed(core).join(names, "cell"), "core_chunks")

    # links of cells: by their first chunks, then by all chunks where components are still apart
    def linked(pairs, left, right):
        to = right.select(c("cell").alias("other"), c("v").alias("u"), c("x").alias("y"))
        met = pairs.join(left.select("cell", "v", "keys", "x"), "cell").join(to, "other")
        return _counted(met, d, eps, ["v", "u"]).select("v", "u").distinct()

    once = near.where(c("cell") < c("other"))
    heads = chunks.where("chunk = first")
    known = staged(linked(once, heads, heads), "links")
    vertices = staged(names.select("cell", "v"), "vertices")
    roots = components(vertices, known)
    at = vertices.join(roots, "v").select("cell", "root")
    apart = once.join(at, "cell").join(at.select(c("cell").alias("other"), c("root").alias("far")), "other").where(c("root") != c("far")).select("cell", "other")
    roots = components(vertices, known.union(linked(apart, chunks, chunks)))

    named = staged(chunks.join(roots, "v").select("cell", "root", "keys", "x"), "named")
    inner = named.select(F.explode("keys").alias("key"), "root")
    lonely = _packed(sparse.join(core.select("key"), "key", "left_anti"))
    around = near.union(lonely.select("cell", c("cell").alias("other")).distinct())
    reach = lonely.join(around, "cell").join(named.select(c("cell").alias("other"), "root", c("x").alias("y")), "other")
    border = _counted(reach, d, eps, ["root"]).groupBy("key").agg(F.min("root").alias("root"))
    numbered = S.numbered(roots.select("root").distinct(), "root").select("root", c("number").cast("int").alias("cluster_id"))
    got = inner.unionByName(border).join(numbered, "root").select(c("key").alias(key), "cluster_id")
    return points.select(key).join(got, key, "left").select(key, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
