"""CLU-7: Euclidean silhouettes of one or many labellings, tile by tile.

Points fall into tiles, and tiles into bands. Every pair of bands meets once; a
task holds two bands and adds the distances up by point and cluster, tile by
tile, so no pair of points is a row. The sums of a tile are streamed together
over the bands that it met, and give the mean silhouette of each labelling.

A point is sent once to each band, so the number of bands is fixed while a band
fits BAND_BYTES: what is shuffled then grows as the points do. Beyond that
(1.3 million points of 64 dimensions and 10 clusters) bands stay bounded and their number grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import staged

#: Points of a tile at most, and rows of a tile that meet another at a time.
TILE, STRIP = 2048, 512
#: Bands at least, and bytes of a band's points, labels and sums at most.
BANDS, BAND_BYTES = 16, 48 << 20


def _sums(x: np.ndarray, y: np.ndarray, labels: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each point of x the distances to the points of y, added up by cluster of each labelling (side by side)."""
    columns = np.zeros((len(y), sum(sizes)))
    for i, at in enumerate(np.cumsum([0, *sizes[:-1]])):
        some = np.flatnonzero(labels[:, i] >= 0)
        columns[some, at + labels[some, i]] = 1
    out = np.empty((len(x), columns.shape[1]))
    norm = (y * y).sum(1)
    for a in range(0, len(x), STRIP):
        s = x[a : a + STRIP]
        out[a : a + STRIP] = np.sqrt(np.maximum((s * s).sum(1)[:, None] + norm[None] - 2 * s @ y.T, 0)) @ columns
    return out


def values(sums: np.ndarray, labels: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Silhouettes of points from their sums by cluster; 0 where a cluster has one point or there is no other."""
    own = np.flatnonzero(labels >= 0)
    s, mine = sums[own], labels[own]
    n = count[mine]
    inside = s[np.arange(len(own)), mine] / np.maximum(n - 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(count[None] > 0, s / count[None], np.inf)
    mean[np.arange(len(own)), mine] = np.inf
    outside = mean.min(1)
    top = np.maximum(inside, outside)
    fine = (n > 1) & np.isfinite(outside) & (top > 0)
    return np.where(fine, (outside - inside) / np.where(fine, top, 1), 0.0)


def silhouettes(points: DataFrame, key: str, labels: str, dims: list[str], tile: int = TILE) -> DataFrame:
    """labelling (its place in the array column ``labels``), points, silhouette. Labels below 0 are noise and left out of their labelling."""
    rows = points.select(F.xxhash64(key).alias("h"), F.array(*(F.col(c).cast("double") for c in dims)).alias("x"), F.col(labels).alias("labels"))
    each = rows.select(F.posexplode("labels").alias("i", "label")).where("label >= 0").groupBy("i", "label").count().collect()  # a row a cluster
    sizes = [max((r.label + 1 for r in each if r.i == i), default=0) for i in range(max((r.i + 1 for r in each), default=0))]
    if not sizes:
        return points.sparkSession.createDataFrame([], "labelling int, points long, silhouette double")
    count = [np.zeros(s) for s in sizes]
    for r in each:
        count[r.i][r.label] = r["count"]
    n, d, wide = rows.count(), len(dims), len(sizes)
    bands = max(BANDS, math.ceil(n * (8 * d + 4 * wide + 8 * sum(sizes)) / BAND_BYTES))
    tiles = bands * math.ceil(n / (tile * bands))  # as many in each band

    def pack(key_, table):
        x = table["x"].combine_chunks().flatten().to_numpy()
        got = table["labels"].combine_chunks().flatten().to_numpy()
        return pa.table({"tile": pa.array([key_[0].as_py()], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "labels": pa.array([got.astype(np.int32).tobytes()], pa.binary())})

    packed = staged(rows.withColumn("tile", F.pmod("h", F.lit(tiles)).cast("int")).groupBy("tile").applyInArrow(pack, "tile int, x binary, labels binary"), "tiles")
    other = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("other")
    pairs = packed.withColumn("band", F.pmod("tile", F.lit(bands))).select("*", other).withColumns({"a": F.least("band", "other"), "b": F.greatest("band", "other")})

    def meet(key_, table):
        got: dict[int, list] = {}
        for t, band, x, lab in zip(table["tile"].to_pylist(), table["band"].to_pylist(), table["x"], table["labels"]):
            got.setdefault(band, []).append((t, np.frombuffer(x.as_buffer()).reshape(-1, d), np.frombuffer(lab.as_buffer(), np.int32).reshape(-1, wide)))
        a, b = key_[0].as_py(), key_[1].as_py()
        out: dict[str, list] = {"tile": [], "sums": [], "labels": []}
        for one, two in {(a, b), (b, a)}:
            for t, x, lab in got.get(one, []):
                met_ = sum((_sums(x, y, ly, sizes) for _, y, ly in got.get(two, [])), np.zeros((len(x), sum(sizes))))
                out["tile"].append(t)
                out["sums"].append(met_.tobytes())
                out["labels"].append(lab.tobytes() if a == b else None)
        return pa.table(out, schema=pa.schema([("tile", pa.int32()), ("sums", pa.binary()), ("labels", pa.binary())]))

    met = pairs.select("a", "b", "tile", "band", "x", "labels").groupBy("a", "b").applyInArrow(meet, "tile int, sums binary, labels binary")

    def finish(key_, batches):
        whole, lab = None, None
        for batch in batches:
            for sums, raw in zip(batch.column("sums"), batch.column("labels")):
                one = np.frombuffer(sums.as_py()).reshape(-1, sum(sizes))
                whole = one if whole is None else whole + one
                lab = np.frombuffer(raw.as_py(), np.int32).reshape(-1, wide) if raw.is_valid else lab
        cuts = np.cumsum([0, *sizes])
        got = [values(whole[:, cuts[i] : cuts[i + 1]], lab[:, i], count[i]) for i in range(wide)]
        yield pa.RecordBatch.from_pydict({"labelling": pa.array(range(wide), pa.int32()), "n": pa.array([len(g) for g in got], pa.int64()), "total": pa.array([float(g.sum()) for g in got], pa.float64())})

    finish.__annotations__ = {"key_": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    summed = met.groupBy("tile").applyInArrow(finish, "labelling int, n long, total double")
    return summed.groupBy("labelling").agg(F.sum("n").alias("points"), F.try_divide(F.sum("total"), F.sum("n")).alias("silhouette"))
