"""Exact top-k inner products by multi-resolution segment statistics (operator 10).

Vectors become integers floor(scale * x). A vector cut into segments has a mean
and a deviation in each; for two vectors, the squared distance is at least the
sum over segments of m ((mean difference)^2 + (deviation difference)^2). As
inner product = (|q|^2 + |c|^2 - distance^2) / 2, that bounds the score from
above. Queries and candidates travel in blocks; a task takes a block of queries
and a block of candidates and goes from coarse segments to fine ones: a pair
whose bound falls under the query's k-th best score so far drops out, and only
survivors are computed exactly. Candidates lie in slots; every slot gets the
query blocks once, so what is shuffled is the candidates and slots x queries.
Candidate blocks are cut along the norm, large
norms first, so that the k-th best is high early; a block that no query can
gain from is skipped by its bound.

Defined results: a vector that is null, empty or holds null or non-finite
components, and a row with a null id, take no part; vectors of different length
than the query's have no score with it; equal scores go to the smaller vec_id;
repeated ids are separate candidates, and none of them is a candidate of its
own id; components and scores beyond 64 bits count as the largest (or smallest)
number of 64 bits; extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K

RESOLUTIONS = (4, 16)
#: Candidates of a slot.
SLOT_ROWS = 16_384
_EXACT = float(1 << 53)
SLACK = 1e-9


def _stats(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of sqrt(m) * (means, deviations) by segment: their inner product bounds that of the vectors."""
    out = []
    for seg in np.array_split(x, min(parts, x.shape[1]), axis=1):
        out += [seg.mean(1) * math.sqrt(seg.shape[1]), seg.std(1) * math.sqrt(seg.shape[1])]
    return np.stack(out, 1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All integer inner products of two sets of rows; float64 where every sum is exact, else Python integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < _EXACT:
        return q @ c.T
    exact = np.vectorize(int, otypes=[object])
    most = (1 << 63) - 1
    return np.minimum(np.maximum(exact(q) @ exact(c).T, -most), most)


def _trim(pool: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query, equal scores by id."""
    row, vec, got = (np.concatenate(z) for z in zip(*pool))
    order = np.lexsort((vec, -got, row))
    row, vec, got = row[order], vec[order], got[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], vec[keep], got[keep]


def _search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of these candidates for each query."""
    order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    cid, c = cid[order], c[order]
    qs, cs = [_stats(q, r) for r in RESOLUTIONS], [_stats(c, r) for r in RESOLUTIONS]
    qn, cn = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", c, c))
    by_id = np.argsort(qid, kind="stable")
    floor = np.full(len(q), -np.inf)
    pool: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def reach(bound: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Can a score under this bound still count? Rounding errors of the bound are allowed for."""
        return bound + SLACK * (1 + np.abs(bound)) >= floor[rows][:, None]

    for a in range(0, len(c), step):
        cols = np.arange(a, min(len(c), a + step))
        rows = np.flatnonzero(qn * cn[a] * (1 + SLACK) + SLACK >= floor)
        mask = np.ones((len(rows), len(cols)), bool)
        for level in range(len(RESOLUTIONS)):
            mask &= reach(qs[level][rows] @ cs[level][cols].T, rows)
            some_r, some_c = mask.any(1), mask.any(0)
            rows, cols, mask = rows[some_r], cols[some_c], mask[some_r][:, some_c]
        if not mask.size:
            continue
        score = _products(q[rows], c[cols])
        seen = np.where(mask, score, -np.inf).astype(np.float64)
        left, right = np.searchsorted(qid[by_id], cid[cols], "left"), np.searchsorted(qid[by_id], cid[cols], "right")
        place = np.full(len(q), -1)
        place[rows] = np.arange(len(rows))
        for j in np.flatnonzero(right > left):  # a query is no candidate of its own
            own = place[by_id[left[j] : right[j]]]
            seen[own[own >= 0], j] = -np.inf
        if len(cols) >= k:
            floor[rows] = np.maximum(floor[rows], np.partition(seen, len(cols) - k, axis=1)[:, len(cols) - k])
        x, y = np.nonzero((seen >= floor[rows][:, None]) & (seen > -np.inf))
        pool.append((rows[x], cid[cols[y]], score[x, y].astype(np.int64)))
        if sum(len(p[0]) for p in pool) > 4 * k * len(q):
            pool = [_trim(pool, k)]
            row, _, got = pool[0]
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            floor[row[last]] = np.maximum(floor[row[last]], got[last])
    return _trim(pool, k)


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(dim, ids, data): blocks of at most ``rows`` vectors of one dimension."""

    @K.tidy_batches
    def cut(batches):
        for batch in batches:
            ids, column = batch.column("id").to_numpy(), batch.column("v")
            dims = pc.list_value_length(column).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i in range(0, len(at), rows):
                    part = at[i : i + rows]
                    data = column.take(pa.array(part)).flatten().to_numpy().reshape(-1, d)
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), f"{name}_ids": pa.array([K.pack(ids[part])], pa.binary()), f"{name}_data": pa.array([K.pack(data.ravel())], pa.binary())})

    return vectors.mapInArrow(cut, f"dim int, {name}_ids binary, {name}_data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
        good = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return df.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    @K.tidy_batches
    def search(batches):
        for batch in batches:
            for qi, qd, ci, cd, dim in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_data", "c_ids", "c_data", "dim"))):
                qid, cid = K.unpack(qi, np.int64), K.unpack(ci, np.int64)
                row, vec, score = _search(qid, K.unpack(qd, np.float64).reshape(-1, dim), cid, K.unpack(cd, np.float64).reshape(-1, dim), k)
                yield pa.RecordBatch.from_pydict({"query_id": qid[row], "vec_id": vec, "score": score})

    slots = max(1, math.ceil(vectors.count() / SLOT_ROWS))
    slot = F.pmod(F.xxhash64("c_ids"), F.lit(slots)).cast("int").alias("slot")
    candidates = _blocks(clean(vectors), rows, "c").select("dim", slot, "c_ids", "c_data")
    asked = _blocks(clean(queries), rows, "q").select("dim", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "q_ids", "q_data")
    found = candidates.join(asked.hint("merge"), ["dim", "slot"]).mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
