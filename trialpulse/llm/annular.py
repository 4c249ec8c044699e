"""Vector codes by product quantisation with annular norm pruning (operator 11).

Components become integers floor(scale * x); a vector is cut into ``parts``
equal parts, and each part position has a codebook of at most ``entries``
entries. A round assigns every part to its nearest entry and replaces entries by
the floors of their parts' means; sums are exact integers.

Nearest entries are found without looking at all: by the triangle inequality an
entry at distance r from x has a norm between |x| - r and |x| + r. Entries are
sorted by norm. A search begins at the entry whose norm is nearest, takes the
interval that the best distance so far allows by binary search, ends included,
and evaluates outwards; each better entry narrows the interval. Distances are
exact integers; an interval is widened by more than rounding can lose, so equal
distances are all met and go to the lower index.

The vectors stay a table of integers that every round reads once; partitions
send their sums by (part, entry, position), and a codebook of entries x
dimension numbers is all that passes through the driver.

Defined results: a null vector, or one with a null or non-finite component, takes
no part. Vectors shorter than the longest, or of a length that the parts don't
divide, count as filled up with zeros. A null vec_id is larger than any other,
and rows of one vec_id come in the order of their components; all of them are
rows of the result. With fewer vectors than ``entries`` there are as many entries
as vectors; of an empty table nothing is left. Components beyond 64 bits count as
the largest (or smallest) number of 64 bits, and so do errors. Extra columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import looked_up, staged

MOST = (1 << 63) - 1
SLACK = 1e-9


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """vec_id, label and the integer components of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.where(v.isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("c"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _fitting(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no squared distance can pass them, else as Python's."""
    most = max(abs(int(z)) for a in (x, book) if a.size for z in (a.min(), a.max())) if x.size and book.size else 0
    kind = np.int64 if (2 * most) ** 2 * max(1, x.shape[1]) < 1 << 62 else object
    return x.astype(kind), book.astype(kind)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1).astype(np.float64)) if x.shape[1] else np.zeros(len(x))


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(1) if x.shape[1] else np.zeros(len(x), np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of every row of ``x`` its nearest row of ``book`` (the lowest of equals) and the squared distance; and how many distances were computed."""
    x, book = _fitting(x, book)
    norm = _norms(book)
    order = np.argsort(norm, kind="stable")
    sorted_norm, entries, k = norm[order], book[order], len(book)
    own = _norms(x)
    at = np.minimum(np.searchsorted(sorted_norm, own), k - 1)
    before = np.maximum(at - 1, 0)
    at = np.where(np.abs(own - sorted_norm[before]) <= np.abs(sorted_norm[at] - own), before, at)
    best, index, computed = _square(x, entries[at]), order[at], len(x)

    def annulus(rows):
        r = np.sqrt(best[rows].astype(np.float64))
        r += SLACK * (r + own[rows] + sorted_norm[-1] + 1)
        return np.searchsorted(sorted_norm, own[rows] - r), np.searchsorted(sorted_norm, own[rows] + r, "right")

    rows = np.arange(len(x))
    low, high = annulus(rows)
    for step in range(1, k):
        rows = rows[(at[rows] - step >= low[rows]) | (at[rows] + step < high[rows])]
        if not len(rows):
            break
        for side in (-step, step):
            some = rows[(at[rows] + side >= low[rows]) & (at[rows] + side < high[rows])]
            place = at[some] + side
            d, entry = _square(x[some], entries[place]), order[place]
            better = ((d < best[some]) | ((d == best[some]) & (entry < index[some]))).astype(bool)
            hit = some[better]
            best[hit], index[hit] = d[better], entry[better]
            low[hit], high[hit] = annulus(hit)
            computed += len(some)
    return index, best, computed


def _sums(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """part, entry, pos, s, n: sums of the components and the count of what is assigned to each entry."""
    w, parts = width // len(books), len(books)

    @K.tidy_batches
    def add(batches):
        total = np.zeros((parts, len(books[0]), w), object)
        count = np.zeros((parts, len(books[0])), np.int64)
        for batch in K.regroup(batches):
            x = matrix(batch.column("c"), width)
            for p, book in enumerate(books):
                part = x[:, p * w : p * w + w]
                entry, _, _ = nearest(part, book)
                part, _ = _fitting(part, book)
                order = np.argsort(entry, kind="stable")
                heads = np.searchsorted(entry[order], np.arange(len(book)))
                got = np.flatnonzero(np.bincount(entry, minlength=len(book)))
                if w:
                    total[p, got] += np.add.reduceat(part[order], heads[got], axis=0).astype(object)
                count[p] += np.bincount(entry, minlength=len(book))
        p, e, i = (z.ravel() for z in np.indices(total.shape))
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "pos": pa.array(i, pa.int32()), "s": pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0)), "n": np.repeat(count.ravel(), w)})

    return kept.select("c").mapInArrow(add, "part int, entry int, pos int, s decimal(38,0), n long").groupBy("part", "entry", "pos").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"))


def codebooks(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], int]:
    """The final codebook of every part, as Python integers, and the vectors' length."""
    width = kept.agg(F.max(F.size("c"))).first()[0] or 0
    width = -(-width // parts) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "c").limit(entries).collect()  # entries x dimension numbers
    start = np.array([[*r.c, *[0] * (width - len(r.c))] for r in first], object).reshape(len(first), width)
    books = np.split(start, parts, axis=1)
    for _ in range(rounds if first and width else 0):
        for r in _sums(kept, books, width).where("n > 0").collect():  # as many
            books[r.part][r.entry, r.pos] = int(r.s) // r.n
    return books, width


def quantise(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits")
    kept = staged(integers(vectors, scale, id_col, vector_col, label_col), "integers")
    books, width = codebooks(kept, parts, entries, rounds)
    w = width // parts
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()

    @K.tidy_batches
    def encode(batches):
        for batch in K.regroup(batches):
            x = matrix(batch.column("c"), width)
            code = np.empty((len(x), parts), np.uint8)
            error = np.zeros(len(x), object)
            for p, book in enumerate(books):
                code[:, p], d, _ = nearest(x[:, p * w : p * w + w], book)
                error += d.astype(object)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([r.tobytes().hex() for r in code], pa.string()), "error": pa.array([min(int(e), MOST) for e in error], pa.int64())})

    coded = kept.mapInArrow(encode, "vec_id long, label string, code string, error long")
    coded = staged(coded.withColumn("_key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label"))), "codes")
    errors = coded.groupBy("_key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return looked_up(coded, errors, "_key").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
