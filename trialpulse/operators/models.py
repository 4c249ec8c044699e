"""k-means and Gaussian mixtures of many k and many restarts in one scan a round (CLU-2, CLU-3, CLU-6).

A round reads the points once for every model that still moves: partitions send
the sufficient statistics of each (sums and counts, or weighted moments), which
are added up by model. What reaches the driver is a few numbers a model and
cluster, whatever the number of points. As many jobs run as the slowest model
takes rounds, not one chain for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import staged

#: Rows of a partition of the points, and of the chunks that a task works on.
ROWS, CHUNK = 50_000, 4096
REGULARISED = 1e-6


@dataclass
class KMeans:
    k: int
    restart: int
    centres: np.ndarray
    cost: float = math.inf
    rounds: int = 0
    moves: bool = True


@dataclass
class Mixture:
    """A mixture of k full Gaussians. ``score`` is the mean log likelihood of its points."""

    k: int
    restart: int
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    score: float = -math.inf
    rounds: int = 0
    converged: bool = False
    n: int = 0
    whitening: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def ready(self) -> None:
        """Factors of the precisions, from the covariances."""
        self.whitening = np.linalg.inv(np.linalg.cholesky(self.covariances)).transpose(0, 2, 1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row and component."""
        d = x.shape[1]
        y = np.einsum("nkd,kde->nke", x[:, None, :] - self.means[None], self.whitening)
        scale = np.log(np.einsum("kdd->kd", self.whitening)).sum(1)
        with np.errstate(divide="ignore"):
            return np.log(self.weights) + scale - 0.5 * (d * math.log(2 * math.pi) + (y * y).sum(2))

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the components for every row, and each row's log likelihood."""
        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        return np.exp(joint - whole[:, None]), whole

    @property
    def parameters(self) -> int:
        d = self.means.shape[1]
        return self.k - 1 + self.k * d + self.k * d * (d + 1) // 2

    @property
    def bic(self) -> float:
        return -2 * self.score * self.n + self.parameters * math.log(self.n)

    @property
    def aic(self) -> float:
        return -2 * self.score * self.n + 2 * self.parameters


@dataclass
class Points:
    """The features as one array a row (``x``), with a hash of the row that draws hang on, written once."""

    table: DataFrame
    n: int
    parts: int

    @classmethod
    def of(cls, df: DataFrame, names: list[str]) -> Points:
        x = df.select(F.array(*(F.col(c).cast("double") for c in names)).alias("x"), F.xxhash64(*(F.col(c).cast("double") for c in names)).alias("h"))
        n = x.count()
        parts = max(1, math.ceil(n / ROWS))
        return cls(staged(x.repartition(parts), "points"), n, parts)

    def each(self, make: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]], models: int) -> dict[int, np.ndarray]:
        """Sums over all chunks of what make(x, h) gives for every model."""

        def local(batches):
            sums: dict[int, np.ndarray] = {}
            for x, h in _chunks(batches):
                for m, stats in make(x, h):
                    sums[m] = sums[m] + stats if m in sums else stats
            yield pa.RecordBatch.from_pydict({"model": pa.array(list(sums), pa.int32()), "stats": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

        def add(key, batches):
            whole = None
            for batch in batches:
                for s in batch.column("stats"):
                    one = s.values.to_numpy()
                    whole = one if whole is None else whole + one
            yield pa.RecordBatch.from_pydict({"model": [key[0].as_py()], "stats": [whole.tolist()]}, schema=pa.schema([("model", pa.int32()), ("stats", pa.list_(pa.float64()))]))

        add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        got = self.table.mapInArrow(local, "model int, stats array<double>")
        if self.parts > 1:
            got = got.groupBy("model").applyInArrow(add, "model int, stats array<double>")
        table = got.toArrow()  # a row a model
        return {m: np.array(s) for m, s in zip(table["model"].to_pylist(), table["stats"].to_pylist())}


def _chunks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        x, h = batch.column("x"), batch.column("h").to_numpy()
        if not batch.num_rows:
            continue
        x = x.flatten().to_numpy().reshape(batch.num_rows, -1)
        for a in range(0, len(x), CHUNK):
            yield x[a : a + CHUNK], h[a : a + CHUNK]


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for every row, from its hash and a salt: the same wherever and whenever it is drawn."""
    u = np.uint64
    z = h.view(u) ^ u(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> u(shift))) * u(by)
    return ((z ^ (z >> u(31))) >> u(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - centres[None]
    return (d * d).sum(2)


def starts(points: Points, largest: int, restarts: int, seed: int) -> np.ndarray:
    """(restart, place, feature): k-means++ sequences of centres; the first k start a model of k. One pass draws the next centre of all restarts: of exponential races with rates of the squared distances, the first to arrive."""
    centres = np.zeros((restarts, 0, 0))
    for place in range(largest):

        def race(batches, centres=centres, place=place):
            best: dict[int, tuple] = {}
            for x, h in _chunks(batches):
                for r in range(restarts):
                    rate = squares(x, centres[r]).min(1) if place else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        time = -np.log(_uniform(h, seed * 1_000_003 + r * 1009 + place)) / rate
                    first = time.min()
                    at = min(np.flatnonzero(time == first).tolist(), key=lambda i: tuple(x[i]))
                    best[r] = min(best.get(r, (math.inf, (math.inf,) * x.shape[1])), (float(first), tuple(x[at].tolist())))
            yield pa.RecordBatch.from_pydict({"r": pa.array(list(best), pa.int32()), "t": pa.array([b[0] for b in best.values()], pa.float64()), "x": pa.array([list(b[1]) for b in best.values()], pa.list_(pa.float64()))})

        rows = points.table.mapInArrow(race, "r int, t double, x array<double>")
        if points.parts > 1:
            rows = rows.groupBy("r").agg(F.min(F.struct("t", "x")).alias("b")).select("r", "b.x")
        got = {r.r: r.x for r in rows.select("r", "x").collect()}  # a row a restart
        new = np.array([got[r] for r in range(restarts)])[:, None, :]
        centres = new if not place else np.concatenate((centres, new), 1)
    return centres


def lloyd(points: Points, ks: list[int], restarts: int = 10, seed: int = 42, most: int = 300, still: float = 1e-12) -> list[KMeans]:
    """A converged model of every k and restart. A cluster that loses its last point keeps its centre."""
    first = starts(points, max(ks), restarts, seed)
    models = [KMeans(k, r, first[r, :k].copy()) for k in ks for r in range(restarts)]
    while moving := [i for i, m in enumerate(models) if m.moves and m.rounds < most]:

        def assign(x, _, moving=tuple(moving), centres=tuple(models[i].centres for i in moving)):
            for i, c in zip(moving, centres):
                d = squares(x, c)
                own = np.eye(len(c))[d.argmin(1)]
                yield i, np.concatenate(((own.T @ x).ravel(), own.sum(0), [d.min(1).sum()]))

        for i, s in points.each(assign, len(models)).items():
            m, d = models[i], models[i].centres.shape[1]
            sums, count = s[: m.k * d].reshape(m.k, d), s[m.k * d : -1]
            new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], m.centres)
            m.moves = bool(((new - m.centres) ** 2).sum() > still)
            m.centres, m.cost, m.rounds = new, float(s[-1]), m.rounds + 1
    return models


def best_of_each(models: list, better: Callable) -> dict:
    """The best restart of every k; the first of equals."""
    out: dict = {}
    for m in models:
        if m.k not in out or better(m, out[m.k]):
            out[m.k] = m
    return out


def _m_step(stats: np.ndarray, k: int, d: int, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances from moments about the old means."""
    count = stats[:k] + 10 * np.finfo(float).eps
    shift = stats[k : k + k * d].reshape(k, d) / count[:, None]
    second = stats[k + k * d : k + k * d + k * d * d].reshape(k, d, d) / count[:, None, None]
    covariances = second - shift[:, :, None] * shift[:, None, :] + REGULARISED * np.eye(d)
    return count / count.sum(), old + shift, covariances


def moments(x: np.ndarray, weight: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Weighted counts, first and second moments about a point for each component, in a row."""
    away = x[:, None, :] - about[None]
    return np.concatenate((weight.sum(0), np.einsum("nk,nkd->kd", weight, away).ravel(), np.einsum("nk,nkd,nke->kde", weight, away, away, optimize=True).ravel()))


def expectation_maximisation(points: Points, start: list[KMeans], most: int = 200, enough: float = 1e-3) -> list[Mixture]:
    """A mixture from every k-means model: moments of its clusters, then rounds until the mean log likelihood gains less than ``enough``."""
    d = start[0].centres.shape[1]

    def clusters(x, _):
        for i, m in enumerate(start):
            yield i, moments(x, np.eye(m.k)[squares(x, m.centres).argmin(1)], m.centres)

    models: list[Mixture] = []
    first = points.each(clusters, len(start))
    for i, m in enumerate(start):
        models.append(Mixture(m.k, m.restart, *_m_step(first[i], m.k, d, m.centres), n=points.n))
        models[-1].ready()
    while moving := [i for i, m in enumerate(models) if not m.converged and m.rounds < most]:

        def expect(x, _, some=tuple((i, models[i]) for i in moving)):
            for i, m in some:
                weight, whole = m.responsibilities(x)
                yield i, np.append(moments(x, weight, m.means), whole.sum())

        for i, s in points.each(expect, len(models)).items():
            m, score = models[i], float(s[-1]) / points.n
            m.converged, m.score, m.rounds = abs(score - m.score) < enough, score, m.rounds + 1
            m.weights, m.means, m.covariances = _m_step(s[:-1], m.k, d, m.means)
            m.ready()

    def likelihood(x, _):
        for i, m in enumerate(models):
            yield i, np.array([m.responsibilities(x)[1].sum()])

    for i, s in points.each(likelihood, len(models)).items():  # of the last parameters
        models[i].score = float(s[0]) / points.n
    return models


def labelled(df: DataFrame, names: list[str], models: list[KMeans] | list[Mixture]) -> DataFrame:
    """``df`` with ``labels`` (a label by each model) and ``shares`` (by the first: probabilities, of k-means from inverse distances)."""
    centres = None if isinstance(models[0], Mixture) else [m.centres for m in models]

    def label(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], 1)
            if centres is None:
                shares = [m.responsibilities(x)[0] for m in models]
                labels = np.stack([s.argmax(1) for s in shares], 1)
                share = shares[0]
            else:
                away = [squares(x, c) for c in centres]
                labels = np.stack([a.argmin(1) for a in away], 1)
                share = 1 / (np.sqrt(away[0]) + 1e-10)
                share /= share.sum(1, keepdims=True)
            table = batch.append_column("labels", pa.array(labels.tolist(), pa.list_(pa.int32())))
            yield table.append_column("shares", pa.array(share.tolist(), pa.list_(pa.float64())))

    schema = T.StructType([*df.schema, T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(label, schema)


def share_of(label: Column, shares: Column) -> Column:
    return F.element_at(shares, label + 1)
