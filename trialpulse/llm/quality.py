"""Quality classifier by positive-unlabelled learning (operator 9).

Trusted positives are training rows labelled 1; unlabelled web text are training
rows without a label. Labels of the other kind are never used. A first linear
model of positives against unlabelled rows gives the class prior: the smallest
ratio, over low score thresholds, of the unlabelled share above it to the positive
share above it. The classifier then minimises the non-negative unbiased risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the logistic loss, so its score is a
probability. It is fitted on the driver on at most ``sample`` rows of either
kind, those with the smallest hashes of their ids; every row is scored.

Inputs are lexical, of the whole text: how often each byte trigram, word and word
bigram (A-Z folded) occurs, by hash in a fixed number of columns and as square
roots of shares, and a few shares of the text's form (repeated words, length of
words, letters, digits, capitals). Inputs, decay and threshold of the fit were
chosen on rows that are not held out.

Defined results: null text is empty; an empty text gets the score of its (zero)
counts; a null doc_id is never a training row; of repeated labels for an id the
largest counts; repeated rows are rows; extra columns are not looked at; with no
positives or no unlabelled rows every score is the prior 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .langmodel import remainder
from .shared import frugal

#: Rows of either kind that the fit reads at most.
SAMPLE = 10_000
#: Columns (powers of two) for byte trigrams, words and word bigrams.
GRAMS, WORDS, PAIRS = 64, 32, 16
#: Counts added to a text's total, so that a few words don't look like an extreme share.
PRIOR_COUNT = 8
_FORM = 7
WIDTH = GRAMS + WORDS + PAIRS + _FORM
_ROWS = 512  # rows of inputs at a time
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of inputs a text."""
    parts = list(feature_rows(texts))
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def feature_rows(texts: pa.Array):
    """The rows of inputs, some texts at a time."""
    data, offsets = K.flat(texts)
    for x, y in K.slices(offsets):
        for a in range(x, y, _ROWS):
            b = min(y, a + _ROWS)
            yield _inputs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _shares(doc: np.ndarray, column: np.ndarray, rows: int, width: int) -> np.ndarray:
    counts = np.bincount(doc * width + column, minlength=rows * width).reshape(rows, width).astype(np.float32)
    return np.sqrt(counts / (counts.sum(1, keepdims=True) + PRIOR_COUNT))


def _top(hashes: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The highest bits as a column."""
    return (hashes >> hashes.dtype.type(bits - width.bit_length() + 1)).astype(np.int64)


def _inputs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = len(at) - 1
    n = max(0, len(data) - 2)
    wide = data.astype(np.uint32)
    gram = ((wide[:n] << np.uint32(16)) | (wide[1 : n + 1] << np.uint32(8)) | wide[2 : n + 2]) * np.uint32(0x9E3779B1)
    here = K.within(at, 3, n) if n else np.zeros(0, bool)
    out = [_shares(K.owner(at)[:n][here], _top(gram[here], 32, GRAMS), rows, GRAMS)]
    words, first = K.word_hashes(K.fold(data), at)
    doc = K.owner(first)
    out.append(_shares(doc, _top(words, 64, WORDS), rows, WORDS))
    pairs = K.run_hash(words, 2)
    inside = K.within(first, 2, len(pairs)) if len(pairs) else np.zeros(0, bool)
    out.append(_shares(doc[: len(pairs)][inside], _top(pairs[inside], 64, PAIRS), rows, PAIRS))
    count, size = np.diff(first), np.diff(at)
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    head = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])))) if len(w) else np.zeros(0, np.int64)
    distinct = np.bincount(d[head], minlength=rows)
    more = count + 8.0
    sums = [np.add.reduceat(np.append(t[data], 0).astype(np.int64), at[:-1]) * (size > 0) for t in (_LETTER, _CAPITAL, _DIGIT)]
    some = size + PRIOR_COUNT
    form = [(distinct + 8) / more, distinct / np.sqrt(more) / 10, size / np.maximum(1, count) / 20, np.log1p(count) / 10, sums[0] / some, sums[1] / some, sums[2] / some]
    out.append(np.column_stack(form).astype(np.float32))
    return np.concatenate(out, axis=1)


#: Weight decay of the fit.
DECAY = 0.01
#: Added to an input's deviation: rare columns stay small.
FLOOR = 0.05


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic risk of positives, and the estimate of the negatives' risk, which may fall under 0."""
    p, u = (np.logaddexp(0, x.astype(np.float64) @ w) for x in (x_p, x_u))
    return float(prior * np.mean(np.logaddexp(0, -(x_p.astype(np.float64) @ w)))), float(np.mean(u) - prior * np.mean(p))


def gradient(w: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float | None) -> np.ndarray:
    """Where to go from w. prior None: positives against unlabelled rows. Else that of the non-negative risk: where the negatives' risk falls under 0 it is driven back up."""
    p, u = _sigmoid(x_p @ w), _sigmoid(x_u @ w)
    positive, unlabelled, negative = -((1 - p) @ x_p) / len(p), (u @ x_u) / len(u), (p @ x_p) / len(p)
    if prior is None:
        return positive + unlabelled
    rest = np.mean(-np.log1p(-np.minimum(u, 1 - 1e-6))) - prior * np.mean(-np.log1p(-np.minimum(p, 1 - 1e-6)))
    return prior * positive + unlabelled - prior * negative if rest >= 0 else prior * negative - unlabelled


def _descend(x_p: np.ndarray, x_u: np.ndarray, prior: float | None, steps: int, rate: float = 0.01, decay: float = DECAY) -> np.ndarray:
    """Weights by Adam on all rows."""
    w = np.zeros(x_p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = (gradient(w, x_p, x_u, prior) + decay * w).astype(np.float32)
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.999) * v + np.float32(0.001) * g * g
        w = w - np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w


def _ratio(s_p: np.ndarray, s_u: np.ndarray) -> float:
    cuts = np.unique(np.quantile(s_p, np.linspace(0, 0.1, 41)))
    p = 1 - np.searchsorted(np.sort(s_p), cuts) / len(s_p)
    u = 1 - np.searchsorted(np.sort(s_u), cuts) / len(s_u)
    return float(np.min(u / p))


def estimate_prior(x_p: np.ndarray, x_u: np.ndarray, steps: int) -> float:
    """Share of positives among unlabelled rows: two halves, each measured by a model of the other that tells the samples apart."""
    got = []
    for half in (0, 1):
        probe = _descend(x_p[half::2], x_u[half::2], None, steps)
        p, u = x_p[1 - half :: 2], x_u[1 - half :: 2]
        if len(p) and len(u):
            got.append(_ratio(p @ probe, u @ probe))
    return float(np.clip(np.mean(got), 0.01, 0.99)) if got else 0.5


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior
        self.blank = not weights.any()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_standard(x, self.mean, self.scale) @ self.weights)

    def score(self, texts: pa.Array) -> np.ndarray:
        got = [self(x) for x in feature_rows(texts)]
        return np.concatenate(got).astype(np.float64) if got else np.zeros(0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> Model:
    width = positive.shape[1] if positive.size else unlabelled.shape[1] if unlabelled.size else 1
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width + 1, np.float32), 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + np.float32(FLOOR)
    x_p, x_u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    prior = estimate_prior(x_p, x_u, steps // 2)
    return Model(mean, scale, _descend(x_p, x_u, prior, steps), prior)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised inputs and a constant."""
    return np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x), np.float32)]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """docs: (doc_id, text). A bounded sample of training rows goes to the driver, as counts, never as text."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) != held
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.count("*").alias("marked"))
    ids = docs.where("doc_id is not null").where(fold).select("doc_id").join(marks, "doc_id", "left")
    at = F.xxhash64("doc_id")

    @K.tidy_batches
    def measure(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"x": pa.array([K.pack(r.astype(np.float16)) for r in x], pa.binary())})

    def inputs(of: DataFrame) -> np.ndarray:
        some = F.broadcast(of.orderBy(at, "doc_id").limit(sample).select("doc_id").dropDuplicates())  # at most ``sample`` ids
        got = docs.join(some, "doc_id").select("text").mapInArrow(measure, "x binary").toArrow()
        return np.stack([K.unpack(r, np.float16) for r in got["x"].to_pylist()]).astype(np.float32) if got.num_rows else np.zeros((0, WIDTH), np.float32)

    positive, unlabelled = inputs(ids.where("quality = 1")), inputs(ids.where("marked is null"))
    # where every row has a label, all training rows stand for web text, whatever their labels
    return fit(positive, unlabelled if len(unlabelled) else inputs(ids))


def classify(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", good_only: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels has doc_id and quality. ``good_only``: the input's rows that are predicted 1."""
    frugal(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train(rows, labels, mod, held, sample)

    @K.tidy_batches
    def score(batches):
        for batch in batches:
            s = model.score(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": remainder(batch.column("doc_id").to_pylist(), mod) == held, "score": s, "predicted": (s >= threshold).astype(np.int32)})

    @K.tidy_batches
    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(batch.schema.get_field_index(text_col))) >= threshold))

    if good_only:
        return docs if model.blank else docs.mapInArrow(choose, docs.schema)
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
