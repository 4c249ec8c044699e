"""Cross-validation of the index and its sensitivity to weights (VLD-1..9, WIN-4)."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S
from ..plans.tables import staged
from . import scoring

WEIGHTS = scoring.WEIGHTS
#: Hex digits of a hash that name its range: 4096 ranges a category.
BUCKET_DIGITS = 3


def folds(risk: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """VLD-1: fold 1..k, even within risk categories, by a hash of the key and the seed. A category isn't sorted in one task: its hashes fall into 4096 ranges, whose counts give every range its first place; rows are numbered within their range."""
    order = F.md5(F.concat_ws("|", "study", "subject_id", F.lit(str(seed))))
    ranged = risk.withColumns({"_order": order, "_bucket": F.conv(F.substring(order, 1, BUCKET_DIGITS), 16, 10).cast("int")})
    sizes = ranged.groupBy("risk_category", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("risk_category").orderBy("_bucket")  # a fixed number of ranges
    places = sizes.select("risk_category", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("risk_category")).alias("_all"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("risk_category", "_bucket").orderBy("_order", "study", "subject_id")) - 1
    small, extra = F.floor(F.col("_all") / k), F.col("_all") % k
    large = extra * (small + 1)
    fold = F.when(at < large, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - large) / F.greatest(small, F.lit(1)))) + 1
    same = (F.col("r.risk_category") == F.col("p.risk_category")) & (F.col("r._bucket") == F.col("p._bucket"))
    met = ranged.alias("r").join(F.broadcast(places).alias("p"), same).select("r.*", "p._before", "p._all")
    return met.withColumn("fold", fold.cast("int")).select(*risk.columns, "fold")


def fold_references(folded: DataFrame, k: int, floor: float = 1.0) -> DataFrame:
    """VLD-2: one row with ``refs``: the reference maximum of every feature for the test and the training part of every fold, at place ((fold - 1) * 2 + training) * features + feature. One scan counts the values of each feature by fold; a training part is all counts but its fold's own, so no subject is copied."""
    names = list(WEIGHTS)
    value = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(names)))
    counts = folded.select("fold", F.explode(value).alias("v")).select("fold", "v.*").where("value > 0").groupBy("fold", "feature", "value").agg(F.count("*").alias("n"))
    each = folded.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("_f"))  # k rows
    parts = counts.crossJoin(F.broadcast(each)).withColumn("place", ((F.col("_f") - 1) * 2 + (F.col("fold") != F.col("_f")).cast("int")) * len(names) + F.col("feature"))
    p95 = F.percentile("value", F.lit(0.95), F.col("n"))
    ref = F.when(F.sum("n") >= C.MIN_FOR_P95, p95).otherwise(F.max("value"))
    some = parts.groupBy("place").agg(F.greatest(ref, F.lit(floor)).alias("ref"))
    grid = folded.sparkSession.range(k * 2 * len(names)).select(F.col("id").cast("int").alias("place"))
    all_ = grid.join(F.broadcast(some), "place", "left").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("ref", F.greatest(F.lit(1.0), F.lit(floor))).alias("ref")))).alias("all"))
    return all_.select(F.transform("all", lambda r: r["ref"]).alias("refs"))


def predictions(folded: DataFrame, k: int = 5) -> DataFrame:
    """VLD-2, VLD-9: for every fold, threshold from the other folds, scores and categories of its own subjects. A subject keeps in one row its own fold's test score and the training scores of the others."""
    def score(at) -> Column:
        raw = S.total([scoring.component(f, w, ref=F.col("refs")[at + i]) for i, (f, w) in enumerate(WEIGHTS.items())])
        return S.r10(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))

    rows = folded.drop("dqi_score", "threshold").crossJoin(F.broadcast(fold_references(folded, k)))
    n = len(WEIGHTS)
    train = {f"t{f}": F.when(F.col("fold") != f, score(((f - 1) * 2 + 1) * n)) for f in range(1, k + 1)}
    rows = rows.select("study", "subject_id", "site_id", "fold", "sae_pending_count", "n_issue_types", "risk_category", score((F.col("fold") - 1) * 2 * n).alias("dqi_score"), *(s.alias(c) for c, s in train.items()))
    rows = staged(rows, "fold_scores")
    cuts = scoring.subject_thresholds(rows, {c: F.col(c) for c in train}).select(F.array(*train).alias("_cuts"))
    out = rows.crossJoin(F.broadcast(cuts)).withColumn("threshold_used", F.col("_cuts")[F.col("fold") - 1])
    out = out.withColumn("risk_category_pred", scoring.category(F.col("threshold_used")))
    return out.select("study", "subject_id", "site_id", "fold", "threshold_used", "sae_pending_count", "risk_category", "risk_category_pred", F.col("dqi_score").alias("dqi_score_pred"), (F.col("risk_category") == F.col("risk_category_pred")).alias("prediction_correct"))


def fold_results(pred: DataFrame, total: DataFrame) -> DataFrame:
    """VLD-4, VLD-6: a row a fold."""
    n = S.one_row(total, F.count("*").alias("_n"))
    sae = F.col("sae_pending_count") > 0
    high = F.col("risk_category_pred") == "High"
    out = pred.groupBy("fold").agg(F.count("*").alias("test_size"), F.first("threshold_used").alias("threshold"), S.r10(F.avg(F.col("prediction_correct").cast("double"))).alias("agreement"), F.when(F.count_if(sae) > 0, S.r10(F.count_if(sae & high) / F.count_if(sae))).otherwise(1.0).alias("sae_capture"), *(F.count_if(F.col("risk_category_pred") == k).alias(f"{k.lower()}_count") for k in ("High", "Medium", "Low")))
    return out.crossJoin(n).withColumn("train_size", F.col("_n") - F.col("test_size")).drop("_n")


def stability(results: DataFrame) -> DataFrame:
    """VLD-3: spread of the thresholds over folds (population deviation)."""
    t = F.col("threshold")
    return results.agg(S.r10(F.avg(t)).alias("mean"), S.r10(F.stddev_pop(t)).alias("std"), S.r10(F.coalesce(F.try_divide(F.stddev_pop(t), F.avg(t)), F.lit(0.0))).alias("cv"), F.min(t).alias("min"), F.max(t).alias("max"), S.r10(F.max(t) - F.min(t)).alias("range"))


def rank_correlation(pred: DataFrame, least: int = 10) -> DataFrame:
    """VLD-5, JN-12, AGG-24: Spearman of site means between pairs of folds with more than ``least`` common sites."""
    sites = pred.where("site_id is not null and site_id <> ''").groupBy("fold", "study", "site_id").agg(S.r10(F.avg("dqi_score_pred")).alias("score"))
    a, b = sites.alias("a"), sites.alias("b")
    pairs = a.join(b, (F.col("a.study") == F.col("b.study")) & (F.col("a.site_id") == F.col("b.site_id")) & (F.col("a.fold") < F.col("b.fold"))).select(F.col("a.fold").alias("fold_a"), F.col("b.fold").alias("fold_b"), F.col("a.score").alias("x"), F.col("b.score").alias("y"))
    by = ["fold_a", "fold_b"]
    got = S.spearman(pairs, by)
    return got.select(*by, F.col("n").alias("common_sites"), F.round(S.r10(F.col("correlation")), 6).alias("correlation")).where(F.col("common_sites") > least)


# The scenarios' names and how they change the weights.
SCENARIO_STEPS = [10, 20, 30]


#: The seed of the random scenario.
SEED = 42


def uniform(seed: int, name: str) -> float:
    """A number in (0, 1) that hangs on the seed and the name alone: 52 bits of an MD5. The same in SQL."""
    return (int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def scenarios(seed: int = SEED) -> dict[str, dict[str, float]]:
    """VLD-8: baseline, all weights scaled and set to sum 1 again, equal, random (a flat Dirichlet draw: exponentials set to sum 1), inverted."""
    def scaled(by: float) -> dict[str, float]:
        w = {k: max(0.01, min(1.0, v * by)) for k, v in WEIGHTS.items()}
        return {k: v / sum(w.values()) for k, v in w.items()}

    out = {"Baseline": dict(WEIGHTS)}
    for pct in SCENARIO_STEPS:
        out |= {f"All +{pct}%": scaled(1 + pct / 100), f"All -{pct}%": scaled(1 - pct / 100)}
    out["Equal Weights"] = dict.fromkeys(WEIGHTS, 1 / len(WEIGHTS))
    w = {k: -math.log(uniform(seed, k)) for k in WEIGHTS}
    out["Random Weights"] = {k: v / sum(w.values()) for k, v in w.items()}
    out["Inverted"] = dict(zip(sorted(WEIGHTS, key=lambda k: WEIGHTS[k]), sorted(WEIGHTS.values(), reverse=True)))
    return out


def sensitivity(risk: DataFrame, floor: float = 1.0, least: int = 10) -> DataFrame:
    """VLD-8: shifts of category, capture, counts and site rank correlation of every scenario. A subject keeps all scenarios' scores in one row, so that its category is compared with its own baseline without a join, also where subjects repeat. The correlation is 1 unless there are more than ``least`` sites."""
    names = scenarios()
    typed = risk.drop("dqi_score", "threshold", "risk_category")
    with_refs = typed.crossJoin(F.broadcast(scoring.reference_max(typed, floor)))
    scores = {f"s{i}": S.r10(F.least(S.total([scoring.component(f, w[f]) for f in WEIGHTS]), F.lit(1.0))) for i, w in enumerate(names.values())}
    wide = staged(with_refs.select("study", "subject_id", "site_id", "sae_pending_count", "n_issue_types", *(s.alias(k) for k, s in scores.items())), "scenarios")
    numbered = list(enumerate(names))
    cuts = scoring.subject_thresholds(wide, {f"s{i}": F.col(f"s{i}") for i, _ in numbered})
    cut = F.broadcast(cuts.select(F.array(*(f"s{i}" for i, _ in numbered)).alias("_cuts")))  # one row
    rated = wide.crossJoin(cut).select("sae_pending_count", *(scoring.category(F.col("_cuts")[i], F.col(f"s{i}")).alias(f"r{i}") for i, n in numbered))
    sae = F.col("sae_pending_count") > 0
    pieces = []
    for i, n in numbered:
        r = F.col(f"r{i}")
        shifts = F.count_if(r != F.col("r0"))
        capture = F.when(F.count_if(sae) > 0, F.round(S.r10(F.count_if(sae & (r == "High")) / F.count_if(sae) * 100), 1)).otherwise(100.0)
        pieces.append(F.struct(F.lit(n).alias("scenario"), shifts.alias("category_shifts"), F.round(S.r10(shifts / F.count("*") * 100), 2).alias("shift_pct"), capture.alias("sae_capture_pct"), *(F.count_if(r == k).alias(f"{k.lower()}_count") for k in ("High", "Medium", "Low"))))
    counts = rated.agg(F.count("*").alias("_n"), F.array(*pieces).alias("all")).where("_n > 0").select(F.explode("all").alias("c")).select("c.*")
    sites = wide.where("site_id is not null and site_id <> ''").groupBy("study", "site_id").agg(*(S.r10(F.avg(f"s{i}")).alias(f"s{i}") for i, _ in numbered))
    pairs = sites.select(F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.col(f"s{i}").alias("x"), F.col("s0").alias("y")) for i, n in numbered))).alias("s")).select("s.*")
    corr = S.spearman(pairs, ["scenario"]).select("scenario", F.when(F.col("n") > least, F.round(S.r10(F.col("correlation")), 4)).otherwise(1.0).alias("rank_correlation"))
    return counts.join(F.broadcast(corr), "scenario", "left").fillna(1.0, ["rank_correlation"])
