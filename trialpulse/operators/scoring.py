"""Data quality index of subjects (DQI-1..6, DQI-11, DQI-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S
from ..plans.tables import staged

WEIGHTS = {f: w for f, (w, _) in C.WEIGHTS.items()}


def check_weights(weights: dict[str, float] = WEIGHTS) -> bool:
    """DQI-12."""
    return abs(sum(weights.values()) - 1) < 0.001


def with_issue_types(master: DataFrame) -> DataFrame:
    """DQI-3: how many features, itself left out, are above 0."""
    return master.withColumn("n_issue_types", S.total([(F.col(f) > 0).cast("bigint") for f in C.SUMMED]))


def reference_max(typed: DataFrame, floor: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """DQI-1: <f>_ref of every feature, in one aggregate: the p95 of the values above 0 if there are enough of them, else their maximum, else 1."""
    out = []
    for f in WEIGHTS:
        x = F.when(F.col(f) > 0, F.col(f).cast("double"))
        ref = F.when(F.count(x) >= C.MIN_FOR_P95, F.percentile(x, F.lit(0.95))).otherwise(F.coalesce(F.max(x), F.lit(1.0)))
        out.append((F.greatest(ref, F.lit(floor)) if floor is not None else ref).alias(f"{f}_ref"))
    return typed.groupBy(*by).agg(*out)


def component(f: str, weight: Column | float, presence: float = 0.5, ref: Column | None = None) -> Column:
    """DQI-2: weight times presence and relative severity."""
    x = F.col(f).cast("double")
    severity = F.least(F.greatest(x / (F.col(f"{f}_ref") if ref is None else ref), F.lit(0.0)), F.lit(1.0))
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return w * (F.lit(presence) * (x > 0).cast("double") + F.lit(1 - presence) * severity)


def score_subjects(master: DataFrame, floor: float | None = None) -> DataFrame:
    """DQI-4: components and their sum in scoring order, clipped to [0, 1]."""
    typed = with_issue_types(master)
    scored = typed.crossJoin(F.broadcast(reference_max(typed, floor)))
    scored = scored.withColumns({f"{f}_component": component(f, w) for f, w in WEIGHTS.items()})
    raw = S.total([F.col(f"{f}_component") for f in WEIGHTS])
    return scored.withColumn("dqi_score", S.r10(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))).drop(*(f"{f}_ref" for f in WEIGHTS))


def subject_thresholds(df: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """DQI-5: the high threshold of each named score (null where a row doesn't count), one row, exact in two passes."""
    eligible = (F.col("n_issue_types") > 0) & (F.col("sae_pending_count") == 0)
    found = S.percentiles(df, **{n: (F.when(eligible, s), C.SUBJECT_PERCENTILE) for n, s in scores.items()})
    return found.select(*(F.when(F.col(n).isNull(), F.lit(C.SUBJECT_FALLBACK)).otherwise(S.r10(F.greatest(F.col(n), F.lit(C.SUBJECT_FLOOR)))).alias(n) for n in scores))


def subject_threshold(scored: DataFrame) -> DataFrame:
    return subject_thresholds(scored, {"threshold": F.col("dqi_score")})


def category(threshold: Column, score: Column | None = None) -> Column:
    """High for pending safety reports whatever the score; then by the threshold; Medium for any issue."""
    score = F.col("dqi_score") if score is None else score
    return F.when(F.col("sae_pending_count") > 0, "High").when((F.col("n_issue_types") > 0) & (score >= threshold), "High").when(F.col("n_issue_types") > 0, "Medium").otherwise("Low")


def subject_risk(scored: DataFrame) -> DataFrame:
    """DQI-5: has_issues, risk_category and the threshold used. The threshold is a row of its own that is found once, however often the result is read."""
    out = scored.crossJoin(F.broadcast(staged(subject_threshold(scored), "threshold")))
    return out.withColumn("has_issues", (F.col("n_issue_types") > 0).cast("int")).withColumn("risk_category", category(F.col("threshold")))


def overrides(risk: DataFrame) -> DataFrame:
    """DQI-6: subjects that only the safety override makes High."""
    sae = F.col("sae_pending_count") > 0
    return risk.agg(F.count_if(sae).alias("sae_subjects"), F.count_if(sae & (F.col("dqi_score") < F.col("threshold"))).alias("overridden"))


def component_statistics(scored: DataFrame) -> DataFrame:
    """AGG-19: one row a feature from one wide aggregate."""
    wide = []
    for f in WEIGHTS:
        x, c = F.col(f), F.col(f"{f}_component")
        wide.append(F.struct(F.lit(f).alias("feature"), F.lit(WEIGHTS[f]).alias("weight"), F.lit(C.WEIGHTS[f][1]).alias("tier"), F.count_if(x > 0).alias("n_positive"), F.round(F.avg(x.cast("double")), 8).alias("mean_raw"), F.max(x).cast("double").alias("max_raw"), F.round(F.avg(c), 8).alias("mean_component"), F.round(F.max(c), 8).alias("max_component")))
    return scored.agg(F.array(*wide).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def checks(risk: DataFrame, site: DataFrame) -> DataFrame:
    """DQI-11: five checks as rows (check_name, passed)."""
    level = {k: F.col("risk_category") == k for k in ("High", "Medium", "Low")}
    sae = F.col("sae_pending_count") > 0
    mean = {k: F.coalesce(F.avg(F.when(c, F.col("dqi_score"))), F.lit(0.0)) for k, c in level.items()}
    issues = F.sum("has_issues")
    flagged = F.count_if(~level["Low"])
    one = risk.agg(
        (F.count_if(sae) == F.count_if(sae & level["High"])).alias("sae_capture"),
        F.when(issues > 0, flagged / issues >= 0.99).otherwise(True).alias("capture_rate"),
        (F.count_if(level["Medium"]) >= F.count_if(level["High"])).alias("pyramid_shape"),
        ((S.r10(mean["High"]) > S.r10(mean["Medium"])) & (S.r10(mean["Medium"]) > S.r10(mean["Low"]))).alias("score_alignment"),
    )
    two = site.agg((F.count_if(F.col("site_risk_category") == "Medium") >= F.count_if(F.col("site_risk_category") == "High")).alias("site_pyramid"))
    names = ["sae_capture", "capture_rate", "pyramid_shape", "score_alignment", "site_pyramid"]
    return one.crossJoin(two).unpivot([], names, "check_name", "passed")
