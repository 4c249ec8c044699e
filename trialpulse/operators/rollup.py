"""Roll-ups of the index: subject to site, site to study, region and country (AGG-12..17, DQI-7..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S
from ..plans.tables import staged
from .master import present

STUDY_SUMS = [f"{f}_sum" for f in C.SUMMED if not f.startswith("max_days")]


def _std(x: str) -> Column:
    return S.r10(F.coalesce(F.stddev_samp(x), F.lit(0.0)))


def site_metrics(risk: DataFrame) -> DataFrame:
    """AGG-12: sites of the four keys; subjects with a missing key drop out."""
    return present(risk, C.SITE_KEYS).groupBy(*C.SITE_KEYS).agg(
        F.count("*").alias("subject_count"),
        S.r10(F.avg("dqi_score")).alias("avg_dqi_score"),
        F.max("dqi_score").alias("max_dqi_score"),
        _std("dqi_score").alias("std_dqi_score"),
        F.sum("n_issue_types").alias("total_issue_types"),
        S.r10(F.avg("n_issue_types")).alias("avg_issue_types"),
        F.count_if(F.col("risk_category") == "High").alias("high_risk_count"),
        F.count_if(F.col("risk_category") == "Medium").alias("medium_risk_count"),
        F.sum("has_issues").alias("subjects_with_issues"),
        *(F.sum(f).alias(f"{f}_sum") for f in C.SUMMED),
    )


def _positive(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def site_risk(metrics: DataFrame, high=C.SITE_HIGH, medium=C.SITE_MEDIUM) -> DataFrame:
    """DQI-7: thresholds over sites above 0, with floors. high, medium: (percentile, floor, value where no site is above 0)."""
    x = _positive("avg_dqi_score")
    found = S.percentiles(metrics, _high=(x, high[0]), _medium=(x, medium[0]))
    cuts = F.broadcast(staged(found.select(*(F.when(F.col(n).isNull(), fallback).otherwise(S.r10(F.greatest(F.col(n), F.lit(floor)))).alias(n) for n, (_, floor, fallback) in (("_high", high), ("_medium", medium)))), "cuts"))
    avg = F.col("avg_dqi_score")
    out = metrics.crossJoin(cuts).withColumn("site_risk_category", F.when(avg >= F.col("_high"), "High").when(avg >= F.col("_medium"), "Medium").otherwise("Low"))
    return out.drop("_high", "_medium")


def _level(site: DataFrame, key: str, longest: str, *more: Column) -> DataFrame:
    """Counts, means of site means and rates of a level over site rows."""
    out = present(site, [key]).groupBy(key).agg(
        F.count("*").alias("site_count"),
        F.sum("subject_count").alias("subject_count"),
        S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"),
        F.max("avg_dqi_score").alias(longest),
        _std("avg_dqi_score").alias("std_dqi_score"),
        F.sum("high_risk_count").alias("high_risk_subjects"),
        F.sum("medium_risk_count").alias("medium_risk_subjects"),
        F.sum("subjects_with_issues").alias("subjects_with_issues"),
        *more,
        F.count_if(F.col("site_risk_category") == "High").alias("high_risk_sites"),
    )
    rates = {"high_risk_rate": ("high_risk_subjects", "subject_count"), "issue_rate": ("subjects_with_issues", "subject_count"), "high_risk_site_rate": ("high_risk_sites", "site_count")}
    return out.withColumns({k: S.r10(F.col(a) / F.col(b)) for k, (a, b) in rates.items()})


def study_rollup(site: DataFrame) -> DataFrame:
    """AGG-13 and DQI-8."""
    out = _level(site, "study", "max_site_dqi_score", *(F.sum(c).alias(f"{c}_sum") for c in STUDY_SUMS))
    x = _positive("avg_dqi_score")

    def cut(p: float, fallback: float) -> Column:
        return F.when(F.count(x) == 0, fallback).otherwise(S.r10(F.percentile(x, F.lit(p))))

    out = out.crossJoin(S.one_row(out, cut(0.85, 0.10).alias("_high"), cut(0.50, 0.05).alias("_medium")))
    high = (F.col("avg_dqi_score") >= F.col("_high")) | (F.col("high_risk_rate") > 0.15) | (F.col("high_risk_site_rate") > 0.20)
    medium = (F.col("avg_dqi_score") >= F.col("_medium")) | (F.col("high_risk_rate") > 0.05)
    return out.withColumn("study_risk_category", F.when(high, "High").when(medium, "Medium").otherwise("Low")).drop("_high", "_medium")


def _by_percentile(level: DataFrame, name: str, high: float) -> DataFrame:
    x = F.col("avg_dqi_score")
    cuts = S.one_row(level, S.r10(F.percentile(x, F.lit(high))).alias("_high"), S.r10(F.percentile(x, F.lit(0.5))).alias("_medium"))
    return level.crossJoin(cuts).withColumn(name, F.when(x >= F.col("_high"), "High").when(x >= F.col("_medium"), "Medium").otherwise("Low")).drop("_high", "_medium")


def region_rollup(site: DataFrame) -> DataFrame:
    """AGG-14 and DQI-9."""
    more = [F.count_distinct("study").alias("study_count"), F.count_distinct("country").alias("country_count")]
    return _by_percentile(_level(site, "region", "max_dqi_score", *more), "region_risk_category", 0.75)


def country_rollup(site: DataFrame) -> DataFrame:
    """AGG-15 and DQI-10. The region is that of the first site by (study, site_id)."""
    first = F.min_by("region", F.struct("study", "site_id", "region")).alias("region")
    return _by_percentile(_level(site, "country", "max_dqi_score", F.count_distinct("study").alias("study_count"), first), "country_risk_category", 0.80)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """AGG-18: rows of every category, missing ones as 0."""
    names = ["High", "Medium", "Low"]
    return df.agg(*(F.count_if(F.col(column) == k).alias(k) for k in names)).unpivot([], names, "category", "n")
