"""Portfolio questions over the result tables (APP-1..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S

# Bands of the health index, shares of the impact projection.
BANDS = (("Excellent", 85), ("Good", 70), ("Fair", 50))
SAVED, PREVENTED = 0.66, 0.47
TOP_ISSUES = ["sae_pending_count", "missing_visit_count", "missing_pages_count", "lab_issues_count", "uncoded_meddra_count", "uncoded_whodd_count"]


def health(risk: DataFrame) -> DataFrame:
    """APP-1."""
    high, medium = F.count_if(F.col("risk_category") == "High"), F.count_if(F.col("risk_category") == "Medium")
    out = risk.agg(F.count("*").alias("subjects"), high.alias("high"), medium.alias("medium"))
    score = F.floor(S.r10(100 * (1 - (F.col("high") + 0.3 * F.col("medium")) / F.greatest("subjects", F.lit(1))))).cast("int")
    band = F.lit("Poor")
    for name, least in reversed(BANDS):
        band = F.when(F.col("health") >= least, name).otherwise(band)
    return out.withColumn("health", score).withColumn("band", band)


def study_bands(study: DataFrame) -> DataFrame:
    """APP-2."""
    r = F.col("high_risk_rate")
    return study.agg(F.count_if(r >= 0.20).alias("critical"), F.count_if((r >= 0.10) & (r < 0.20)).alias("warning"), F.count_if(r < 0.10).alias("good"))


def top_issues(risk: DataFrame) -> DataFrame:
    """APP-4: totals of six issues, ranked."""
    one = risk.agg(*(F.sum(c).alias(c) for c in TOP_ISSUES))
    return one.unpivot([], TOP_ISSUES, "issue", "total")


def region_comparison(region: DataFrame, site: DataFrame) -> DataFrame:
    """APP-5: regions against the portfolio, ten percent either way."""
    out = region.crossJoin(S.one_row(site, S.r10(F.avg("avg_dqi_score")).alias("portfolio")))
    word = F.when(F.col("avg_dqi_score") > F.col("portfolio") * 1.1, "above").when(F.col("avg_dqi_score") < F.col("portfolio") * 0.9, "below").otherwise("average")
    return out.select("region", "avg_dqi_score", "portfolio", word.alias("position"))


def anomaly_line(scores: DataFrame) -> DataFrame:
    """APP-7."""
    return S.percentiles(scores, p90=(F.col("anomaly_score"), 0.9)).select(S.r10(F.col("p90")).alias("p90"))


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """APP-8, SRT-2."""
    return pairs.orderBy(F.desc("lift"), "issue_a", "issue_b").limit(1).select("issue_a", "issue_b", "lift")


def alerts(site: DataFrame, k: int = 3) -> DataFrame:
    """APP-3: studies with most pending safety reports."""
    return site.groupBy("study").agg(F.sum("sae_pending_count_sum").alias("pending_sae")).orderBy(F.desc("pending_sae"), "study").limit(k)


def alert_counts(site: DataFrame, causes: DataFrame, anomalies: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """APP-3: pending safety reports in all, critical causes, anomalies by severity, and sites of critical clusters; one row."""
    out = site.agg(F.coalesce(F.sum("sae_pending_count_sum"), F.lit(0)).alias("pending_sae"), F.count_if(F.col("sae_pending_count_sum") > 0).alias("sae_sites"))
    out = out.crossJoin(causes.agg(F.count_if(F.col("severity") == "Critical").alias("critical_causes")))
    out = out.crossJoin(anomalies.agg(*(F.count_if(F.col("severity") == k).alias(f"{k.lower()}_anomalies") for k in ("CRITICAL", "HIGH"))))
    if clustered is not None:
        out = out.crossJoin(clustered.agg(F.count_if(F.col("risk_level") == "Critical").alias("critical_cluster_sites")))
    return out


def site_dashboard(site: DataFrame, scores: DataFrame, clustered: DataFrame) -> DataFrame:
    """JN-9: sites with their anomaly score and cluster, joined on all site keys (site_id alone would fan out)."""
    both = site.join(scores.select(*C.SITE_KEYS, "anomaly_score"), C.SITE_KEYS, "left") if set(C.SITE_KEYS) <= set(scores.columns) else site.join(scores.select("study", "site_id", "anomaly_score"), ["study", "site_id"], "left")
    return both.join(clustered.select(*C.SITE_KEYS, "cluster_name"), C.SITE_KEYS, "left").fillna(0.0, ["anomaly_score"]).fillna("Noise", ["cluster_name"])


def cluster_comparison(clustered: DataFrame) -> DataFrame:
    """APP-6: clusters of one name compared."""
    return clustered.groupBy("cluster_name").agg(F.count("*").alias("site_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), F.sum("subject_count").alias("subject_count"), F.sum("high_risk_count").alias("high_risk_count"))


def actions(sites: DataFrame, studies: DataFrame, countries: DataFrame, scores: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """APP-9: one list of what to do from five sources, with urgency 1 to 4."""
    urgency = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}
    place = F.coalesce(*(F.when(F.col("priority") == k, F.lit(v)) for k, v in urgency.items()))
    parts = [
        sites.select(F.lit("site").alias("source"), F.concat_ws(" ", "study", "site_id").alias("target"), place.alias("urgency")),
        studies.select(F.lit("study"), F.col("study"), place),
        countries.select(F.lit("country"), F.concat_ws(" ", "country", "region"), place),
        scores.where("critical_count > 0").select(F.lit("anomaly"), F.concat_ws(" ", "study", "site_id"), F.lit(1)),
    ]
    if causes is not None:
        severity = F.coalesce(*(F.when(F.upper("severity") == k, F.lit(v)) for k, v in urgency.items()))
        parts.append(causes.select(F.lit("root cause"), F.concat_ws(" ", "cause_id", "category"), severity))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def impact(risk: DataFrame) -> DataFrame:
    """APP-10: projected effect on High subjects."""
    high = F.count_if(F.col("risk_category") == "High")
    return risk.agg(high.alias("high"), F.floor(S.r10(high * SAVED)).cast("bigint").alias("resolved"), F.floor(S.r10(high * PREVENTED)).cast("bigint").alias("prevented"))


def drilldown(risk: DataFrame, study: str | None = None, site_id: str | None = None, categories: list[str] | None = None, bins: int = 30) -> DataFrame:
    """APP-11, PRJ-17: a histogram of scores after filters."""
    out = risk
    if study is not None:
        out = out.where(F.col("study") == study)
    if site_id is not None:
        out = out.where(F.col("site_id") == site_id)
    if categories is not None:
        out = out.where(F.col("risk_category").isin(categories))
    bucket = F.least(F.floor(F.col("dqi_score") * bins), F.lit(bins - 1)).cast("int")
    return out.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
