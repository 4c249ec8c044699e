"""Anomaly detectors over site, country and region tables (ANO-1..18). All detectors give the columns of SCHEMA."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S

# Thresholds of the detectors.
Z_MEDIUM, Z_HIGH, Z_CRITICAL = 3.0, 4.0, 5.0
SAE_UNFLAGGED, SILENT_SUBJECTS, STALE_ITEMS, STALE_DAYS = 3, 30, 5, 45
MAJORITY_SUBJECTS, MAJORITY_PERCENT, DOMINANCE_TOTAL, DOMINANCE_SHARE, SAE_UNCODED = 10, 40, 15, 0.75, 5
COUNTRY_SITES, COUNTRY_Z, COUNTRY_Z_HIGH, COUNTRY_RATE, REGION_SITES, REGION_Z = 3, 1.5, 2.5, 0.25, 5, 1.0
STUDIES, REPEAT_SHARE, ELEVATED_DQI = 2, 0.4, 0.2
DENSITY_Z, DENSITY_Z_HIGH, DENSITY_SUBJECTS, STUDY_TOTAL, CONCENTRATION = 2.5, 3.5, 5, 50, 0.5

TEXT = ["anomaly_type", "detection_method", "level", "study", "site_id", "country", "region", "metric", "severity", "description"]
SCHEMA = [*TEXT, "value", "zscore"]


def _rows(df: DataFrame, kind: str, method, level: str, metric, severity: Column, description: Column, value: Column | None = None, zscore: Column | None = None, **keys: Column) -> DataFrame:
    text = {"anomaly_type": F.lit(kind), "detection_method": method, "level": F.lit(level), "metric": metric, "severity": severity, "description": description}
    text |= {k: keys.get(k, F.col(k)) for k in ("study", "site_id", "country", "region")}
    none = F.lit(None).cast("double")
    return df.select(*(text[c].cast("string").alias(c) for c in TEXT), (none if value is None else value.cast("double")).alias("value"), (none if zscore is None else zscore).alias("zscore"))


def statistical(site: DataFrame) -> DataFrame:
    """ANO-1: high one-sided z-scores of eight columns: one aggregate for all of them, then an unpivot."""
    filled = site.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in C.OUTLIER_METRICS})
    stats = [f(c).alias(f"{n}_{c}") for c in C.OUTLIER_METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))]
    wide = filled.crossJoin(S.one_row(filled, *stats))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.lit(S.label(c)).alias("name"), F.col(c).alias("x"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"), F.col(f"max_{c}").alias("max")) for c in C.OUTLIER_METRICS)))
    long = wide.select(*C.SITE_KEYS, each.alias("m")).select(*C.SITE_KEYS, "m.*").where("max <> 0")
    z = S.r10(S.zscore(F.col("x"), F.col("mean"), F.col("std")))
    hit = long.withColumn("z", z).where(F.col("z") >= Z_MEDIUM)
    severity = F.when(F.col("z") >= Z_CRITICAL, "CRITICAL").when(F.col("z") >= Z_HIGH, "HIGH").otherwise("MEDIUM")
    text = F.concat(F.col("name"), F.lit(" is above average: "), F.col("x").cast("bigint").cast("string"))
    return _rows(hit, "STATISTICAL_OUTLIER", F.lit("Z-Score"), "site", F.col("metric"), severity, text, F.col("x"), F.round("z", 2))


def pattern(site: DataFrame) -> DataFrame:
    """ANO-2..7: six patterns of a site, each a struct or NULL."""
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in site.columns if k.endswith("_sum") or k in ("high_risk_count", "avg_dqi_score")}
    subjects = F.when(F.coalesce(F.col("subject_count"), F.lit(0)) == 0, 1).otherwise(F.col("subject_count"))
    sae, visits, pages, labs, forms = (c[f"{k}_sum"] for k in ("sae_pending_count", "missing_visit_count", "missing_pages_count", "lab_issues_count", "inactivated_forms_count"))
    kinds = [("SAE Pending", sae), ("Missing Visits", visits), ("Missing Pages", pages), ("Lab Issues", labs), ("Inactivated Forms", forms)]
    total = S.total([x for _, x in kinds])
    dominant = F.coalesce(*(F.when(x / F.greatest(total, F.lit(1)) >= DOMINANCE_SHARE, F.lit(k)) for k, x in kinds))

    def found(when: Column, name: str, severity: str, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), text.alias("description")))

    days = F.greatest(c["max_days_outstanding_sum"], c["max_days_page_missing_sum"])
    all_ = F.array_compact(
        F.array(
            found((sae >= SAE_UNFLAGGED) & ~F.col("site_risk_category").eqNullSafe(F.lit("High")), "SAE_NOT_FLAGGED", "CRITICAL", F.concat(sae.cast("string"), F.lit(" pending SAE reviews, site not High"))),
            found((subjects >= SILENT_SUBJECTS) & (c["avg_dqi_score"] == 0), "ZERO_ISSUES_HIGH_VOLUME", "MEDIUM", F.concat(subjects.cast("string"), F.lit(" subjects without issues"))),
            found((visits + pages >= STALE_ITEMS) & (days >= STALE_DAYS), "STALE_MISSING_DATA", "HIGH", F.concat((visits + pages).cast("string"), F.lit(" missing items, "), days.cast("string"), F.lit(" days"))),
            found((subjects >= MAJORITY_SUBJECTS) & (c["high_risk_count"] * 100 / subjects >= MAJORITY_PERCENT), "MAJORITY_HIGH_RISK", "HIGH", F.concat(c["high_risk_count"].cast("string"), F.lit(" of "), subjects.cast("string"), F.lit(" subjects High"))),
            found((total >= DOMINANCE_TOTAL) & dominant.isNotNull(), "SINGLE_ISSUE_DOMINANCE", "MEDIUM", F.concat(dominant, F.lit(" dominates"))),
            found((sae >= SAE_UNCODED) & (c["uncoded_meddra_count_sum"] == 0), "SAE_WITHOUT_CODING", "MEDIUM", F.concat(sae.cast("string"), F.lit(" pending SAE, no uncoded terms"))),
        )
    )
    hit = site.select(*C.SITE_KEYS, F.explode(all_).alias("p"))
    return _rows(hit, "PATTERN_ANOMALY", F.col("p.pattern"), "site", F.col("p.pattern"), F.col("p.severity"), F.col("p.description"))


def geography(site: DataFrame, keys: list[str]) -> DataFrame:
    """ANO-11: country or region figures straight from site rows: means of site rates."""
    return site.groupBy(*keys).agg(F.count("*").alias("site_count"), F.avg("avg_dqi_score").alias("avg_dqi_score"), F.avg(F.col("high_risk_count") / F.greatest(F.col("subject_count"), F.lit(1))).alias("high_risk_rate"), F.sum("high_risk_count").alias("high_risk_subjects"), F.sum("subject_count").alias("subject_count"))


def regional(site: DataFrame, country: DataFrame | None = None, region: DataFrame | None = None) -> DataFrame:
    """ANO-8..10: countries against all sites, regions against each other."""
    country = geography(site, ["country", "region"]) if country is None else country
    region = geography(site, ["region"]) if region is None else region
    rate = F.col("high_risk_count") / F.greatest(F.col("subject_count"), F.lit(1))
    portfolio = S.one_row(site, F.avg("avg_dqi_score").alias("_dm"), F.stddev_samp("avg_dqi_score").alias("_ds"), F.avg(rate).alias("_rm"), F.stddev_samp(rate).alias("_rs"))
    big = country.where(F.col("site_count") >= COUNTRY_SITES).crossJoin(portfolio)
    big = big.withColumns({"dz": S.r10(S.zscore(F.col("avg_dqi_score"), F.col("_dm"), F.col("_ds"))), "rz": S.r10(S.zscore(F.col("high_risk_rate"), F.col("_rm"), F.col("_rs")))})

    def named(k: str) -> Column:
        return F.concat(F.col(k), F.lit(" ("), F.col("site_count").cast("string"), F.lit(" sites)"))

    whole = {"study": F.lit("Portfolio"), "site_id": named("country")}
    high_dqi = _rows(big.where(F.col("dz") >= COUNTRY_Z), "REGIONAL_ANOMALY", F.lit("COUNTRY_HIGH_DQI"), "country", F.lit("country_avg_dqi"), F.when(F.col("dz") >= COUNTRY_Z_HIGH, "HIGH").otherwise("MEDIUM"), F.concat(F.col("country"), F.lit(" average index above portfolio")), F.round("avg_dqi_score", 4), F.round("dz", 2), **whole)
    high_rate = _rows(big.where(F.col("high_risk_rate") >= COUNTRY_RATE), "REGIONAL_ANOMALY", F.lit("COUNTRY_HIGH_RISK_RATE"), "country", F.lit("high_risk_rate"), F.lit("HIGH"), F.concat(F.col("country"), F.lit(" high-risk subject rate")), F.round("high_risk_rate", 4), F.round("rz", 2), **whole)
    wide = region.where(F.col("site_count") >= REGION_SITES)
    wide = wide.crossJoin(S.one_row(wide, F.avg("avg_dqi_score").alias("_m"), F.stddev_samp("avg_dqi_score").alias("_s"), F.count("*").alias("_n"))).where("_n >= 2")
    wide = wide.withColumn("z", S.r10(S.zscore(F.col("avg_dqi_score"), F.col("_m"), F.col("_s")))).where(F.abs("z") >= REGION_Z)
    up = F.col("z") > 0
    compare = _rows(wide, "REGIONAL_ANOMALY", F.lit("REGION_COMPARISON"), "region", F.lit("region_avg_dqi"), F.when(up, "HIGH").otherwise("MEDIUM"), F.concat(F.col("region"), F.lit(" index "), F.when(up, "above").otherwise("below"), F.lit(" other regions")), F.round("avg_dqi_score", 4), F.round("z", 2), study=F.lit("Portfolio"), site_id=named("region"), country=F.lit("Multiple"))
    return high_dqi.unionByName(high_rate).unionByName(compare)


def cross_study(site: DataFrame) -> DataFrame:
    """ANO-12 and ANO-13: sites in several studies, by their categories there."""
    entry = F.struct("study", "country", "region", "site_risk_category")
    many = site.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score")).where(F.size("rows") >= STUDIES)
    high = F.filter("rows", lambda r: r["site_risk_category"] == "High")
    many = many.select("site_id", "avg_dqi_score", F.size("rows").alias("n"), F.size(high).alias("n_high"), F.array_join(F.transform("rows", lambda r: r["study"]), ", ").alias("study"), F.array_join(F.transform(high, lambda r: r["study"]), ", ").alias("high_in"), F.col("rows")[0]["country"].alias("country"), F.col("rows")[0]["region"].alias("region"))
    share = F.col("n_high") / F.col("n")
    repeat = _rows(many.where(share >= REPEAT_SHARE), "CROSS_STUDY_ANOMALY", F.lit("REPEAT_OFFENDER"), "site", F.lit("cross_study_high_risk"), F.when(F.col("n_high") == F.col("n"), "CRITICAL").otherwise("HIGH"), F.concat(F.lit("High in "), F.col("n_high").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" studies: "), F.col("high_in")), F.col("n_high"))
    raised = _rows(many.where((F.col("avg_dqi_score") >= ELEVATED_DQI) & (share < REPEAT_SHARE)), "CROSS_STUDY_ANOMALY", F.lit("ELEVATED_DQI_MULTI_STUDY"), "site", F.lit("avg_dqi_across_studies"), F.lit("MEDIUM"), F.concat(F.lit("Raised index across "), F.col("n").cast("string"), F.lit(" studies")), F.round("avg_dqi_score", 3))
    return repeat.unionByName(raised)


DENSITY_COLUMNS = [f"{f}_sum" for f in C.SUMMED]


def _totals(site: DataFrame) -> DataFrame:
    total = S.total([F.coalesce(F.col(c), F.lit(0)) for c in DENSITY_COLUMNS])
    return site.select(*C.SITE_KEYS, "subject_count", total.alias("total")).withColumn("density", F.col("total") / F.greatest(F.col("subject_count"), F.lit(1)))


def density(site: DataFrame, least: float = DENSITY_Z, high: float = DENSITY_Z_HIGH, subjects: int = DENSITY_SUBJECTS) -> DataFrame:
    """ANO-14: sites of ``subjects`` or more whose issues per subject lie ``least`` deviations above the mean."""
    rows = _totals(site)
    rows = rows.crossJoin(S.one_row(rows, F.avg("density").alias("_m"), F.stddev_samp("density").alias("_s")))
    hit = rows.withColumn("z", S.r10(S.zscore(F.col("density"), F.col("_m"), F.col("_s")))).where((F.col("z") >= least) & (F.col("subject_count") >= subjects))
    return _rows(hit, "VELOCITY_ANOMALY", F.lit("HIGH_ISSUE_DENSITY"), "site", F.lit("issue_density"), F.when(F.col("z") >= high, "HIGH").otherwise("MEDIUM"), F.concat(F.col("total").cast("string"), F.lit(" issues of "), F.col("subject_count").cast("string"), F.lit(" subjects")), F.round("density", 2), F.round("z", 2))


def concentration(site: DataFrame, least: int = STUDY_TOTAL, share: float = CONCENTRATION) -> DataFrame:
    """ANO-15, WIN-2: a site's share of its study's issues."""
    all_ = F.sum("total").over(Window.partitionBy("study"))
    rows = _totals(site).withColumn("all", all_).where(F.col("all") >= least).withColumn("part", F.col("total") / F.col("all"))
    return _rows(rows.where(F.col("part") >= share), "VELOCITY_ANOMALY", F.lit("STUDY_CONCENTRATION"), "site", F.lit("study_issue_pct"), F.lit("HIGH"), F.concat(F.col("total").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(" issues")), F.round("part", 3))


def detect(site: DataFrame, country: DataFrame | None = None, region: DataFrame | None = None) -> DataFrame:
    """All families (SET-1)."""
    return reduce(DataFrame.unionByName, [statistical(site), pattern(site), regional(site, country, region), cross_study(site), density(site), concentration(site)])


def site_scores(anomalies: DataFrame) -> DataFrame:
    """ANO-16, ANO-17: weighted severity of a site's anomalies, raised by their variety; the first three descriptions by type and metric."""
    s = F.col("severity")
    weight = F.coalesce(*(F.when(s == k, F.lit(v)) for k, v in C.SEVERITY.items()), F.lit(1))
    first = F.slice(F.array_sort(F.collect_list(F.struct("anomaly_type", "detection_method", "metric", F.substring("description", 1, 100).alias("text")))), 1, 3)
    out = anomalies.where("level = 'site'").groupBy("study", "site_id").agg(
        F.count("*").alias("anomaly_count"),
        *(F.count_if(s == k).alias(f"{k.lower()}_count") for k in C.SEVERITY),
        F.array_sort(F.collect_set("anomaly_type")).alias("types"),
        F.sum(weight).alias("weighted"),
        F.array_join(F.transform(first, lambda x: x["text"]), "; ").alias("top_anomalies"),
    )
    score = F.col("weighted") / (F.col("anomaly_count") * 4) * (1 + 0.1 * F.size("types"))
    out = out.withColumns({"anomaly_types": F.array_join("types", ", "), "type_diversity": F.size("types"), "anomaly_score": F.round(S.r10(score), 3)}).withColumn("is_anomaly", F.col("anomaly_score") > 0)
    return out.drop("types", "weighted")


def summary(anomalies: DataFrame) -> DataFrame:
    """ANO-18: counts by severity and by type."""
    by = [anomalies.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "name", "n") for c in ("severity", "anomaly_type")]
    return by[0].unionByName(by[1])
