"""Prioritised recommendations by rules (REC-1..8), as structs and arrays of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S

# Issue type -> (priority, action, owner, time limit), in order of declaration.
ACTIONS: dict[str, tuple[str, str, str, str]] = {
    "sae_pending_count": ("CRITICAL", "Immediate SAE review and regulatory submission required", "Medical Monitor / Pharmacovigilance", "24 hours"),
    "uncoded_meddra_count": ("HIGH", "Code adverse event terms to MedDRA dictionary", "Medical Coding Team", "48 hours"),
    "missing_visit_count": ("HIGH", "Contact site to schedule missed visits or document reason", "Clinical Operations / CRA", "72 hours"),
    "missing_pages_count": ("MEDIUM", "Issue data query for missing CRF pages", "Data Management", "5 business days"),
    "lab_issues_count": ("MEDIUM", "Reconcile lab data with central lab vendor", "Data Management / Lab Vendor", "5 business days"),
    "max_days_outstanding": ("MEDIUM", "Escalate data entry delays to site", "CRA / Site Manager", "1 week"),
    "uncoded_whodd_count": ("LOW", "Code medication terms to WHODrug dictionary", "Medical Coding Team", "1 week"),
    "edrr_open_issues": ("LOW", "Resolve external data reconciliation discrepancies", "Data Management", "2 weeks"),
    "inactivated_forms_count": ("LOW", "Review inactivated forms for audit trail compliance", "QA / Data Management", "2 weeks"),
}
ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
# Issues listed for a site.
SITE_ISSUES = ["sae_pending_count", "uncoded_meddra_count", "missing_visit_count", "missing_pages_count", "lab_issues_count", "uncoded_whodd_count", "edrr_open_issues", "inactivated_forms_count"]


def rank(priority: Column) -> Column:
    """SRT-1: place of a priority, unknown ones last."""
    return F.coalesce(*(F.when(priority == k, F.lit(v)) for k, v in ORDER.items()), F.lit(4))


def texts(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs)))


def _issue(i: int, kind: str, count: Column) -> Column:
    priority, action, owner, sla = ACTIONS[kind]
    return F.when(count > 0, F.struct(F.lit(ORDER[priority]).alias("place"), F.lit(i).alias("i"), F.lit(kind).alias("type"), count.cast("bigint").alias("count"), F.lit(priority).alias("priority"), F.lit(action).alias("action"), F.lit(owner).alias("owner"), F.lit(sla).alias("sla")))


def subjects(risk: DataFrame) -> DataFrame:
    """REC-1: High subjects with their issues, most urgent first."""
    issues = F.array_sort(F.array_compact(F.array(*(_issue(i, k, F.col(k)) for i, k in enumerate(ACTIONS)))))
    out = risk.where("risk_category = 'High'").select("study", "site_id", "subject_id", "country", F.round("dqi_score", 3).alias("dqi_score"), "risk_category", issues.alias("issues"))
    return out.withColumn("priority", F.coalesce(F.try_element_at("issues", F.lit(1))["priority"], F.lit("LOW")))


def ordered(recs: DataFrame, score: str, *keys: str) -> DataFrame:
    return recs.orderBy(rank(F.col("priority")), F.desc(score), *keys)


def sites(site: DataFrame, floor: float = 0.2) -> DataFrame:
    """REC-2."""
    s = {k: F.col(f"{k}_sum") for k in C.SUMMED}
    high = F.col("site_risk_category") == "High"
    out = site.where(high | (F.col("avg_dqi_score") > floor))
    issues = F.array_compact(F.array(*(_issue(i, k, s[k]) for i, k in enumerate(SITE_ISSUES))))
    causes = texts(
        (F.col("avg_issue_types") > 3, "several issue types: training gaps"),
        (s["max_days_outstanding"] > 100, "data entry backlog"),
        (s["missing_visit_count"] > 5, "visits missed against protocol"),
        (s["sae_pending_count"] > 0, "safety reporting delays"),
    )
    todo = texts(
        (high, "quality call within 48 hours"),
        (high, "triggered monitoring visit"),
        (F.col("high_risk_count") > F.col("subject_count") * 0.2, "review training records"),
        (F.col("subjects_with_issues") / F.greatest(F.col("subject_count"), F.lit(1)) > 0.5, "enhanced oversight"),
    )
    priority = F.when(s["sae_pending_count"] > 0, "CRITICAL").when(high, "HIGH").otherwise("MEDIUM")
    return out.select("study", "site_id", "country", "region", "subject_count", F.round("avg_dqi_score", 3).alias("avg_dqi_score"), F.round("max_dqi_score", 3).alias("max_dqi_score"), "high_risk_count", "site_risk_category", issues.alias("issues"), causes.alias("root_causes"), todo.alias("recommendations"), priority.alias("priority"))


def first_sites(recs: DataFrame, k: int = 20) -> DataFrame:
    """REC-7, SRT-1: the k most urgent sites; among equals those with the higher mean score."""
    return ordered(recs, "avg_dqi_score", *C.SITE_KEYS).limit(k)


def action_items(risk: DataFrame, site: DataFrame, site_recs: DataFrame, region_recs: DataFrame, country_recs: DataFrame) -> DataFrame:
    """REC-7: the summary of all action items, one row."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    urgent = site_recs.agg(F.count_if(F.col("priority") == "CRITICAL").alias("critical_items"), F.count_if(F.col("priority") == "HIGH").alias("high_priority_items"))
    out = count(risk, "total_subjects")
    for one in (count(site, "total_sites"), count(region_recs, "total_regions"), count(country_recs, "total_countries_flagged"), urgent):
        out = out.crossJoin(one)
    return out


def _number(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def studies(site: DataFrame) -> DataFrame:
    """REC-3."""
    out = site.groupBy("study").agg(F.count("*").alias("n_sites"), F.sum("subject_count").alias("n_subjects"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi"), F.sum("high_risk_count").alias("total_high_risk"), F.sum("sae_pending_count_sum").alias("pending_sae"), F.sum("missing_visit_count_sum").alias("missing_visits"), F.sum("uncoded_meddra_count_sum").alias("uncoded_ae"))
    much = F.col("total_high_risk") > F.col("n_subjects") * 0.1
    sae = F.col("pending_sae") > 0
    todo = texts(
        (sae, F.concat(_number(F.col("pending_sae")), F.lit(" pending SAE reviews"))),
        (~sae & much, "high-risk subject rate above threshold"),
        (F.col("missing_visits") > 10, F.concat(_number(F.col("missing_visits")), F.lit(" missing visits"))),
        (F.col("uncoded_ae") > 5, F.concat(_number(F.col("uncoded_ae")), F.lit(" uncoded terms"))),
    )
    return out.withColumns({"avg_dqi": F.round("avg_dqi", 3), "priority": F.when(sae, "CRITICAL").when(much, "HIGH").otherwise("MEDIUM"), "recommendations": todo})


def _area(site: DataFrame, *keys: str) -> DataFrame:
    out = site.groupBy(*keys).agg(
        F.count("*").alias("n_sites"), F.sum("subject_count").alias("n_subjects"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi"), S.r10(F.coalesce(F.stddev_samp("avg_dqi_score"), F.lit(0.0))).alias("std_dqi"),
        F.sum("high_risk_count").alias("high_risk_subjects"), F.sum("sae_pending_count_sum").alias("pending_sae"), F.sum("missing_visit_count_sum").alias("missing_visits"), F.count_distinct("study").alias("n_studies"), F.count_if(F.col("site_risk_category") == "High").alias("high_risk_sites"),
    )
    out = out.withColumns({"high_risk_rate": S.r10(F.col("high_risk_subjects") / F.col("n_subjects") * 100), "high_risk_site_rate": S.r10(F.col("high_risk_sites") / F.col("n_sites") * 100)})
    whole = S.one_row(site, S.r10(F.avg("avg_dqi_score")).alias("_dqi"))
    return out.crossJoin(whole)


def regions(site: DataFrame) -> DataFrame:
    """REC-4."""
    over = F.when(F.col("_dqi") > 0, (F.col("avg_dqi") / F.col("_dqi") - 1) * 100).otherwise(0.0)
    out = _area(site, "region").withColumn("dqi_diff", S.r10(over))
    high = (F.col("high_risk_rate") > 15) | (F.col("dqi_diff") > 20)
    sae = F.col("pending_sae") > 10
    priority = F.when(sae, "CRITICAL").when(high, "HIGH").when((F.col("high_risk_rate") > 10) | (F.col("dqi_diff") > 10), "MEDIUM").otherwise("LOW")
    todo = texts(
        (sae, F.concat(_number(F.col("pending_sae")), F.lit(" pending SAE reviews"))),
        (~sae & high, "risk rate above portfolio"),
        (F.col("high_risk_site_rate") > 20, "many high-risk sites"),
        (F.col("missing_visits") > 50, F.concat(_number(F.col("missing_visits")), F.lit(" missing visits"))),
        (F.col("std_dqi") > 0.1, "sites differ much in quality"),
    )
    todo = F.when(F.size(todo) == 0, F.array(F.lit("within acceptable range"))).otherwise(todo)
    return out.select("region", "n_sites", "n_subjects", "n_studies", F.round("avg_dqi", 4).alias("avg_dqi"), "pending_sae", "missing_visits", F.round("high_risk_rate", 1).alias("high_risk_rate"), F.round("dqi_diff", 1).alias("dqi_vs_portfolio"), (F.col("dqi_diff") > 10).alias("is_above_average"), priority.alias("priority"), todo.alias("recommendations"))


def countries(site: DataFrame) -> DataFrame:
    """REC-5. High-risk sites are counted by country and region, as the rows are."""
    out = _area(site, "country", "region").where("n_sites >= 2")
    sae, rate, part = F.col("pending_sae") > 5, F.col("high_risk_rate"), F.col("high_risk_site_rate")
    out = out.where((F.col("avg_dqi") > F.col("_dqi") * 1.2) | (rate > 15) | sae | (part > 25))
    priority = F.when(sae, "CRITICAL").when((rate > 20) | (part > 30), "HIGH").when(rate > 10, "MEDIUM").otherwise("LOW")
    todo = texts(
        (sae, F.concat(_number(F.col("pending_sae")), F.lit(" pending SAE reviews"))),
        (part > 30, "many high-risk sites"),
        (F.col("avg_dqi") > F.col("_dqi") * 1.5, "index far above portfolio"),
        (F.col("missing_visits") > 20, F.concat(_number(F.col("missing_visits")), F.lit(" missing visits"))),
    )
    return out.select("country", "region", "n_sites", "n_subjects", "n_studies", F.round("avg_dqi", 4).alias("avg_dqi"), F.round(rate, 1).alias("high_risk_rate"), "high_risk_sites", "pending_sae", "missing_visits", priority.alias("priority"), todo.alias("recommendations"))


def issue_totals(subject_recs: DataFrame) -> DataFrame:
    """REC-6: counts by issue type over the subjects' recommendations."""
    return subject_recs.select(F.explode("issues").alias("i")).groupBy(F.col("i.type").alias("issue_type")).agg(F.count("*").alias("subjects"), F.sum("i.count").alias("total"))


def action_summary(subject: DataFrame, site: DataFrame, study: DataFrame, region: DataFrame, country: DataFrame) -> DataFrame:
    """REC-7: recommendations by level and priority."""
    parts = [df.groupBy("priority").agg(F.count("*").alias("n")).select(F.lit(name).alias("level"), "priority", "n") for name, df in (("subject", subject), ("site", site), ("study", study), ("region", region), ("country", country))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flattened(recs: DataFrame) -> DataFrame:
    """REC-8: lists as text, with the first of each alone, for export."""
    out = recs
    for c, kind in recs.dtypes:
        if kind == "array<string>":
            out = out.withColumn(f"first_{c}", F.try_element_at(c, F.lit(1))).withColumn(c, F.array_join(c, "; "))
        elif kind.startswith("array<struct"):
            out = out.withColumn(f"first_{c}", F.try_element_at(c, F.lit(1))["type"]).withColumn(c, F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit("="), x["count"].cast("string"))), "; "))
    return out
