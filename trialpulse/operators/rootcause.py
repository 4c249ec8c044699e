"""Co-occurrence, geographic patterns, contributing factors and root causes (RCA-1..13)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S

ISSUES = C.SUMMED
SITE_ISSUES = [f"{c}_sum" for c in ISSUES]


def cooccurrence(subjects: DataFrame) -> DataFrame:
    """RCA-1: 45 pairs of issues from one wide aggregate (JN-11): both, rate, lift, correlation."""
    has = {c: (F.col(c) > 0).cast("double") for c in ISSUES}
    pairs = list(combinations(ISSUES, 2))
    one = subjects.agg(F.count("*").alias("n"), *(F.sum(has[c]).alias(f"n_{c}") for c in ISSUES), *(F.sum(has[a] * has[b]).alias(f"b_{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("issue_a"), F.lit(b).alias("issue_b"), F.col(f"n_{a}").alias("na"), F.col(f"n_{b}").alias("nb"), F.col(f"b_{i}").alias("both")) for i, (a, b) in enumerate(pairs))))
    long = one.select("n", rows.alias("p")).select("n", "p.*")
    n, a, b, both = (F.col(c).cast("double") for c in ("n", "na", "nb", "both"))
    some = (a > 0) & (b > 0)
    lift = F.when(some, both * n / (a * b)).otherwise(0.0)
    spread = F.sqrt(a * (n - a) * b * (n - b))
    corr = F.when(some & (spread > 0), (n * both - a * b) / spread).otherwise(0.0)
    return long.select("issue_a", "issue_b", both.cast("bigint").alias("cooccurrence_count"), F.round(S.r10(both / n), 4).alias("cooccurrence_rate"), F.round(S.r10(lift), 3).alias("lift"), F.round(S.r10(corr), 3).alias("correlation"))


def pair_kind(a: str, b: str) -> str:
    """RCA-2: which text a pair of issues gets; the first rule that holds."""
    if "sae" in a and "meddra" in b:
        return "safety"
    if "missing_visit" in a and "missing_pages" in b:
        return "entry"
    if "days" in a or "days" in b:
        return "time"
    return "coding" if "uncoded" in a and "uncoded" in b else "other"


def pair_text(a: str, b: str) -> list[str]:
    """The text of a pair in pieces: between them stands the strength, or the lift."""
    text = C.PAIR_TEXTS[pair_kind(a, b)]
    for name, value in (("{a}", C.ISSUE_PHRASES[a]), ("{a_title}", C.ISSUE_PHRASES[a].title()), ("{b}", C.ISSUE_PHRASES[b])):
        text = text.replace(name, value)
    return text.replace("{lift}", "{word}").split("{word}")


def patterns(pairs: DataFrame, lift: float = 1.2, least: int = 10) -> DataFrame:
    """RCA-1, RCA-2: the pairs that stand out, with what they mean."""
    strength = F.when(F.col("lift") > 2, "strongly").when(F.col("lift") > 1.5, "moderately").otherwise("slightly")
    number = F.format_string("%.1f", F.round("lift", 1))
    rows = []
    for a, b in combinations(ISSUES, 2):
        head, tail = pair_text(a, b)
        rows.append((a, b, head, tail, pair_kind(a, b) == "other"))
    texts = F.broadcast(pairs.sparkSession.createDataFrame(rows, "issue_a string, issue_b string, _head string, _tail string, _number boolean"))  # 45 rows
    out = pairs.where((F.col("lift") > lift) & (F.col("cooccurrence_count") >= least)).join(texts, ["issue_a", "issue_b"])
    return out.withColumn("interpretation", F.concat("_head", F.when(F.col("_number"), number).otherwise(strength), "_tail")).drop("_head", "_tail", "_number")


def matrix(pairs: DataFrame) -> DataFrame:
    """SNK-2: the square lift table, 1 on the diagonal."""
    both = pairs.select("issue_a", "issue_b", "lift").union(pairs.select("issue_b", "issue_a", "lift"))
    own = pairs.select(F.explode(F.array(*map(F.lit, ISSUES))).alias("issue_a")).distinct().select("issue_a", F.col("issue_a").alias("issue_b"), F.lit(1.0).alias("lift"))
    return both.union(own).groupBy("issue_a").pivot("issue_b", ISSUES).agg(F.first("lift")).withColumnRenamed("issue_a", "issue")


def _area(site: DataFrame, key: str, least: int, low: float, high: float) -> DataFrame:
    """Dominant issue of an area: highest share of sites that have it, first declared on a tie (AGG-25), against the portfolio's share."""
    share = {c: F.avg((F.col(c) > 0).cast("double")) for c in SITE_ISSUES}
    whole = S.one_row(site, *(s.alias(f"p_{c}") for c, s in share.items()))
    out = site.groupBy(key).agg(F.count("*").alias("site_count"), *(S.r10(s).alias(c) for c, s in share.items())).where(F.col("site_count") >= least).crossJoin(whole)
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("rate"), F.lit(-i).alias("place"), F.lit(c).alias("issue"), F.col(f"p_{c}").alias("base")) for i, c in enumerate(SITE_ISSUES))))
    out = out.select(F.lit(key.title()).alias("level"), F.col(key).alias("location"), "site_count", best.alias("d"))
    out = out.withColumn("ratio", S.r10(F.when(F.col("d.base") > 0, F.col("d.rate") / F.col("d.base")).otherwise(1.0)))
    return out.where((F.col("ratio") > high) | (F.col("ratio") < low)).select("level", "location", F.col("d.issue").alias("dominant_issue"), F.round("d.rate", 4).alias("issue_rate"), F.round("ratio", 2).alias("comparison_to_avg"), "site_count", "ratio")


def geographic(site: DataFrame, country: DataFrame, region: DataFrame) -> DataFrame:
    """RCA-3, RCA-4, JN-6. The risk is the area's own where it is known."""
    parts = []
    for key, least, low, high, table in (("country", 3, 0.7, 1.3, country), ("region", 5, 0.8, 1.2, region)):
        risk = table.select(F.col(key).alias("location"), F.col(f"{key}_risk_category").alias("known"))
        guess = F.when(F.col("ratio") > 1.5, "High").when(F.col("ratio") > high, "Medium").otherwise("Low")
        parts.append(_area(site, key, least, low, high).join(F.broadcast(risk), "location", "left").withColumn("risk_category", F.coalesce("known", guess)))
    return parts[0].unionByName(parts[1]).select("level", "location", "dominant_issue", "issue_rate", "comparison_to_avg", "site_count", "risk_category")


def quantile_bins(df: DataFrame, column: str, labels: list[str]) -> Column:
    """WIN-3: the bin of a value by quantile edges, right-closed; equal values share a bin, and a bin whose edges collide is empty. Edges come from quantile_edges()."""
    out = None
    for i, name in enumerate(labels[:-1], 1):
        c = F.col(column) <= F.col("_edges")[i]
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(labels[-1])


def quantile_edges(df: DataFrame, column: str, n: int) -> DataFrame:
    x = F.col(column).cast("double")
    return F.broadcast(S.percentiles(df, **{f"e{i}": (x, i / n) for i in range(n + 1)}).select(F.array(*(f"e{i}" for i in range(n + 1))).alias("_edges")))


SIZE_LABELS = ["Small", "Medium", "Large", "Very Large"]


def _mean(c: str) -> Column:
    return F.format_string("%.4f", F.round(c, 4))


def factor_size(site: DataFrame) -> DataFrame:
    """RCA-5."""
    binned = site.crossJoin(quantile_edges(site, "subject_count", 4)).withColumn("category", quantile_bins(site, "subject_count", SIZE_LABELS))
    out = binned.groupBy("category").agg(F.count("*").alias("site_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), S.r10(F.avg((F.col("site_risk_category") == "High").cast("double"))).alias("high_risk_rate")).select(F.lit("Site Size").alias("factor"), "*")
    m = _mean("avg_dqi_score")
    # Texts.
    text = (
        F.when(F.col("category") == "Small", F.concat(F.lit("Small sites (avg DQI: "), m, F.lit(") may lack dedicated data management resources")))
        .when(F.col("category") == "Very Large", F.concat(F.lit("Very large sites (avg DQI: "), m, F.lit(") handle high volume but may have process efficiencies")))
        .otherwise(F.concat("category", F.lit(" sites have average DQI of "), m))
    )
    return out.withColumn("interpretation", text)


def factor_study(site: DataFrame) -> DataFrame:
    """RCA-6."""
    out = site.groupBy(F.col("study").alias("category")).agg(F.count("*").alias("site_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), S.r10(F.sum("high_risk_count") / F.greatest(F.sum("subject_count"), F.lit(1))).alias("high_risk_rate")).select(F.lit("Study").alias("factor"), "*")
    return out.withColumn("interpretation", F.concat(F.lit("Study "), "category", F.lit(" has "), F.col("site_count").cast("string"), F.lit(" sites with avg DQI "), _mean("avg_dqi_score")))


def factor_region(site: DataFrame, compat: bool = True) -> DataFrame:
    """RCA-7: the relative deviation from the portfolio mean; ``compat``: also under its older name high_risk_rate."""
    mean = S.one_row(site, F.avg("avg_dqi_score").alias("_m"))
    relative = F.when(F.first("_m") > 0, (F.avg("avg_dqi_score") - F.first("_m")) / F.first("_m")).otherwise(0.0)
    out = site.crossJoin(mean).groupBy(F.col("region").alias("category")).agg(F.count("*").alias("site_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), S.r10(relative).alias("deviation"))
    out = out.select(F.lit("Region").alias("factor"), "*", *([F.col("deviation").alias("high_risk_rate")] * compat))
    side = F.when(F.col("deviation") > 0, "Above").otherwise("Below")
    return out.withColumn("interpretation", F.concat("category", F.lit(": "), side, F.lit(" portfolio average by "), S.share_text(F.abs("deviation"))))


def issue_kinds() -> Column:
    return S.total([(F.col(c) > 0).cast("int") for c in SITE_ISSUES])


def factor_complexity(site: DataFrame) -> DataFrame:
    """RCA-8: bins of the number of issue kinds: none, 1-2, 3-4, more."""
    k = issue_kinds()
    category = F.when(k == 0, "None").when(k <= 2, "Low").when(k <= 4, "Medium").otherwise("High")
    out = site.withColumn("category", category).groupBy("category").agg(F.count("*").alias("site_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), S.r10(F.avg((F.col("site_risk_category") == "High").cast("double"))).alias("high_risk_rate")).select(F.lit("Issue Complexity").alias("factor"), "*")
    n = F.col("site_count").cast("string")
    # Texts.
    text = (
        F.when(F.col("category") == "None", F.concat(n, F.lit(" sites have no active issues - potential best practice sources")))
        .when(F.col("category") == "High", F.concat(n, F.lit(" sites have multiple concurrent issues requiring systemic intervention")))
        .otherwise(F.concat(n, F.lit(" sites with "), F.lower("category"), F.lit(" issue complexity")))
    )
    return out.withColumn("interpretation", text)


SEVERITY_ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}


def root_causes(site: DataFrame, geography: DataFrame, stand_out: DataFrame, clusters: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """RCA-9..13 as rows: cause_id (in the order of the rules), category, description, severity, confidence, affected_sites, affected_subjects, and arrays of evidence, contributing_factors and recommended_actions. ``stand_out``: pairs of issues from patterns(). ``clusters``: sites with a cluster_name; systemic sites are then those whose cluster's name says so. ``compat``: leave timeliness out, as a missing column once did."""
    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    def people(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("subject_count"))), F.lit(0))

    sae, visits, pages, days = (F.col(f"{c}_sum") for c in ("sae_pending_count", "missing_visit_count", "missing_pages_count", "max_days_outstanding"))
    one = site.agg(
        share(sae > 0).alias("sae"), F.count_if(sae > 0).alias("sae_n"), people(sae > 0).alias("sae_s"),
        share(visits > 0).alias("visits"), F.count_if(visits > 0).alias("visits_n"), share(pages > 0).alias("pages"), F.count_if(pages > 0).alias("pages_n"), F.count_if((visits > 0) & (pages > 0)).alias("both_n"), people((visits > 0) | (pages > 0)).alias("data_s"),
        share(days > 30).alias("late"), F.count_if(days > 30).alias("late_n"), F.count_if(days > 60).alias("late60"), people(days > 30).alias("late_s"),
    )
    if clusters is None:
        many = site.withColumn("_many", issue_kinds() >= 4)
    else:
        many = clusters.withColumn("_many", F.coalesce(F.col("cluster_name").rlike("(?i)Systemic|Issues"), F.lit(False)))
    systemic = many.agg(F.count_if("_many").alias("sys_n"), people(F.col("_many")).alias("sys_s"))
    # areas far above the portfolio, the furthest first; the three first of either level are named
    high = geography.where("comparison_to_avg > 1.5")
    listed = [F.array_sort(F.collect_list(F.when(F.col("level") == k, F.struct((-F.col("comparison_to_avg")).alias("r"), "location", "dominant_issue", F.format_string("%.1f", F.round("comparison_to_avg", 1)).alias("times"))))).alias(n) for k, n in (("Region", "regions"), ("Country", "countries"))]
    areas = F.broadcast(high.agg(*listed))  # regions and countries: dimension tables
    named = [F.transform(F.slice(n, 1, 3), lambda x: x["location"]) for n in ("regions", "countries")]
    inside = site.crossJoin(areas).agg(F.count_if(F.array_contains(named[0], F.col("region")) | F.array_contains(named[1], F.col("country"))).alias("geo_n"))
    coded = stand_out.agg((F.count_if((F.col("issue_a").contains("sae") | F.col("issue_b").contains("sae")) & (F.col("issue_a").contains("meddra") | F.col("issue_b").contains("meddra"))) > 0).alias("sae_coded"))
    wide = one.crossJoin(systemic).crossJoin(areas).crossJoin(inside).crossJoin(coded)
    c = F.col

    def text(*parts) -> Column:
        return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))

    def some(*rows: Column) -> Column:
        return F.array_compact(F.array(*rows))

    def strings(values: list[str]) -> Column:
        return F.array(*map(F.lit, values))

    def cause(when: Column, category: str, severity: Column, confidence: float, n: Column, subjects: Column, evidence: Column, more: Column | None = None) -> Column:
        about, factors, actions = C.CAUSES[category]
        description = F.lit(about) if more is None else F.concat(F.lit(about), more)
        return F.when(when, F.struct(F.lit(category).alias("category"), description.alias("description"), severity.alias("severity"), F.lit(confidence).alias("confidence"), n.cast("bigint").alias("affected_sites"), subjects.cast("bigint").alias("affected_subjects"), evidence.alias("evidence"), strings(factors).alias("contributing_factors"), strings(actions).alias("recommended_actions")))

    def far(name: str, level: str) -> Column:
        return F.transform(F.slice(name, 1, 3), lambda x: F.concat(F.lit(f"{level} "), x["location"], F.lit(": "), x["dominant_issue"], F.lit(" rate is "), x["times"], F.lit("x portfolio average")))

    # Texts of evidence.
    found = [
        cause(c("sae") > 0.1, "Safety", F.when(c("sae") > 0.2, "Critical").otherwise("High"), 0.85, c("sae_n"), c("sae_s"), some(text(c("sae_n"), " sites (", S.share_text(c("sae")), ") have pending SAE reviews"), F.when(c("sae_coded"), "SAE and MedDRA coding issues frequently co-occur"))),
        cause((c("visits") > 0.15) | (c("pages") > 0.15), "Completeness", F.when((c("visits") > 0.2) | (c("pages") > 0.2), "High").otherwise("Medium"), 0.80, F.greatest("visits_n", "pages_n"), c("data_s"), some(text(c("visits_n"), " sites (", S.share_text(c("visits")), ") have missing visit data"), text(c("pages_n"), " sites (", S.share_text(c("pages")), ") have missing CRF pages"), F.when(c("both_n") > 0, text(c("both_n"), " sites have both issues simultaneously")))),
        cause((F.size("regions") > 0) | (F.size("countries") > 0), "Geographic", F.when((F.size("regions") > 1) | (F.size("countries") > 2), "High").otherwise("Medium"), 0.75, c("geo_n"), F.lit(0), F.concat(far("regions", "Region"), far("countries", "Country")), F.array_join(F.slice(F.concat(*named), 1, 3), ", ")),
        cause(c("late") > 0.1, "Timeliness", F.when(c("late60") > 10, "High").otherwise("Medium"), 0.85, c("late_n"), c("late_s"), some(text(c("late_n"), " sites (", S.share_text(c("late")), ") have data outstanding > 30 days"), text(c("late60"), " sites have data outstanding > 60 days"))),
        cause(c("sys_n") > 5, "Systemic", F.when(c("sys_n") > 20, "Critical").otherwise("High"), 0.90, c("sys_n"), c("sys_s"), some(text(c("sys_n"), " sites have 4+ concurrent issue types"), F.lit("These sites require comprehensive intervention rather than targeted fixes"))),
    ]
    if compat:
        found.pop(3)
    rows = wide.select(F.posexplode(F.array_compact(F.array(*found))).alias("i", "r"))
    return rows.select(F.format_string("RC%03d", F.col("i") + 1).alias("cause_id"), "r.*")


def by_severity(causes: DataFrame) -> DataFrame:
    """SRT-1: the most severe first, then the most certain."""
    place = F.create_map(*(x for k, v in SEVERITY_ORDER.items() for x in (F.lit(k), F.lit(v))))
    return causes.orderBy(place[F.col("severity")], F.desc("confidence"), "cause_id")
