"""Perspectives on a site and their consensus (AGT-1..8).

A perspective is declared in SQL expressions over the columns of enrich(): a
score, and texts with the conditions under which they are said. The same
declaration is a column of the DataFrame API and a table function of SQL, and a
registry of them is what the consensus is made of; users add their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .recommend import texts

# Bounds of levels, weights of the consensus.
LEVELS = (("Critical", 0.8), ("High", 0.6), ("Medium", 0.4))
URGENT = "(?i)sae|safety|urgent|immediate|escalate|meddra"


def level(score: Column) -> Column:
    """AGT-6."""
    out = F.when(score >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Low")


def context(site: DataFrame) -> DataFrame:
    """AGT-1: the portfolio, one row."""
    return site.agg(S.r10(F.avg("avg_dqi_score")).alias("portfolio_dqi"), S.r10(F.avg("subject_count")).alias("portfolio_subjects"), S.r10(F.avg("sae_pending_count_sum")).alias("portfolio_sae"), S.r10(F.sum("high_risk_count") / F.sum("subject_count")).alias("portfolio_high_rate"))


def enrich(site: DataFrame, scores: DataFrame, study: DataFrame, country: DataFrame) -> DataFrame:
    """JN-3, JN-5: anomaly scores by study and site; risk of study and country, Unknown where missing; the portfolio's row."""
    out = site.join(scores.select("study", "site_id", "anomaly_score", "is_anomaly"), ["study", "site_id"], "left")
    out = out.withColumns({"anomaly_score": F.coalesce("anomaly_score", F.lit(0.0)), "is_anomaly": F.coalesce("is_anomaly", F.lit(False))})
    out = out.join(study.select("study", "study_risk_category"), "study", "left").join(country.select("country", "country_risk_category"), "country", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("study_risk_category", "country_risk_category")})
    return out.crossJoin(F.broadcast(context(site)))


def candidates(enriched: DataFrame, n: int | None = None) -> DataFrame:
    """AGT-2: rank_score from anomaly, index and high-risk counts; the n best, if asked."""
    top = S.one_row(enriched, F.max("avg_dqi_score").alias("_d"), F.max("high_risk_count").alias("_h"))
    out = enriched.crossJoin(top).withColumn("rank_score", S.r10(0.4 * F.col("anomaly_score") + 0.4 * F.coalesce(F.try_divide("avg_dqi_score", "_d"), F.lit(0.0)) + 0.2 * F.coalesce(F.try_divide("high_risk_count", "_h"), F.lit(0.0)))).drop("_d", "_h")
    return out if n is None else out.orderBy(F.desc("rank_score"), "study", "site_id", "country", "region").limit(n)


VIEW = "score DOUBLE, level STRING, confidence DOUBLE, findings ARRAY<STRING>, actions ARRAY<STRING>"


@dataclass(frozen=True)
class Perspective:
    """``columns``: what the expressions read; ``score``: severity, capped at 1; ``findings`` and ``actions``: (condition, text), both expressions; ``weight``: its part in the consensus; ``concern``: what the consensus says of a score above one half."""

    name: str
    columns: tuple[str, ...]
    score: str
    weight: float
    concern: str
    findings: tuple[tuple[str, str], ...] = ()
    actions: tuple[tuple[str, str], ...] = ()
    confidence: str = "0.8"

    def expressions(self) -> dict[str, str]:
        score = f"round(least({self.score}, 1.0D) + 1e-13, 10)"
        level = "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{name}'" for name, least in LEVELS) + " ELSE 'Low' END"

        def said(pairs: tuple[tuple[str, str], ...]) -> str:
            return "array_compact(array(" + ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in pairs) + "))" if pairs else "CAST(array() AS ARRAY<STRING>)"

        return {"score": score, "level": level, "confidence": f"CAST({self.confidence} AS DOUBLE)", "findings": said(self.findings), "actions": said(self.actions)}

    def __call__(self) -> Column:
        """The struct (score, level, confidence, findings, actions) of a row."""
        return F.struct(*(F.expr(e).alias(n) for n, e in self.expressions().items()))

    def create(self, enriched: DataFrame) -> str:
        """A temporary SQL table function perspective_<name> over the same columns, of the types that ``enriched`` has: one row with the declared schema VIEW."""
        types = {f.name: f.dataType.simpleString() for f in enriched.schema}
        name = f"perspective_{self.name}"
        arguments = ", ".join(f"{c} {types[c]}" for c in self.columns)
        enriched.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({VIEW}) RETURN SELECT " + ", ".join(self.expressions().values()))
        return name


_N = "greatest(subject_count, 1)"
_RATE = f"(high_risk_count / {_N})"
_BOTH = "site_risk_category = 'High' AND study_risk_category = 'High'"
_FAR = f"{_RATE} > 0.2 AND {_RATE} > portfolio_high_rate * 2 AND portfolio_high_rate > 0"
_LATE = "missing_pages_count_sum > 0 AND max_days_page_missing_sum > 30"

# Scores, texts and weights of AGT-3, AGT-4 and AGT-5.
BUILT_IN = (
    Perspective(
        "safety",
        ("sae_pending_count_sum", "uncoded_meddra_count_sum", "uncoded_whodd_count_sum", "portfolio_sae"),
        "least(0.5D, sae_pending_count_sum * 0.1D) + least(0.3D, uncoded_meddra_count_sum * 0.05D) + least(0.2D, uncoded_whodd_count_sum * 0.02D)",
        0.40,
        "safety concerns",
        (("sae_pending_count_sum > 0", "concat('pending SAE reviews: ', sae_pending_count_sum)"), ("uncoded_meddra_count_sum > 0", "concat('uncoded adverse events: ', uncoded_meddra_count_sum)"), ("uncoded_whodd_count_sum > 0", "concat('uncoded drug terms: ', uncoded_whodd_count_sum)"), ("sae_pending_count_sum > portfolio_sae * 2 AND portfolio_sae > 0", "'SAE far above portfolio'")),
        (("sae_pending_count_sum > 0", "'Immediate SAE review'"), ("sae_pending_count_sum >= 5", "'Escalate to safety officer'"), ("uncoded_meddra_count_sum > 0", "'Code MedDRA terms'"), ("uncoded_whodd_count_sum > 0", "'Code drug terms'")),
        "CASE WHEN sae_pending_count_sum > 0 THEN 0.9 ELSE 0.7 END",
    ),
    Perspective(
        "quality",
        ("subject_count", "missing_visit_count_sum", "missing_pages_count_sum", "lab_issues_count_sum", "edrr_open_issues_sum", "max_days_page_missing_sum", "inactivated_forms_count_sum"),
        f"least(0.3D, missing_visit_count_sum / {_N} * 0.5D) + least(0.3D, missing_pages_count_sum / {_N} * 0.3D) + least(0.2D, lab_issues_count_sum / {_N} * 0.3D) + least(0.1D, edrr_open_issues_sum / {_N} * 0.2D) + CASE WHEN max_days_page_missing_sum > 30 THEN 0.1D ELSE 0.0D END",
        0.35,
        "data quality concerns",
        (("missing_visit_count_sum > 0", "concat('missing visits: ', missing_visit_count_sum)"), ("missing_pages_count_sum > 0", "concat('missing pages: ', missing_pages_count_sum)"), (_LATE, "concat('page days: ', max_days_page_missing_sum)"), ("lab_issues_count_sum > 0", "concat('lab issues: ', lab_issues_count_sum)"), ("edrr_open_issues_sum > 0", "concat('reconciliation issues: ', edrr_open_issues_sum)"), ("inactivated_forms_count_sum > 5", "concat('inactivated forms: ', inactivated_forms_count_sum)")),
        (("missing_visit_count_sum >= 10", "'Urgent visit documentation'"), ("missing_visit_count_sum > 0 AND missing_visit_count_sum < 10", "'Schedule visit entry'"), (_LATE, "'Urgent: old missing pages'"), ("lab_issues_count_sum > 0", "'Resolve lab discrepancies'"), ("edrr_open_issues_sum > 0", "'Reconcile external data'"), ("inactivated_forms_count_sum > 5", "'Review form inactivation'")),
        "0.85",
    ),
    Perspective(
        "performance",
        ("avg_dqi_score", "portfolio_dqi", "site_risk_category", "high_risk_count", "subject_count", "is_anomaly", "portfolio_high_rate", "study_risk_category", "country_risk_category", "country"),
        f"least(0.4D, avg_dqi_score) + CASE WHEN {_RATE} > 0.1 THEN least(0.3D, {_RATE}) ELSE 0.0D END + CASE WHEN is_anomaly THEN 0.2D ELSE 0.0D END + CASE WHEN site_risk_category = 'High' THEN 0.1D ELSE 0.0D END",
        0.25,
        "performance below standard",
        (("portfolio_dqi > 0 AND avg_dqi_score > portfolio_dqi * 1.5", "'index above portfolio'"), (f"{_RATE} > 0.2", "'high-risk subject rate'"), (_FAR, "'rate far above portfolio'"), (_BOTH, "'site and study high-risk'"), ("country_risk_category = 'High'", "concat('high-risk country: ', country)"), ("is_anomaly", "'flagged as anomaly'")),
        (("portfolio_dqi > 0 AND avg_dqi_score > portfolio_dqi * 1.5", "'Investigate systemic issues'"), (_FAR, "'Root cause analysis'"), (_BOTH, "'Coordinate with study team'"), ("is_anomaly", "'Review anomalies'")),
        "0.75",
    ),
)
PERSPECTIVES = {p.name: p for p in BUILT_IN}


@dataclass
class Registry:
    """AGT-8: the perspectives that a consensus is made of, the built-in ones first."""

    perspectives: dict[str, Perspective] = field(default_factory=lambda: dict(PERSPECTIVES))

    def add(self, perspective: Perspective) -> Registry:
        """A new perspective, or another one in the place of that name."""
        if not perspective.name.isidentifier() or perspective.weight < 0:
            raise ValueError("a perspective needs a name and a weight that isn't negative")
        self.perspectives[perspective.name] = perspective
        return self

    def weights(self) -> dict[str, float]:
        whole = sum(p.weight for p in self.perspectives.values())
        return {n: p.weight / whole for n, p in self.perspectives.items()} if abs(whole - 1) > 1e-9 else {n: p.weight for n, p in self.perspectives.items()}

    def by_sql(self, enriched: DataFrame, keys: list[str]) -> DataFrame:
        """keys, perspective and VIEW: every perspective's table function, called for every site by a lateral join."""
        spark = enriched.sparkSession
        calls = [f"SELECT {', '.join(f's.{k}' for k in keys)}, '{n}' AS perspective, v.* FROM {{sites}} s, LATERAL {p.create(enriched)}({', '.join(f's.{c}' for c in p.columns)}) v" for n, p in self.perspectives.items()]
        return spark.sql(" UNION ALL ".join(calls), sites=enriched)


def consensus(enriched: DataFrame, registry: Registry | None = None) -> DataFrame:
    """AGT-7: most severe level, weighted score, escalation, priority 1 to 5, and five findings and actions, in the order of the registry, urgent actions first (SRT-6)."""
    registry = registry or Registry()
    views = registry.perspectives
    out = enriched.withColumns({k: p() for k, p in views.items()})
    names = [n for n, _ in LEVELS] + ["Low"]
    worst = F.least(*(F.coalesce(*(F.when(F.col(f"{k}.level") == n, F.lit(i)) for i, n in enumerate(names))) for k in views))
    score = {k: F.col(f"{k}.score") for k in views}
    s = score["safety"] if "safety" in score else F.lit(0.0)
    all_actions = F.array_distinct(F.concat(*(F.col(f"{k}.actions") for k in views)))
    first = F.concat(F.filter(all_actions, lambda t: t.rlike(URGENT)), F.filter(all_actions, lambda t: ~t.rlike(URGENT)))
    said = texts(*((score[k] > 0.5, p.concern) for k, p in views.items()))
    return out.withColumn("worst", worst).select(
        "study", "site_id", "country", "region",
        F.when(F.col("worst") == 0, 1).when((F.col("worst") == 1) & (s >= 0.5), 2).when(F.col("worst") == 1, 3).when(F.col("worst") == 2, 4).otherwise(5).alias("priority"),
        F.element_at(F.array(*map(F.lit, names)), F.col("worst") + 1).alias("risk_category"),
        _r4(S.r10(S.total([score[k] * w for k, w in registry.weights().items()]))).alias("composite_score"),
        *(_r4(score[k]).alias(f"{k}_score") for k in views),
        F.array_join(F.slice(F.concat(*(F.col(f"{k}.findings") for k in views)), 1, 5), "; ").alias("top_issues"),
        F.array_join(F.slice(first, 1, 5), "; ").alias("recommended_actions"),
        F.when(F.size(said) == 0, "within acceptable parameters").otherwise(F.array_join(said, "; ")).alias("agent_consensus"),
        ((F.col("worst") == 0) | (s >= 0.7) | ((F.col("worst") == 1) & (s >= 0.5))).alias("escalation_required"),
    )


def _r4(c: Column) -> Column:
    """Four decimals, halves up however the double stands."""
    return F.round(c + F.lit(1e-12), 4)
