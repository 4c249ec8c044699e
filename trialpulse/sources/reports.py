"""Text reports over result tables (SNK-6): every table that a report reads is bounded by its level or by a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import label
from ..operators import recommend, rootcause

RULE = "=" * 80


def _title(text: str) -> list[str]:
    return [RULE, text, RULE, ""]


def executive_summary(items: DataFrame, site_recs: DataFrame, totals: DataFrame, k: int = 5) -> str:
    """Counts of recommend.action_items(), the k most urgent sites, and issues by how often they occur (recommend.issue_totals())."""
    n = items.first()
    out = _title("EXECUTIVE SUMMARY")
    out += [f"Subjects: {n.total_subjects} | Sites: {n.total_sites} | Regions: {n.total_regions} | Countries flagged: {n.total_countries_flagged}"]
    urgent = [f"[!] CRITICAL SITES: {n.critical_items} sites flagged for urgent quality review"] * (n.critical_items > 0)
    out += ["", *(urgent or ["[OK] No critical items requiring immediate action"]), "", "TOP PRIORITIES"]
    for i, r in enumerate(recommend.first_sites(site_recs, k).collect(), 1):
        out += [f"{i}. [{r.priority}] {r.study} - {r.site_id} ({r.country})", f"   DQI score: {r.avg_dqi_score:.3f} | High-risk subjects: {r.high_risk_count}"]
        out += [f"   Action: {r.recommendations[0]}"] * bool(r.recommendations)
    out += ["", "ISSUES"]
    for r in totals.orderBy("total", ascending=False).collect():  # ten issues
        priority, action, *_ = recommend.ACTIONS[r.issue_type]
        out += [f"* {label(r.issue_type)}: {r.total} instances", f"  Priority: {priority} | Action: {action}"]
    return "\n".join(out) + "\n"


def site_actions(site_recs: DataFrame, k: int = 50) -> str:
    """The k most urgent sites with their issues, root causes and actions."""
    out = _title("SITE-LEVEL ACTION REPORT")
    for i, r in enumerate(recommend.first_sites(site_recs, k).collect(), 1):
        out += [f"{i}. {r.study} - {r.site_id} ({r.country}, {r.region})", f"Priority: {r.priority}", f"Subjects: {r.subject_count} | High-risk: {r.high_risk_count}", f"Average DQI: {r.avg_dqi_score:.3f} | Max DQI: {r.max_dqi_score:.3f}"]
        for issue in r.issues[:5]:
            out += [f"  * {label(issue.type)}: {issue['count']} instances [{issue.priority}]", f"    Action: {issue.action}"]
        out += [f"  * {c}" for c in r.root_causes] + [f"  - {a}" for a in r.recommendations] + [""]
    return "\n".join(out) + "\n"


def root_cause_report(causes: DataFrame, pairs: DataFrame, geography: DataFrame, k: int = 10) -> str:
    """Root causes with evidence and actions, the k strongest pairs of issues and the k areas furthest from the portfolio."""
    out = _title("ROOT CAUSE ANALYSIS")
    for r in rootcause.by_severity(causes).collect():  # five rules
        out += [f"{r.cause_id} [{r.severity}] {r.description}", f"Confidence: {r.confidence:.0%} | Sites: {r.affected_sites} | Subjects: {r.affected_subjects}"]
        out += [f"  * {x}" for x in r.evidence] + [f"  - {x}" for x in r.recommended_actions] + [""]
    out += ["CO-OCCURRENCE"] + [f"* {r.interpretation} (lift {r.lift:.2f}, {r.cooccurrence_count} subjects)" for r in pairs.orderBy("lift", ascending=False).limit(k).collect()]
    far = geography.selectExpr("*", "abs(comparison_to_avg - 1) AS far").orderBy("far", ascending=False).limit(k).collect()
    out += ["", "GEOGRAPHY"] + [f"* {r.level} {r.location}: {label(r.dominant_issue)} at {r.issue_rate:.1%} of sites, {r.comparison_to_avg:.1f}x portfolio" for r in far]
    return "\n".join(out) + "\n"


def _grid(heads: list[str], rows: list[tuple]) -> list[str]:
    """A Markdown table; fractions with four decimals."""
    def cell(v) -> str:
        return "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|")

    return ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def _report(title: str, *parts: tuple[str, list[str], list[tuple]]) -> str:
    """A Markdown report of titled tables; an empty one says so."""
    out = [f"# {title}", ""]
    for name, heads, rows in parts:
        out += [f"## {name}", "", *(_grid(heads, rows) if rows else ["Nothing to report.", ""])]
    return "\n".join(out)


def _all(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*columns).collect()]


def index_report(distribution: DataFrame, checks: DataFrame, components: DataFrame, overrides: DataFrame) -> str:
    """The index: subjects by category, what it checks, its features, and subjects that only the safety rule makes High."""
    levels = _all(distribution, "category", "n")
    whole = sum(n for _, n in levels) or 1
    o = overrides.first()
    return _report(
        "Data quality index",
        ("Categories", ["Category", "Subjects", "Share"], [(c, n, f"{n / whole:.1%}") for c, n in levels]),
        ("Checks", ["Check", "Passed"], [(label(c), "yes" if p else "no") for c, p in _all(checks, "check_name", "passed")]),
        ("Features", ["Feature", "Tier", "Weight", "Subjects above 0", "Largest"], [(label(f), *r) for f, *r in _all(components.orderBy("weight", "feature", ascending=[False, True]), "feature", "tier", "weight", "n_positive", "max_raw")]),
        ("Safety rule", ["Subjects with pending reviews", "Raised by the rule alone"], [(o.sae_subjects, o.overridden)]),
    )


def anomaly_report(summary: DataFrame, scores: DataFrame, anomalies: DataFrame, k: int = 20) -> str:
    """Anomalies by severity and type, the k sites with the highest scores, and the critical ones."""
    counts = _all(summary.orderBy("n", "name", ascending=[False, True]), "kind", "name", "n")
    top = scores.orderBy("anomaly_score", "study", "site_id", ascending=[False, True, True]).limit(k)
    critical = anomalies.where("severity = 'CRITICAL'").orderBy("study", "site_id", "metric").limit(k)
    return _report(
        "Anomalies",
        ("By severity", ["Severity", "Anomalies"], [(n, v) for kind, n, v in counts if kind == "severity"]),
        ("By type", ["Type", "Anomalies"], [(label(n.lower()), v) for kind, n, v in counts if kind == "anomaly_type"]),
        ("Sites", ["Study", "Site", "Score", "Anomalies", "Most severe"], [(s, i, x, n, "critical" if c else "high" if h else "lower") for s, i, x, n, c, h in _all(top, "study", "site_id", "anomaly_score", "anomaly_count", "critical_count", "high_count")]),
        ("Critical", ["Study", "Site", "What"], _all(critical, "study", "site_id", "description")),
    )


def consensus_report(consensus: DataFrame, k: int = 20) -> str:
    """What the perspectives agree on: sites by priority, and the k that come first with what is wrong and what to do."""
    levels = consensus.groupBy("priority", "risk_category").count().orderBy("priority", "risk_category")
    first = consensus.orderBy("priority", "composite_score", "study", "site_id", ascending=[True, False, True, True]).limit(k)
    return _report(
        "Perspectives on sites",
        ("Priorities", ["Priority", "Category", "Sites"], _all(levels, "priority", "risk_category", "count")),
        ("First sites", ["Study", "Site", "Priority", "Score", "Escalate", "Issues", "Actions"], [(s, i, p, x, "yes" if e else "no", t, a) for s, i, p, x, e, t, a in _all(first, "study", "site_id", "priority", "composite_score", "escalation_required", "top_issues", "recommended_actions")]),
    )


def cluster_report(profiles: DataFrame, silhouette: float | None = None, criteria: DataFrame | None = None) -> str:
    """Clusters with their archetype and what marks them; the silhouette, and the criteria by which a mixture was chosen, if given."""
    word = None if silhouette is None else "excellent" if silhouette > 0.5 else "good" if silhouette > 0.25 else "fair" if silhouette > 0 else "poor"
    columns = ["cluster_id", "cluster_name", "risk_level", "intervention_priority", "site_count", "pct_of_total", "avg_dqi_score", "avg_high_risk_rate", "dominant_issues"]
    parts = [("Clusters", ["Cluster", "Archetype", "Level", "Priority", "Sites", "%", "Mean index", "High-risk rate", "Marked by"], _all(profiles.orderBy("intervention_priority", "cluster_id"), *columns))]
    parts += [("Separation", ["Silhouette", "Reading"], [(float(silhouette), word)])] if silhouette is not None else []
    parts += [("Mixtures", ["k", "Log likelihood", "BIC", "AIC", "Converged"], _all(criteria.orderBy("bic"), "k", "log_likelihood", "bic", "aic", "converged"))] if criteria is not None else []
    return _report("Clusters of sites", *parts)


def graph_report(counts: DataFrame, by_country: DataFrame, studies: DataFrame, k: int = 20) -> str:
    """The graph: nodes and edges by kind, high-risk subjects by country, and studies with their sites."""
    high = by_country.where("risk_category = 'High'").orderBy("n", "country", ascending=[False, True]).limit(k)
    return _report(
        "Entity graph",
        ("Size", ["Part", "Kind", "Number"], _all(counts.orderBy("what", "kind"), "what", "kind", "n")),
        ("High-risk subjects", ["Country", "Subjects"], _all(high, "country", "n")),
        ("Studies", ["Study", "Sites"], _all(studies.orderBy("site_count", "study", ascending=[False, True]).limit(k), "study", "site_count")),
    )


def validation_report(folds: DataFrame, stability: DataFrame, ranks: DataFrame, sensitivity: DataFrame) -> str:
    """Cross-validation and sensitivity: folds, spread of thresholds, agreement of site ranks, and weight scenarios."""
    return _report(
        "Validation of the index",
        ("Folds", ["Fold", "Subjects", "Threshold", "Agreement", "Safety capture"], _all(folds.orderBy("fold"), "fold", "test_size", "threshold", "agreement", "sae_capture")),
        ("Thresholds", ["Mean", "Deviation", "Variation", "Range"], _all(stability, "mean", "std", "cv", "range")),
        ("Site ranks", ["Fold", "Fold", "Common sites", "Correlation"], _all(ranks.orderBy("fold_a", "fold_b"), "fold_a", "fold_b", "common_sites", "correlation")),
        ("Weights", ["Scenario", "Shifts", "%", "Safety capture %", "Rank correlation"], _all(sensitivity.orderBy("category_shifts", "scenario"), "scenario", "category_shifts", "shift_pct", "sae_capture_pct", "rank_correlation")),
    )


def discovery_report(mapping: DataFrame, problems: DataFrame, k: int = 100) -> str:
    """Files by type, and what is missing or unknown."""
    kinds = mapping.groupBy("file_type").agg(F.count("*").alias("files"), F.count_distinct("study").alias("studies")).orderBy("file_type")
    return _report("Files", ("Types", ["Type", "Files", "Studies"], _all(kinds, "file_type", "files", "studies")), ("Problems", ["Problem", "Study", "Detail"], _all(problems.orderBy("issue", "study", "detail").limit(k), "issue", "study", "detail")))


def anomaly_summary(summary: DataFrame, scores: DataFrame, k: int = 10) -> dict:
    """The counts of the anomaly report and its k first sites, as one object for a JSON file."""
    counts = _all(summary, "kind", "name", "n")
    top = scores.orderBy("anomaly_score", "study", "site_id", ascending=[False, True, True]).limit(k)
    return {
        "total": sum(n for kind, _, n in counts if kind == "severity"),
        "sites": scores.where("is_anomaly").count(),
        "by_severity": {n.lower(): v for kind, n, v in counts if kind == "severity"},
        "by_type": {n.lower(): v for kind, n, v in counts if kind == "anomaly_type"},
        "top_sites": [r.asDict() for r in top.select("study", "site_id", "anomaly_score", "anomaly_count").collect()],
    }


def validation_summary(folds: DataFrame, stability: DataFrame, sensitivity: DataFrame) -> dict:
    """What the validation comes down to, as one object for a JSON file."""
    agreement = folds.agg(F.avg("agreement").alias("agreement"), F.min("sae_capture").alias("capture")).first()
    worst = sensitivity.orderBy("rank_correlation", "scenario").first()
    return {"folds": folds.count(), "agreement": agreement.agreement, "sae_capture": agreement.capture, "threshold_cv": stability.first().cv, "most_sensitive": {"scenario": worst.scenario, "rank_correlation": worst.rank_correlation, "shift_pct": worst.shift_pct}}
