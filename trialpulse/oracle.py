"""The queries as ANSI SQL over the driver's tables: common table expressions from the spine up."""

from __future__ import annotations

from . import config as C

W = {f: w for f, (w, _) in C.WEIGHTS.items()}
COUNTS = [c for c in C.ISSUE_COLUMNS if not c.startswith("max_days")]

CTES: dict[str, str] = {}

CTES["spine"] = """
SELECT c_mktsegment AS study, CAST(c_custkey AS VARCHAR) AS subject_id, 'S' || c_nationkey || '-' || (c_custkey % 2) AS site_id,
  n_name AS country, r_name AS region,
  CASE WHEN c_acctbal < 0 THEN 'Withdrawn' WHEN c_acctbal < 1000 THEN '' ELSE 'Enrolled' END AS subject_status,
  CAST(NULL AS VARCHAR) AS latest_visit
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""

CTES["keyed"] = "SELECT *, c_mktsegment AS study, CAST(o_custkey AS VARCHAR) AS subject_id FROM orders JOIN customer ON o_custkey = c_custkey"
CTES["lines"] = "SELECT * FROM keyed JOIN lineitem ON o_orderkey = l_orderkey"
_days = "CAST(date_diff('day', CAST({} AS DATE), CAST({} AS DATE)) AS DOUBLE)"
_clamp = "LEAST(GREATEST({}, 0.0), 1825.0)"
CTES["metric_rows"] = f"""
SELECT study, subject_id, 'missing_visit_count' AS metric, 1.0 AS value FROM keyed WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND month(o_orderdate) = 1
UNION ALL SELECT study, subject_id, 'max_days_outstanding', {_clamp.format(_days.format('o_orderdate', "'2001-08-01'"))} FROM keyed WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND month(o_orderdate) = 1
UNION ALL SELECT study, subject_id, 'sae_total_count', 1.0 FROM keyed WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) = 2
UNION ALL SELECT study, subject_id, 'sae_pending_count', 1.0 FROM keyed WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) = 2 AND o_orderstatus IS DISTINCT FROM 'F'
UNION ALL SELECT study, subject_id, 'lab_issues_count', 1.0 FROM lines WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_discount >= 0.09
UNION ALL SELECT study, subject_id, 'missing_pages_count', 1.0 FROM lines WHERE l_shipdate < o_orderdate AND l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity >= 48
UNION ALL SELECT study, subject_id, 'max_days_page_missing', {_clamp.format(_days.format('l_shipdate', 'o_orderdate'))} FROM lines WHERE l_shipdate < o_orderdate AND l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity >= 48
UNION ALL SELECT study, subject_id, 'uncoded_meddra_count', 1.0 FROM lines WHERE l_returnflag = 'A' AND l_quantity >= 49 AND l_tax >= 0.07
UNION ALL SELECT study, subject_id, 'uncoded_whodd_count', 1.0 FROM lines WHERE l_returnflag = 'N' AND l_quantity <= 2 AND l_tax >= 0.07
UNION ALL SELECT study, subject_id, 'inactivated_forms_count', 1.0 FROM lines WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity <= 1
UNION ALL SELECT study, subject_id, 'edrr_open_issues', CAST(CAST(trunc(l_quantity) AS BIGINT) % 4 AS DOUBLE) FROM lines WHERE l_returnflag = 'A' AND l_discount <= 0 AND l_tax <= 0"""
CTES["metrics"] = "SELECT study, subject_id, " + ", ".join(f"{'MAX' if c.startswith('max_days') else 'SUM'}(CASE WHEN metric = '{c}' THEN CAST(value AS DOUBLE) END) AS {c}" for c in C.ISSUE_COLUMNS) + " FROM metric_rows GROUP BY study, subject_id"
CTES["joined"] = "SELECT spine.*, " + ", ".join(f"m.{c}" for c in C.ISSUE_COLUMNS) + " FROM spine LEFT JOIN metrics m ON spine.study = m.study AND spine.subject_id = m.subject_id"
CTES["quartiles"] = "SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in C.CAPPED_COLUMNS) + " FROM joined"


def _capped(c: str) -> str:
    if c not in C.CAPPED_COLUMNS:
        return c
    q1, q3 = f"{c}_q1", f"{c}_q3"
    return f"CASE WHEN {q3} - {q1} > 0 THEN LEAST(GREATEST({c}, GREATEST(0.0, {q1} - 3.0 * ({q3} - {q1}))), {q3} + 3.0 * ({q3} - {q1})) ELSE {c} END"


CTES["capped"] = "SELECT joined.* REPLACE (" + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE {_capped(c)} END AS {c}" for c in C.CAPPED_COLUMNS) + ") FROM joined, quartiles"
_fill = "CASE WHEN {0} IS NULL OR trim({0}) IN ('', 'nan', 'None') THEN 'Unknown' ELSE trim({0}) END AS {0}"
CTES["master"] = (
    "SELECT study, subject_id, site_id, " + ", ".join(_fill.format(c) for c in ("country", "region", "subject_status")) + ", latest_visit, "
    + ", ".join(f"CAST(trunc(COALESCE({c}, 0.0)) AS BIGINT) AS {c}" for c in C.ISSUE_COLUMNS)
    + ", CAST(trunc(COALESCE(uncoded_meddra_count, 0.0)) AS BIGINT) + CAST(trunc(COALESCE(uncoded_whodd_count, 0.0)) AS BIGINT) AS total_uncoded_count FROM capped"
)
_there = " AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in C.SITE_KEYS)
CTES["typed"] = "SELECT *, CAST(" + " + ".join(f"({f} > 0)::INT" for f in C.SUMMED) + " AS BIGINT) AS n_issue_types FROM master"
CTES["refs"] = "SELECT " + ", ".join(
    f"CASE WHEN count(*) FILTER ({f} > 0) >= {C.MIN_FOR_P95} THEN quantile_cont(CASE WHEN {f} > 0 THEN CAST({f} AS DOUBLE) END, 0.95) ELSE COALESCE(MAX(CASE WHEN {f} > 0 THEN CAST({f} AS DOUBLE) END), 1.0) END AS {f}_ref" for f in W
) + " FROM typed"
_comp = {f: f"CAST({w} AS DOUBLE) * (CAST(0.5 AS DOUBLE) * CAST({f} > 0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * LEAST(GREATEST(CAST({f} AS DOUBLE) / {f}_ref, 0.0), 1.0))" for f, w in W.items()}
CTES["components"] = "SELECT typed.*, " + ", ".join(f"{e} AS {f}_component" for f, e in _comp.items()) + " FROM typed, refs"
CTES["scored"] = "SELECT *, round(LEAST(GREATEST(" + " + ".join(f"{f}_component" for f in W) + ", 0.0), 1.0), 10) AS dqi_score FROM components"
CTES["threshold"] = "SELECT CASE WHEN count(*) FILTER (n_issue_types > 0 AND sae_pending_count = 0) = 0 THEN CAST(0.2 AS DOUBLE) ELSE round(GREATEST(quantile_cont(CASE WHEN n_issue_types > 0 AND sae_pending_count = 0 THEN dqi_score END, 0.9), CAST(0.1 AS DOUBLE)), 10) END AS threshold FROM scored"
CTES["risk"] = "SELECT scored.*, threshold, CAST(n_issue_types > 0 AS INT) AS has_issues, CASE WHEN sae_pending_count > 0 THEN 'High' WHEN n_issue_types > 0 AND dqi_score >= threshold THEN 'High' WHEN n_issue_types > 0 THEN 'Medium' ELSE 'Low' END AS risk_category FROM scored, threshold"
_keys = ", ".join(C.SITE_KEYS)
CTES["site_metrics"] = (
    f"SELECT {_keys}, count(*) AS subject_count, round(avg(dqi_score), 10) AS avg_dqi_score, max(dqi_score) AS max_dqi_score, round(COALESCE(stddev_samp(dqi_score), 0.0), 10) AS std_dqi_score, "
    "CAST(sum(n_issue_types) AS BIGINT) AS total_issue_types, round(avg(n_issue_types), 10) AS avg_issue_types, count(*) FILTER (risk_category = 'High') AS high_risk_count, count(*) FILTER (risk_category = 'Medium') AS medium_risk_count, CAST(sum(has_issues) AS BIGINT) AS subjects_with_issues, "
    + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}_sum" for f in C.SUMMED) + f" FROM risk WHERE {_there} GROUP BY {_keys}"
)
_pos = "CASE WHEN avg_dqi_score > 0 THEN avg_dqi_score END"
CTES["site_cuts"] = f"SELECT CASE WHEN count({_pos}) = 0 THEN 0.10 ELSE round(GREATEST(quantile_cont({_pos}, 0.85), 0.05), 10) END AS hi, CASE WHEN count({_pos}) = 0 THEN 0.05 ELSE round(GREATEST(quantile_cont({_pos}, 0.5), 0.02), 10) END AS med FROM site_metrics"
CTES["site"] = "SELECT site_metrics.*, CASE WHEN avg_dqi_score >= hi THEN 'High' WHEN avg_dqi_score >= med THEN 'Medium' ELSE 'Low' END AS site_risk_category FROM site_metrics, site_cuts"


def _level(key: str, longest: str, more: str) -> str:
    return (
        f"SELECT *, round(high_risk_subjects / subject_count, 10) AS high_risk_rate, round(subjects_with_issues / subject_count, 10) AS issue_rate, round(high_risk_sites / site_count, 10) AS high_risk_site_rate FROM ("
        f"SELECT {key}, count(*) AS site_count, CAST(sum(subject_count) AS BIGINT) AS subject_count, round(avg(avg_dqi_score), 10) AS avg_dqi_score, max(avg_dqi_score) AS {longest}, round(COALESCE(stddev_samp(avg_dqi_score), 0.0), 10) AS std_dqi_score, "
        f"CAST(sum(high_risk_count) AS BIGINT) AS high_risk_subjects, CAST(sum(medium_risk_count) AS BIGINT) AS medium_risk_subjects, CAST(sum(subjects_with_issues) AS BIGINT) AS subjects_with_issues, {more}, count(*) FILTER (site_risk_category = 'High') AS high_risk_sites FROM site GROUP BY {key})"
    )


CTES["study_level"] = _level("study", "max_site_dqi_score", ", ".join(f"CAST(sum({f}_sum) AS BIGINT) AS {f}_sum_sum" for f in C.SUMMED if not f.startswith("max_days")))
CTES["study_cuts"] = f"SELECT CASE WHEN count({_pos}) = 0 THEN 0.10 ELSE round(quantile_cont({_pos}, 0.85), 10) END AS hi, CASE WHEN count({_pos}) = 0 THEN 0.05 ELSE round(quantile_cont({_pos}, 0.5), 10) END AS med FROM study_level"
CTES["study_dqi"] = "SELECT study_level.*, CASE WHEN avg_dqi_score >= hi OR high_risk_rate > 0.15 OR high_risk_site_rate > 0.20 THEN 'High' WHEN avg_dqi_score >= med OR high_risk_rate > 0.05 THEN 'Medium' ELSE 'Low' END AS study_risk_category FROM study_level, study_cuts"
for _n, _k, _more, _p in (("region", "region", "count(DISTINCT study) AS study_count, count(DISTINCT country) AS country_count", 0.75), ("country", "country", "count(DISTINCT study) AS study_count, arg_min(region, (study, site_id, region)) AS region", 0.80)):
    CTES[f"{_n}_level"] = _level(_k, "max_dqi_score", _more)
    CTES[f"{_n}_cuts"] = f"SELECT round(quantile_cont(avg_dqi_score, {_p}), 10) AS hi, round(quantile_cont(avg_dqi_score, 0.5), 10) AS med FROM {_n}_level"
    CTES[f"{_n}_dqi"] = f"SELECT {_n}_level.*, CASE WHEN avg_dqi_score >= hi THEN 'High' WHEN avg_dqi_score >= med THEN 'Medium' ELSE 'Low' END AS {_n}_risk_category FROM {_n}_level, {_n}_cuts"


def _label(metric: str) -> str:
    return metric.replace("_sum", "").replace("_count", "").replace("_", " ").title()


_none = "CAST(NULL AS DOUBLE)"
CTES["a_long"] = " UNION ALL ".join(
    f"SELECT {_keys}, '{m}' AS metric, '{_label(m)}' AS name, CAST({m} AS DOUBLE) AS x, avg(CAST({m} AS DOUBLE)) OVER () AS mean, stddev_samp(CAST({m} AS DOUBLE)) OVER () AS std FROM site" for m in C.OUTLIER_METRICS
)
CTES["a_z"] = "SELECT *, CASE WHEN COALESCE(std, 0) = 0 THEN 0.0 ELSE round((x - mean) / std, 10) END AS z FROM a_long"
CTES["a_statistical"] = (
    "SELECT 'STATISTICAL_OUTLIER' AS anomaly_type, 'Z-Score' AS detection_method, 'site' AS level, study, site_id, country, region, metric, CASE WHEN z >= 5 THEN 'CRITICAL' WHEN z >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    "name || ' is above average: ' || CAST(x AS BIGINT) AS description, x AS value, round(z, 2) AS zscore FROM a_z WHERE z >= 3"
)
_tot5 = "(sae_pending_count_sum + missing_visit_count_sum + missing_pages_count_sum + lab_issues_count_sum + inactivated_forms_count_sum)"
_kinds = [("SAE Pending", "sae_pending_count_sum"), ("Missing Visits", "missing_visit_count_sum"), ("Missing Pages", "missing_pages_count_sum"), ("Lab Issues", "lab_issues_count_sum"), ("Inactivated Forms", "inactivated_forms_count_sum")]
CTES["a_dominant"] = "SELECT *, CASE " + " ".join(f"WHEN {c} / GREATEST({_tot5}, 1) >= 0.75 THEN '{k}'" for k, c in _kinds) + " END AS dominant FROM site"
_stale = "missing_visit_count_sum + missing_pages_count_sum"
_patterns = [
    ("sae_pending_count_sum >= 3 AND site_risk_category <> 'High'", "SAE_NOT_FLAGGED", "CRITICAL", "sae_pending_count_sum || ' pending SAE reviews, site not High'"),
    ("subject_count >= 30 AND avg_dqi_score = 0", "ZERO_ISSUES_HIGH_VOLUME", "MEDIUM", "subject_count || ' subjects without issues'"),
    (f"{_stale} >= 5 AND GREATEST(max_days_outstanding_sum, max_days_page_missing_sum) >= 45", "STALE_MISSING_DATA", "HIGH", f"({_stale}) || ' missing items, ' || GREATEST(max_days_outstanding_sum, max_days_page_missing_sum) || ' days'"),
    ("subject_count >= 10 AND high_risk_count * 100 / subject_count >= 40", "MAJORITY_HIGH_RISK", "HIGH", "high_risk_count || ' of ' || subject_count || ' subjects High'"),
    (f"{_tot5} >= 15 AND dominant IS NOT NULL", "SINGLE_ISSUE_DOMINANCE", "MEDIUM", "dominant || ' dominates'"),
    ("sae_pending_count_sum >= 5 AND uncoded_meddra_count_sum = 0", "SAE_WITHOUT_CODING", "MEDIUM", "sae_pending_count_sum || ' pending SAE, no uncoded terms'"),
]
CTES["a_pattern"] = " UNION ALL ".join(
    f"SELECT 'PATTERN_ANOMALY' AS anomaly_type, '{n}' AS detection_method, 'site' AS level, study, site_id, country, region, '{n}' AS metric, '{sev}' AS severity, {text} AS description, {_none} AS value, {_none} AS zscore FROM a_dominant WHERE {w}" for w, n, sev, text in _patterns
)
CTES["a_portfolio"] = "SELECT avg(avg_dqi_score) AS dm, stddev_samp(avg_dqi_score) AS ds, avg(high_risk_count / GREATEST(subject_count, 1)) AS rm, stddev_samp(high_risk_count / GREATEST(subject_count, 1)) AS rs FROM site"
CTES["a_country"] = "SELECT country_dqi.*, CASE WHEN COALESCE(ds, 0) = 0 THEN 0.0 ELSE round((avg_dqi_score - dm) / ds, 10) END AS dz, CASE WHEN COALESCE(rs, 0) = 0 THEN 0.0 ELSE round((high_risk_rate - rm) / rs, 10) END AS rz FROM country_dqi, a_portfolio WHERE site_count >= 3"
CTES["a_region"] = "SELECT *, avg(avg_dqi_score) OVER () AS m, stddev_samp(avg_dqi_score) OVER () AS sd, count(*) OVER () AS n FROM region_dqi WHERE site_count >= 5"
CTES["a_region_z"] = "SELECT *, CASE WHEN COALESCE(sd, 0) = 0 THEN 0.0 ELSE round((avg_dqi_score - m) / sd, 10) END AS z FROM a_region WHERE n >= 2"
CTES["a_regional"] = f"""
SELECT 'REGIONAL_ANOMALY' AS anomaly_type, 'COUNTRY_HIGH_DQI' AS detection_method, 'country' AS level, 'Portfolio' AS study, country || ' (' || site_count || ' sites)' AS site_id, country, region, 'country_avg_dqi' AS metric, CASE WHEN dz >= 2.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, country || ' average index above portfolio' AS description, round(avg_dqi_score, 4) AS value, round(dz, 2) AS zscore FROM a_country WHERE dz >= 1.5
UNION ALL SELECT 'REGIONAL_ANOMALY', 'COUNTRY_HIGH_RISK_RATE', 'country', 'Portfolio', country || ' (' || site_count || ' sites)', country, region, 'high_risk_rate', 'HIGH', country || ' high-risk subject rate', round(high_risk_rate, 4), round(rz, 2) FROM a_country WHERE high_risk_rate >= 0.25
UNION ALL SELECT 'REGIONAL_ANOMALY', 'REGION_COMPARISON', 'region', 'Portfolio', region || ' (' || site_count || ' sites)', 'Multiple', region, 'region_avg_dqi', CASE WHEN z > 0 THEN 'HIGH' ELSE 'MEDIUM' END, region || ' index ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' other regions', round(avg_dqi_score, 4), round(z, 2) FROM a_region_z WHERE abs(z) >= 1"""
# the same from site rows alone
_of_sites = "count(*) AS site_count, avg(avg_dqi_score) AS avg_dqi_score, avg(high_risk_count / GREATEST(subject_count, 1)) AS high_risk_rate FROM site GROUP BY"
CTES["s_countries"] = f"SELECT country, region, {_of_sites} country, region"
CTES["s_regions"] = f"SELECT region, {_of_sites} region"
CTES["s_country"] = CTES["a_country"].replace("country_dqi", "s_countries")
CTES["s_region"] = CTES["a_region"].replace("region_dqi", "s_regions")
CTES["s_region_z"] = CTES["a_region_z"].replace("a_region", "s_region")
CTES["s_regional"] = CTES["a_regional"].replace("FROM a_", "FROM s_")
CTES["a_multi"] = """SELECT site_id, round(avg(avg_dqi_score), 10) AS avg_dqi_score, count(*) AS n, count(*) FILTER (site_risk_category = 'High') AS n_high, string_agg(study, ', ' ORDER BY study, country, region, site_risk_category) AS study,
COALESCE(string_agg(study, ', ' ORDER BY study, country, region) FILTER (site_risk_category = 'High'), '') AS high_in, arg_min(country, (study, country, region)) AS country, arg_min(region, (study, country, region)) AS region FROM site GROUP BY site_id HAVING count(*) >= 2"""
CTES["a_cross"] = f"""
SELECT 'CROSS_STUDY_ANOMALY' AS anomaly_type, 'REPEAT_OFFENDER' AS detection_method, 'site' AS level, study, site_id, country, region, 'cross_study_high_risk' AS metric, CASE WHEN n_high = n THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'High in ' || n_high || '/' || n || ' studies: ' || high_in AS description, CAST(n_high AS DOUBLE) AS value, {_none} AS zscore FROM a_multi WHERE n_high / n >= 0.4
UNION ALL SELECT 'CROSS_STUDY_ANOMALY', 'ELEVATED_DQI_MULTI_STUDY', 'site', study, site_id, country, region, 'avg_dqi_across_studies', 'MEDIUM', 'Raised index across ' || n || ' studies', round(avg_dqi_score, 3), {_none} FROM a_multi WHERE avg_dqi_score >= 0.2 AND n_high / n < 0.4"""
CTES["a_total"] = "SELECT *, " + " + ".join(f"{f}_sum" for f in C.SUMMED) + " AS total FROM site"
CTES["a_dens"] = "SELECT *, total / GREATEST(subject_count, 1) AS density, avg(total / GREATEST(subject_count, 1)) OVER () AS m, stddev_samp(total / GREATEST(subject_count, 1)) OVER () AS sd, CAST(sum(total) OVER (PARTITION BY study) AS BIGINT) AS study_total FROM a_total"
CTES["a_dens_z"] = "SELECT *, CASE WHEN COALESCE(sd, 0) = 0 THEN 0.0 ELSE round((density - m) / sd, 10) END AS z FROM a_dens"
def dense(least: float = 2.5, high: float = 3.5, subjects: int = 5) -> str:
    return f"SELECT 'VELOCITY_ANOMALY' AS anomaly_type, 'HIGH_ISSUE_DENSITY' AS detection_method, 'site' AS level, study, site_id, country, region, 'issue_density' AS metric, CASE WHEN z >= {high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, total || ' issues of ' || subject_count || ' subjects' AS description, round(density, 2) AS value, round(z, 2) AS zscore FROM a_dens_z WHERE z >= {least} AND subject_count >= {subjects}"


CTES["a_density"] = dense()


def concentrated(least: int, share: float) -> str:
    return f"SELECT 'VELOCITY_ANOMALY' AS anomaly_type, 'STUDY_CONCENTRATION' AS detection_method, 'site' AS level, study, site_id, country, region, 'study_issue_pct' AS metric, 'HIGH' AS severity, total || ' of ' || study_total || ' issues' AS description, round(total / study_total, 3) AS value, {_none} AS zscore FROM a_dens_z WHERE study_total >= {least} AND total / study_total >= {share}"


CTES["a_concentration"] = concentrated(50, 0.5)
CTES["anomalies"] = " UNION ALL ".join(f"SELECT * FROM {k}" for k in ("a_statistical", "a_pattern", "a_regional", "a_cross", "a_density", "a_concentration"))
CTES["a_ranked"] = "SELECT *, row_number() OVER (PARTITION BY study, site_id ORDER BY anomaly_type, detection_method, metric, description) AS rn, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS weight FROM anomalies WHERE level = 'site'"
CTES["a_scores"] = """SELECT study, site_id, count(*) AS anomaly_count, count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count, count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'LOW') AS low_count,
COALESCE(string_agg(substring(description, 1, 100), '; ' ORDER BY rn) FILTER (rn <= 3), '') AS top_anomalies, string_agg(DISTINCT anomaly_type, ', ' ORDER BY anomaly_type) AS anomaly_types, count(DISTINCT anomaly_type) AS type_diversity,
round(round(sum(weight) / (count(*) * 4) * (1 + CAST(0.1 AS DOUBLE) * count(DISTINCT anomaly_type)), 10), 3) AS anomaly_score FROM a_ranked GROUP BY study, site_id"""
CTES["site_scores"] = "SELECT *, anomaly_score > 0 AS is_anomaly FROM a_scores"



def _join_texts(*pairs: tuple[str, str]) -> str:
    """Texts whose condition holds, joined as concat_ws does."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs) + ")"


def _issues(columns: list[tuple[str, str]], by_priority: bool) -> str:
    from .operators.recommend import ACTIONS, ORDER

    kinds = [(ORDER[ACTIONS[k][0]] if by_priority else 0, i, k, c) for i, (k, c) in enumerate(columns)]
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} > 0 THEN '{k}=' || {c} END" for _, _, k, c in sorted(kinds)) + ")"


def _first(columns: list[tuple[str, str]], by_priority: bool, what: str = "type") -> str:
    from .operators.recommend import ACTIONS, ORDER

    kinds = [(ORDER[ACTIONS[k][0]] if by_priority else 0, i, k, c) for i, (k, c) in enumerate(columns)]
    return "CASE " + " ".join(f"WHEN {c} > 0 THEN '{k if what == 'type' else ACTIONS[k][0]}'" for _, _, k, c in sorted(kinds)) + " END"


def _first_text(*pairs: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in pairs) + " END"


def _recommendations() -> dict[str, str]:
    from .operators.recommend import ACTIONS, SITE_ISSUES

    subject = [(k, k) for k in ACTIONS]
    site = [(k, f"{k}_sum") for k in SITE_ISSUES]
    out = {}
    out["rec_subjects"] = f"SELECT study, site_id, subject_id, country, round(dqi_score, 3) AS dqi_score, risk_category, {_issues(subject, True)} AS issues, COALESCE({_first(subject, True, 'priority')}, 'LOW') AS priority, {_first(subject, True)} AS first_issues FROM risk WHERE risk_category = 'High'"
    causes = [("avg_issue_types > 3", "'several issue types: training gaps'"), ("max_days_outstanding_sum > 100", "'data entry backlog'"), ("missing_visit_count_sum > 5", "'visits missed against protocol'"), ("sae_pending_count_sum > 0", "'safety reporting delays'")]
    todo = [("site_risk_category = 'High'", "'quality call within 48 hours'"), ("site_risk_category = 'High'", "'triggered monitoring visit'"), ("high_risk_count > subject_count * 0.2", "'review training records'"), ("subjects_with_issues / GREATEST(subject_count, 1) > 0.5", "'enhanced oversight'")]
    out["rec_sites"] = f"SELECT study, site_id, country, region, subject_count, round(avg_dqi_score, 3) AS avg_dqi_score, round(max_dqi_score, 3) AS max_dqi_score, high_risk_count, site_risk_category, {_issues(site, False)} AS issues, {_first(site, False)} AS first_issues, {_join_texts(*causes)} AS root_causes, {_first_text(*causes)} AS first_root_causes, {_join_texts(*todo)} AS recommendations, {_first_text(*todo)} AS first_recommendations, CASE WHEN sae_pending_count_sum > 0 THEN 'CRITICAL' WHEN site_risk_category = 'High' THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM site WHERE site_risk_category = 'High' OR avg_dqi_score > 0.2"
    out["rec_study_base"] = "SELECT study, count(*) AS n_sites, CAST(sum(subject_count) AS BIGINT) AS n_subjects, round(avg(avg_dqi_score), 10) AS avg_dqi, CAST(sum(high_risk_count) AS BIGINT) AS total_high_risk, CAST(sum(sae_pending_count_sum) AS BIGINT) AS pending_sae, CAST(sum(missing_visit_count_sum) AS BIGINT) AS missing_visits, CAST(sum(uncoded_meddra_count_sum) AS BIGINT) AS uncoded_ae FROM site GROUP BY study"
    t = [("pending_sae > 0", "pending_sae || ' pending SAE reviews'"), ("pending_sae <= 0 AND total_high_risk > n_subjects * 0.1", "'high-risk subject rate above threshold'"), ("missing_visits > 10", "missing_visits || ' missing visits'"), ("uncoded_ae > 5", "uncoded_ae || ' uncoded terms'")]
    out["rec_studies"] = f"SELECT * REPLACE (round(avg_dqi, 3) AS avg_dqi), CASE WHEN pending_sae > 0 THEN 'CRITICAL' WHEN total_high_risk > n_subjects * 0.1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, {_join_texts(*t)} AS recommendations, {_first_text(*t)} AS first_recommendations FROM rec_study_base"
    for name, keys in (("region", "region"), ("country", "country, region")):
        out[f"rec_{name}_base"] = f"SELECT *, round(high_risk_subjects / n_subjects * 100, 10) AS high_risk_rate, round(high_risk_sites / n_sites * 100, 10) AS high_risk_site_rate, (SELECT round(avg(avg_dqi_score), 10) FROM site) AS pdqi FROM (SELECT {keys}, count(*) AS n_sites, CAST(sum(subject_count) AS BIGINT) AS n_subjects, round(avg(avg_dqi_score), 10) AS avg_dqi, round(COALESCE(stddev_samp(avg_dqi_score), 0.0), 10) AS std_dqi, CAST(sum(high_risk_count) AS BIGINT) AS high_risk_subjects, CAST(sum(sae_pending_count_sum) AS BIGINT) AS pending_sae, CAST(sum(missing_visit_count_sum) AS BIGINT) AS missing_visits, count(DISTINCT study) AS n_studies, count(*) FILTER (site_risk_category = 'High') AS high_risk_sites FROM site GROUP BY {keys})"
    out["rec_region_diff"] = "SELECT *, round(CASE WHEN pdqi > 0 THEN (avg_dqi / pdqi - 1) * 100 ELSE 0.0 END, 10) AS dqi_diff FROM rec_region_base"
    high = "(high_risk_rate > 15 OR dqi_diff > 20)"
    t = [("pending_sae > 10", "pending_sae || ' pending SAE reviews'"), (f"pending_sae <= 10 AND {high}", "'risk rate above portfolio'"), ("high_risk_site_rate > 20", "'many high-risk sites'"), ("missing_visits > 50", "missing_visits || ' missing visits'"), ("std_dqi > 0.1", "'sites differ much in quality'")]
    out["rec_regions"] = f"SELECT region, n_sites, n_subjects, n_studies, round(avg_dqi, 4) AS avg_dqi, pending_sae, missing_visits, round(high_risk_rate, 1) AS high_risk_rate, round(dqi_diff, 1) AS dqi_vs_portfolio, dqi_diff > 10 AS is_above_average, CASE WHEN pending_sae > 10 THEN 'CRITICAL' WHEN {high} THEN 'HIGH' WHEN high_risk_rate > 10 OR dqi_diff > 10 THEN 'MEDIUM' ELSE 'LOW' END AS priority, COALESCE(NULLIF({_join_texts(*t)}, ''), 'within acceptable range') AS recommendations, COALESCE({_first_text(*t)}, 'within acceptable range') AS first_recommendations FROM rec_region_diff"
    t = [("pending_sae > 5", "pending_sae || ' pending SAE reviews'"), ("high_risk_site_rate > 30", "'many high-risk sites'"), ("avg_dqi > pdqi * 1.5", "'index far above portfolio'"), ("missing_visits > 20", "missing_visits || ' missing visits'")]
    out["rec_countries"] = f"SELECT country, region, n_sites, n_subjects, n_studies, round(avg_dqi, 4) AS avg_dqi, round(high_risk_rate, 1) AS high_risk_rate, high_risk_sites, pending_sae, missing_visits, CASE WHEN pending_sae > 5 THEN 'CRITICAL' WHEN high_risk_rate > 20 OR high_risk_site_rate > 30 THEN 'HIGH' WHEN high_risk_rate > 10 THEN 'MEDIUM' ELSE 'LOW' END AS priority, {_join_texts(*t)} AS recommendations, {_first_text(*t)} AS first_recommendations FROM rec_country_base WHERE n_sites >= 2 AND (avg_dqi > pdqi * 1.2 OR high_risk_rate > 15 OR pending_sae > 5 OR high_risk_site_rate > 25)"
    return out


CTES |= _recommendations()


def _level_of(x: str) -> str:
    return f"CASE WHEN {x} >= 0.8 THEN 'Critical' WHEN {x} >= 0.6 THEN 'High' WHEN {x} >= 0.4 THEN 'Medium' ELSE 'Low' END"


def _list(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


def _perspectives() -> dict[str, str]:
    out = {}
    out["agent_context"] = "SELECT round(avg(avg_dqi_score), 10) AS portfolio_dqi, round(avg(subject_count), 10) AS portfolio_subjects, round(avg(sae_pending_count_sum), 10) AS portfolio_sae, round(sum(high_risk_count) / sum(subject_count), 10) AS portfolio_high_rate FROM site"
    out["enriched"] = """SELECT site.*, COALESCE(s.anomaly_score, 0.0) AS anomaly_score, COALESCE(s.is_anomaly, false) AS is_anomaly, COALESCE(st.study_risk_category, 'Unknown') AS study_risk_category, COALESCE(co.country_risk_category, 'Unknown') AS country_risk_category, agent_context.*
FROM site LEFT JOIN site_scores s ON site.study = s.study AND site.site_id = s.site_id LEFT JOIN study_dqi st ON site.study = st.study LEFT JOIN country_dqi co ON site.country = co.country, agent_context"""
    out["agent_candidates"] = "SELECT study, site_id, country, region, round(CAST(0.4 AS DOUBLE) * anomaly_score + CAST(0.4 AS DOUBLE) * COALESCE(avg_dqi_score / NULLIF((SELECT max(avg_dqi_score) FROM site), 0), 0.0) + CAST(0.2 AS DOUBLE) * COALESCE(high_risk_count / NULLIF((SELECT max(high_risk_count) FROM site), 0), 0.0), 10) AS rank_score FROM enriched"
    sae, meddra, whodd = "sae_pending_count_sum", "uncoded_meddra_count_sum", "uncoded_whodd_count_sum"
    visits, pages, labs, edrr, days, forms = (f"{c}_sum" for c in ("missing_visit_count", "missing_pages_count", "lab_issues_count", "edrr_open_issues", "max_days_page_missing", "inactivated_forms_count"))

    def d(x: float) -> str:
        return f"CAST({x} AS DOUBLE)"

    n = "GREATEST(subject_count, 1)"
    rate = f"(high_risk_count / {n})"
    score = {
        "safety": f"LEAST({d(0.5)}, {sae} * {d(0.1)}) + LEAST({d(0.3)}, {meddra} * {d(0.05)}) + LEAST({d(0.2)}, {whodd} * {d(0.02)})",
        "quality": f"LEAST({d(0.3)}, {visits} / {n} * {d(0.5)}) + LEAST({d(0.3)}, {pages} / {n} * {d(0.3)}) + LEAST({d(0.2)}, {labs} / {n} * {d(0.3)}) + LEAST({d(0.1)}, {edrr} / {n} * {d(0.2)}) + CASE WHEN {days} > 30 THEN {d(0.1)} ELSE {d(0.0)} END",
        "performance": f"LEAST({d(0.4)}, avg_dqi_score) + CASE WHEN {rate} > {d(0.1)} THEN LEAST({d(0.3)}, {rate}) ELSE {d(0.0)} END + CASE WHEN is_anomaly THEN {d(0.2)} ELSE {d(0.0)} END + CASE WHEN site_risk_category = 'High' THEN {d(0.1)} ELSE {d(0.0)} END",
    }
    late = f"{pages} > 0 AND {days} > 30"
    above = f"portfolio_dqi > 0 AND avg_dqi_score > portfolio_dqi * {d(1.5)}"
    far = f"{rate} > {d(0.2)} AND {rate} > portfolio_high_rate * 2 AND portfolio_high_rate > 0"
    both = "site_risk_category = 'High' AND study_risk_category = 'High'"
    findings = {
        "safety": _list((f"{sae} > 0", f"'pending SAE reviews: ' || {sae}"), (f"{meddra} > 0", f"'uncoded adverse events: ' || {meddra}"), (f"{whodd} > 0", f"'uncoded drug terms: ' || {whodd}"), (f"{sae} > portfolio_sae * 2 AND portfolio_sae > 0", "'SAE far above portfolio'")),
        "quality": _list((f"{visits} > 0", f"'missing visits: ' || {visits}"), (f"{pages} > 0", f"'missing pages: ' || {pages}"), (late, f"'page days: ' || {days}"), (f"{labs} > 0", f"'lab issues: ' || {labs}"), (f"{edrr} > 0", f"'reconciliation issues: ' || {edrr}"), (f"{forms} > 5", f"'inactivated forms: ' || {forms}")),
        "performance": _list((above, "'index above portfolio'"), (f"{rate} > {d(0.2)}", "'high-risk subject rate'"), (far, "'rate far above portfolio'"), (both, "'site and study high-risk'"), ("country_risk_category = 'High'", "'high-risk country: ' || country"), ("is_anomaly", "'flagged as anomaly'")),
    }
    actions = {
        "safety": _list((f"{sae} > 0", "'Immediate SAE review'"), (f"{sae} >= 5", "'Escalate to safety officer'"), (f"{meddra} > 0", "'Code MedDRA terms'"), (f"{whodd} > 0", "'Code drug terms'")),
        "quality": _list((f"{visits} >= 10", "'Urgent visit documentation'"), (f"{visits} > 0 AND {visits} < 10", "'Schedule visit entry'"), (late, "'Urgent: old missing pages'"), (f"{labs} > 0", "'Resolve lab discrepancies'"), (f"{edrr} > 0", "'Reconcile external data'"), (f"{forms} > 5", "'Review form inactivation'")),
        "performance": _list((above, "'Investigate systemic issues'"), (far, "'Root cause analysis'"), (both, "'Coordinate with study team'"), ("is_anomaly", "'Review anomalies'")),
    }
    out["views"] = "SELECT *, " + ", ".join(f"round(LEAST({score[k]}, {d(1.0)}), 10) AS {k}, {findings[k]} AS {k}_findings, {actions[k]} AS {k}_actions" for k in score) + " FROM enriched"
    out["levels"] = "SELECT *, LEAST(" + ", ".join(f"CASE WHEN {k} >= 0.8 THEN 0 WHEN {k} >= 0.6 THEN 1 WHEN {k} >= 0.4 THEN 2 ELSE 3 END" for k in score) + ") AS worst, list_concat(list_concat(safety_actions, quality_actions), performance_actions) AS acts, list_concat(list_concat(safety_findings, quality_findings), performance_findings) AS finds FROM views"
    urgent = "regexp_matches(x, 'sae|safety|urgent|immediate|escalate|meddra', 'i')"
    out["agent_out"] = f"""SELECT study, site_id, country, region, CASE WHEN worst = 0 THEN 1 WHEN worst = 1 AND safety >= 0.5 THEN 2 WHEN worst = 1 THEN 3 WHEN worst = 2 THEN 4 ELSE 5 END AS priority, ['Critical', 'High', 'Medium', 'Low'][worst + 1] AS risk_category,
round(round(safety * {d(0.4)} + quality * {d(0.35)} + performance * {d(0.25)}, 10) + 1e-12, 4) AS composite_score, round(safety + 1e-12, 4) AS safety_score, round(quality + 1e-12, 4) AS quality_score, round(performance + 1e-12, 4) AS performance_score, array_to_string(finds[1:5], '; ') AS top_issues,
array_to_string(list_concat(list_filter(acts, lambda x: {urgent}), list_filter(acts, lambda x: NOT {urgent}))[1:5], '; ') AS recommended_actions,
COALESCE(NULLIF(concat_ws('; ', CASE WHEN safety > 0.5 THEN 'safety concerns' END, CASE WHEN quality > 0.5 THEN 'data quality concerns' END, CASE WHEN performance > 0.5 THEN 'performance below standard' END), ''), 'within acceptable parameters') AS agent_consensus,
worst = 0 OR safety >= 0.7 OR (worst = 1 AND safety >= 0.5) AS escalation_required FROM levels"""
    return out


CTES |= _perspectives()


def _root_causes() -> dict[str, str]:
    from itertools import combinations

    out = {}
    pairs = list(combinations(C.SUMMED, 2))
    out["pair_counts"] = " UNION ALL ".join(f"SELECT '{a}' AS issue_a, '{b}' AS issue_b, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({a} > 0) AS DOUBLE) AS a, CAST(count(*) FILTER ({b} > 0) AS DOUBLE) AS b, CAST(count(*) FILTER ({a} > 0 AND {b} > 0) AS DOUBLE) AS ab FROM risk" for a, b in pairs)
    out["cooc"] = "SELECT issue_a, issue_b, CAST(ab AS BIGINT) AS cooccurrence_count, round(round(ab / n, 10), 4) AS cooccurrence_rate, round(round(CASE WHEN a > 0 AND b > 0 THEN ab * n / (a * b) ELSE 0.0 END, 10), 3) AS lift, round(round(CASE WHEN a > 0 AND b > 0 AND a * (n - a) * b * (n - b) > 0 THEN (n * ab - a * b) / sqrt(a * (n - a) * b * (n - b)) ELSE 0.0 END, 10), 3) AS correlation FROM pair_counts"
    parts = []
    for key, least, low, high in (("country", 3, 0.7, 1.3), ("region", 5, 0.8, 1.2)):
        cols = [f"{c}_sum" for c in C.SUMMED]
        out[f"geo_{key}_w"] = f"SELECT {key} AS location, count(*) AS site_count, " + ", ".join(f"round(avg(CAST({c} > 0 AS DOUBLE)), 10) AS r{i}" for i, c in enumerate(cols)) + f" FROM site GROUP BY {key} HAVING count(*) >= {least}"
        out[f"geo_{key}_p"] = "SELECT " + ", ".join(f"avg(CAST({c} > 0 AS DOUBLE)) AS p{i}" for i, c in enumerate(cols)) + " FROM site"
        best = "GREATEST(" + ", ".join(f"r{i}" for i in range(len(cols))) + ")"
        out[f"geo_{key}_d"] = f"SELECT location, site_count, {best} AS rate, CASE " + " ".join(f"WHEN r{i} = {best} THEN {i}" for i in range(len(cols))) + f" END AS k, p.* FROM geo_{key}_w, geo_{key}_p p"
        out[f"geo_{key}_r"] = "SELECT *, CASE k " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cols)) + " END AS issue, CASE k " + " ".join(f"WHEN {i} THEN p{i}" for i in range(len(cols))) + f" END AS base FROM geo_{key}_d"
        out[f"geo_{key}_x"] = f"SELECT *, round(CASE WHEN base > 0 THEN rate / base ELSE 1.0 END, 10) AS ratio FROM geo_{key}_r"
        parts.append(f"SELECT '{key.title()}' AS level, location, issue AS dominant_issue, round(rate, 4) AS issue_rate, round(ratio, 2) AS comparison_to_avg, geo_{key}_x.site_count, {key}_risk_category AS risk_category FROM geo_{key}_x JOIN {key}_dqi ON location = {key}_dqi.{key} WHERE ratio > {high} OR ratio < {low}")
    out["geo"] = " UNION ALL ".join(parts)
    out["size_edges"] = "SELECT quantile_cont(CAST(subject_count AS DOUBLE), 0.25) AS e1, quantile_cont(CAST(subject_count AS DOUBLE), 0.5) AS e2, quantile_cont(CAST(subject_count AS DOUBLE), 0.75) AS e3 FROM site"
    out["kinds"] = "SELECT *, " + " + ".join(f"CAST({c}_sum > 0 AS INT)" for c in C.SUMMED) + " AS k FROM site"
    share = "round(avg(CAST(site_risk_category = 'High' AS DOUBLE)), 10) AS high_risk_rate"
    base = "count(*) AS site_count, round(avg(avg_dqi_score), 10) AS avg_dqi_score"
    m4 = "printf('%.4f', round(avg_dqi_score, 4))"
    out["f_size"] = f"SELECT *, CASE category WHEN 'Small' THEN 'Small sites (avg DQI: ' || {m4} || ') may lack dedicated data management resources' WHEN 'Very Large' THEN 'Very large sites (avg DQI: ' || {m4} || ') handle high volume but may have process efficiencies' ELSE category || ' sites have average DQI of ' || {m4} END AS interpretation FROM (SELECT 'Site Size' AS factor, CASE WHEN subject_count <= e1 THEN 'Small' WHEN subject_count <= e2 THEN 'Medium' WHEN subject_count <= e3 THEN 'Large' ELSE 'Very Large' END AS category, {base}, {share} FROM site, size_edges GROUP BY 2)"
    out["f_study"] = f"SELECT *, 'Study ' || category || ' has ' || site_count || ' sites with avg DQI ' || {m4} AS interpretation FROM (SELECT 'Study' AS factor, study AS category, {base}, round(sum(high_risk_count) / GREATEST(sum(subject_count), 1), 10) AS high_risk_rate FROM site GROUP BY study)"
    pct = "printf('%.1f', round(round({} * 100, 10), 1)) || '%'"
    out["f_region"] = f"SELECT *, deviation AS high_risk_rate, category || ': ' || CASE WHEN deviation > 0 THEN 'Above' ELSE 'Below' END || ' portfolio average by ' || {pct.format('abs(deviation)')} AS interpretation FROM (SELECT 'Region' AS factor, region AS category, {base}, round(CASE WHEN any_value(m) > 0 THEN (avg(avg_dqi_score) - any_value(m)) / any_value(m) ELSE 0.0 END, 10) AS deviation FROM site, (SELECT avg(avg_dqi_score) AS m FROM site) GROUP BY region)"
    out["f_complexity"] = f"SELECT *, CASE category WHEN 'None' THEN site_count || ' sites have no active issues - potential best practice sources' WHEN 'High' THEN site_count || ' sites have multiple concurrent issues requiring systemic intervention' ELSE site_count || ' sites with ' || lower(category) || ' issue complexity' END AS interpretation FROM (SELECT 'Issue Complexity' AS factor, CASE WHEN k = 0 THEN 'None' WHEN k <= 2 THEN 'Low' WHEN k <= 4 THEN 'Medium' ELSE 'High' END AS category, {base}, {share} FROM kinds GROUP BY 2)"
    sae, visits, pages, days = (f"{c}_sum" for c in ("sae_pending_count", "missing_visit_count", "missing_pages_count", "max_days_outstanding"))
    out["rc_one"] = f"""SELECT count(*) AS n, count(*) FILTER ({sae} > 0) AS sae_n, sum(subject_count) FILTER ({sae} > 0) AS sae_s, count(*) FILTER ({visits} > 0) AS visits_n, count(*) FILTER ({pages} > 0) AS pages_n,
count(*) FILTER ({visits} > 0 AND {pages} > 0) AS both_n, sum(subject_count) FILTER ({visits} > 0 OR {pages} > 0) AS data_s, count(*) FILTER ({days} > 30) AS late_n, count(*) FILTER ({days} > 60) AS late60, sum(subject_count) FILTER ({days} > 30) AS late_s, count(*) FILTER (k >= 4) AS sys_n, sum(subject_count) FILTER (k >= 4) AS sys_s FROM kinds"""
    out["rc_far"] = "SELECT *, row_number() OVER (PARTITION BY level ORDER BY comparison_to_avg DESC, location) AS place FROM geo WHERE comparison_to_avg > 1.5"
    out["rc_area"] = "SELECT count(*) FILTER (level = 'Region') AS geo_r, count(*) FILTER (level = 'Country') AS geo_c, string_agg(level || ' ' || location || ': ' || dominant_issue || ' rate is ' || printf('%.1f', round(comparison_to_avg, 1)) || 'x portfolio average', '; ' ORDER BY level DESC, place) FILTER (place <= 3) AS geo_text, array_to_string(list_slice(list(location ORDER BY level DESC, place) FILTER (place <= 3), 1, 3), ', ') AS geo_names FROM rc_far"
    out["rc_sites"] = "SELECT count(*) AS geo_n FROM site WHERE region IN (SELECT location FROM rc_far WHERE level = 'Region' AND place <= 3) OR country IN (SELECT location FROM rc_far WHERE level = 'Country' AND place <= 3)"
    out["rc_coded"] = "SELECT count(*) > 0 AS coded FROM cooc WHERE lift > 1.2 AND cooccurrence_count >= 10 AND issue_a || issue_b LIKE '%sae%' AND issue_a || issue_b LIKE '%meddra%'"
    part = {k: f"CAST({k}_n AS DOUBLE) / n" for k in ("sae", "visits", "pages", "late")}
    rows = [
        ("Safety", f"{part['sae']} > 0.1", f"CASE WHEN {part['sae']} > 0.2 THEN 'Critical' ELSE 'High' END", 0.85, "sae_n", "sae_s", f"sae_n || ' sites (' || {pct.format(part['sae'])} || ') have pending SAE reviews' || CASE WHEN coded THEN '; SAE and MedDRA coding issues frequently co-occur' ELSE '' END", "''"),
        ("Completeness", f"{part['visits']} > 0.15 OR {part['pages']} > 0.15", f"CASE WHEN {part['visits']} > 0.2 OR {part['pages']} > 0.2 THEN 'High' ELSE 'Medium' END", 0.8, "GREATEST(visits_n, pages_n)", "data_s", f"visits_n || ' sites (' || {pct.format(part['visits'])} || ') have missing visit data; ' || pages_n || ' sites (' || {pct.format(part['pages'])} || ') have missing CRF pages' || CASE WHEN both_n > 0 THEN '; ' || both_n || ' sites have both issues simultaneously' ELSE '' END", "''"),
        ("Geographic", "geo_r > 0 OR geo_c > 0", "CASE WHEN geo_r > 1 OR geo_c > 2 THEN 'High' ELSE 'Medium' END", 0.75, "geo_n", "0", "geo_text", "geo_names"),
        ("Timeliness", f"{part['late']} > 0.1", "CASE WHEN late60 > 10 THEN 'High' ELSE 'Medium' END", 0.85, "late_n", "late_s", f"late_n || ' sites (' || {pct.format(part['late'])} || ') have data outstanding > 30 days; ' || late60 || ' sites have data outstanding > 60 days'", "''"),
        ("Systemic", "sys_n > 5", "CASE WHEN sys_n > 20 THEN 'Critical' ELSE 'High' END", 0.9, "sys_n", "sys_s", "sys_n || ' sites have 4+ concurrent issue types; These sites require comprehensive intervention rather than targeted fixes'", "''"),
    ]
    each = " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS category, '{C.CAUSES[n][0]}' || {more} AS description, {sev} AS severity, CAST({conf} AS DOUBLE) AS confidence, CAST({sites} AS BIGINT) AS affected_sites, CAST(COALESCE({subj}, 0) AS BIGINT) AS affected_subjects, {text} AS evidence, '{'; '.join(C.CAUSES[n][1])}' AS contributing_factors, '{'; '.join(C.CAUSES[n][2])}' AS recommended_actions FROM rc_one, rc_area, rc_sites, rc_coded WHERE {w}" for i, (n, w, sev, conf, sites, subj, text, more) in enumerate(rows))
    out["rc_rows"] = f"SELECT * EXCLUDE (i), printf('RC%03d', row_number() OVER (ORDER BY i)) AS cause_id FROM ({each})"
    # the same with systemic sites by the names of their clusters
    out["rc_named"] = "SELECT rc_one.* EXCLUDE (sys_n, sys_s), c.sys_n, c.sys_s FROM rc_one, (SELECT count(*) AS sys_n, sum(subject_count) AS sys_s FROM namedsites WHERE regexp_matches(cluster_name, 'Systemic|Issues', 'i')) c"
    out["rc_clustered"] = f"SELECT * EXCLUDE (i), printf('RC%03d', row_number() OVER (ORDER BY i)) AS cause_id FROM ({each.replace('FROM rc_one,', 'FROM rc_named,')})"
    return out


CTES |= _root_causes()


def _graph() -> dict[str, str]:
    out = {}
    none = "CAST(NULL AS VARCHAR)"
    out["g_site"] = "SELECT study, site_id, max((country, region, site_risk_category, avg_dqi_score)) AS x FROM site GROUP BY study, site_id"
    out["g_nodes"] = f"""SELECT 'region:' || region AS node_id, 'Region' AS node_type, region AS name, {none} AS study, {none} AS region, region_risk_category AS risk_category, avg_dqi_score AS score FROM region_dqi
UNION ALL SELECT 'country:' || country, 'Country', country, NULL, region, country_risk_category, avg_dqi_score FROM country_dqi
UNION ALL SELECT 'study:' || study, 'Study', study, NULL, NULL, study_risk_category, avg_dqi_score FROM study_dqi
UNION ALL SELECT 'site:' || study || ':' || site_id, 'Site', site_id, study, x[2], x[3], x[4] FROM g_site
UNION ALL SELECT 'subject:' || study || ':' || subject_id, 'Subject', subject_id, study, region, risk_category, dqi_score FROM risk"""
    out["g_edges"] = """SELECT DISTINCT * FROM (SELECT 'country:' || country AS source, 'region:' || region AS target, 'IN_REGION' AS edge_type FROM country_dqi
UNION ALL SELECT 'site:' || study || ':' || site_id, 'study:' || study, 'PARTICIPATES_IN' FROM site
UNION ALL SELECT 'site:' || study || ':' || site_id, 'country:' || country, 'LOCATED_IN' FROM site
UNION ALL SELECT 'subject:' || study || ':' || subject_id, 'site:' || study || ':' || site_id, 'ENROLLED_AT' FROM risk WHERE site_id <> '')"""
    out["g_core"] = "SELECT node_id FROM g_nodes WHERE node_type IN ('Subject', 'Site') AND risk_category = 'High'"
    out["g_high"] = "SELECT node_id FROM g_core UNION SELECT target FROM g_edges WHERE source IN (SELECT node_id FROM g_core) UNION SELECT source FROM g_edges WHERE target IN (SELECT node_id FROM g_core)"
    out["g_best"] = "SELECT 'study:' || study AS node_id FROM (SELECT study, count(*) AS n FROM risk GROUP BY study ORDER BY n DESC, study LIMIT 2)"
    out["g_bs"] = "SELECT source AS node_id FROM g_edges WHERE edge_type = 'PARTICIPATES_IN' AND target IN (SELECT node_id FROM g_best)"
    out["g_top"] = "SELECT node_id FROM g_best UNION SELECT node_id FROM g_bs UNION SELECT target FROM g_edges WHERE source IN (SELECT node_id FROM g_bs) UNION SELECT source FROM g_edges WHERE target IN (SELECT node_id FROM g_bs)"
    out["g_some"] = "SELECT node_id FROM g_nodes WHERE node_type = 'Subject' ORDER BY md5(node_id), node_id LIMIT 200"
    out["g_one"] = "SELECT target AS node_id FROM g_edges WHERE source IN (SELECT node_id FROM g_some)"
    out["g_sample"] = "SELECT node_id FROM g_some UNION SELECT node_id FROM g_one UNION SELECT target FROM g_edges WHERE source IN (SELECT node_id FROM g_one)"
    return out


CTES |= _graph()


def inside(kept: str) -> str:
    return f"SELECT * FROM g_edges WHERE source IN (SELECT node_id FROM {kept}) AND target IN (SELECT node_id FROM {kept})"


_rank = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2"


def _component(f: str, w: str) -> str:
    return f"{w} * (CAST(0.5 AS DOUBLE) * CAST({f} > 0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * LEAST(GREATEST(CAST({f} AS DOUBLE) / {f}_ref, 0.0), 1.0))"


def _reference(f: str) -> str:
    x = f"CASE WHEN {f} > 0 THEN CAST({f} AS DOUBLE) END"
    return f"GREATEST(CASE WHEN count({x}) >= {C.MIN_FOR_P95} THEN quantile_cont({x}, 0.95) ELSE COALESCE(MAX({x}), 1.0) END, 1.0) AS {f}_ref"


def _cut(score: str) -> str:
    x = f"CASE WHEN n_issue_types > 0 AND sae_pending_count = 0 THEN {score} END"
    return f"CASE WHEN count({x}) = 0 THEN CAST(0.2 AS DOUBLE) ELSE round(GREATEST(quantile_cont({x}, 0.9), CAST(0.1 AS DOUBLE)), 10) END"


def _category(score: str, threshold: str) -> str:
    return f"CASE WHEN sae_pending_count > 0 THEN 'High' WHEN n_issue_types > 0 AND {score} >= {threshold} THEN 'High' WHEN n_issue_types > 0 THEN 'Medium' ELSE 'Low' END"


def _validation() -> dict[str, str]:
    from .operators.validation import SEED, scenarios

    out = {}
    out["folded"] = "SELECT *, CAST(ntile(5) OVER (PARTITION BY risk_category ORDER BY md5(concat_ws('|', study, subject_id, '42')), study, subject_id) AS INT) AS own FROM risk"
    out["foldwide"] = "SELECT folded.*, CAST(f AS INT) AS fold, CASE WHEN own = f THEN 'test' ELSE 'train' END AS part FROM folded, range(1, 6) t(f)"
    out["foldrefs"] = "SELECT fold, part, " + ", ".join(_reference(f) for f in W) + " FROM foldwide GROUP BY fold, part"
    out["foldscored"] = "SELECT foldwide.*, round(LEAST(GREATEST(" + " + ".join(_component(f, f"CAST({w} AS DOUBLE)") for f, w in W.items()) + ", 0.0), 1.0), 10) AS ps FROM foldwide JOIN foldrefs ON foldwide.fold = foldrefs.fold AND foldwide.part = foldrefs.part"
    out["foldcut"] = f"SELECT fold, {_cut('ps')} AS threshold_used FROM foldscored WHERE part = 'train' GROUP BY fold"
    out["pred"] = f"SELECT study, subject_id, site_id, foldscored.fold, threshold_used, sae_pending_count, risk_category, {_category('ps', 'threshold_used')} AS risk_category_pred, ps AS dqi_score_pred, risk_category = {_category('ps', 'threshold_used')} AS prediction_correct FROM foldscored JOIN foldcut ON foldscored.fold = foldcut.fold WHERE part = 'test'"
    out["foldresults"] = "SELECT fold, count(*) AS test_size, min(threshold_used) AS threshold, round(avg(CAST(prediction_correct AS DOUBLE)), 10) AS agreement, CASE WHEN count(*) FILTER (sae_pending_count > 0) > 0 THEN round(count(*) FILTER (sae_pending_count > 0 AND risk_category_pred = 'High') / count(*) FILTER (sae_pending_count > 0), 10) ELSE 1.0 END AS sae_capture, " + ", ".join(f"count(*) FILTER (risk_category_pred = '{k}') AS {k.lower()}_count" for k in ("High", "Medium", "Low")) + ", (SELECT count(*) FROM risk) - count(*) AS train_size FROM pred GROUP BY fold"
    out["foldsites"] = "SELECT fold, study, site_id, round(avg(dqi_score_pred), 10) AS score FROM pred WHERE site_id <> '' GROUP BY fold, study, site_id"
    out["foldpairs"] = "SELECT a.fold AS fold_a, b.fold AS fold_b, a.score AS x, b.score AS y FROM foldsites a JOIN foldsites b ON a.study = b.study AND a.site_id = b.site_id AND a.fold < b.fold"
    out["foldranks"] = f"SELECT fold_a, fold_b, {_rank.format('fold_a, fold_b', 'x')} AS rx, {_rank.format('fold_a, fold_b', 'y')} AS ry FROM foldpairs"
    out["foldcorr"] = "SELECT fold_a, fold_b, count(*) AS common_sites, round(round(corr(rx, ry), 10), 6) AS correlation FROM foldranks GROUP BY fold_a, fold_b HAVING count(*) > 10"
    out["sensrefs"] = "SELECT " + ", ".join(_reference(f) for f in W) + " FROM risk"
    rows = []
    draw = {f: f"-ln((CAST('0x' || substring(md5('{SEED}|{f}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)" for f in W}
    drawn = " + ".join(f"({d})" for d in draw.values())
    for name, w in scenarios().items():
        total = " + ".join(_component(f, f"(({draw[f]}) / ({drawn}))" if name == "Random Weights" else f"CAST({w[f]!r} AS DOUBLE)") for f in W)
        base = " + ".join(_component(f, f"CAST({WEIGHT!r} AS DOUBLE)") for f, WEIGHT in W.items())
        rows.append(f"SELECT study, subject_id, site_id, sae_pending_count, n_issue_types, '{name}' AS scenario, round(LEAST({total}, 1.0), 10) AS s, round(LEAST({base}, 1.0), 10) AS bs FROM risk, sensrefs")
    out["sensrows"] = " UNION ALL ".join(rows)
    out["senscut"] = f"SELECT scenario, {_cut('s')} AS cut FROM sensrows GROUP BY scenario"
    out["sensrated"] = f"SELECT sensrows.*, {_category('s', 'cut')} AS r FROM sensrows JOIN senscut ON sensrows.scenario = senscut.scenario"
    out["sensboth"] = "SELECT a.*, b.r AS br FROM sensrated a JOIN (SELECT study, subject_id, r FROM sensrated WHERE scenario = 'Baseline') b ON a.study = b.study AND a.subject_id = b.subject_id"
    out["senscounts"] = "SELECT scenario, count(*) FILTER (r <> br) AS category_shifts, round(round(count(*) FILTER (r <> br) / count(*) * 100, 10), 2) AS shift_pct, CASE WHEN count(*) FILTER (sae_pending_count > 0) > 0 THEN round(round(count(*) FILTER (sae_pending_count > 0 AND r = 'High') / count(*) FILTER (sae_pending_count > 0) * 100, 10), 1) ELSE 100.0 END AS sae_capture_pct, " + ", ".join(f"count(*) FILTER (r = '{k}') AS {k.lower()}_count" for k in ("High", "Medium", "Low")) + " FROM sensboth GROUP BY scenario"
    out["senssites"] = "SELECT scenario, study, site_id, round(avg(s), 10) AS x, round(avg(bs), 10) AS y FROM sensrows WHERE site_id <> '' GROUP BY scenario, study, site_id"
    out["sensranks"] = f"SELECT scenario, {_rank.format('scenario', 'x')} AS rx, {_rank.format('scenario', 'y')} AS ry FROM senssites"
    out["senscorr"] = "SELECT scenario, CASE WHEN count(*) > 10 THEN round(round(corr(rx, ry), 10), 4) ELSE 1.0 END AS rank_correlation FROM sensranks GROUP BY scenario"
    out["sens"] = "SELECT senscounts.*, rank_correlation FROM senscounts JOIN senscorr ON senscounts.scenario = senscorr.scenario"
    return out


CTES |= _validation()


def _clusters() -> dict[str, str]:
    """Sites at the nearest of fixed centres, profiles of those clusters and their names."""
    from .operators.clustering import ARCHETYPES, CENTRES, FEATURES, PROFILE

    out = {}
    z = "CASE WHEN COALESCE(stddev_samp(CAST({0} AS DOUBLE)) OVER (), 0) = 0 THEN 0.0 ELSE round((CAST({0} AS DOUBLE) - avg(CAST({0} AS DOUBLE)) OVER ()) / stddev_samp(CAST({0} AS DOUBLE)) OVER (), 10) END AS z_{0}"
    out["zsites"] = "SELECT *, " + ", ".join(z.format(f) for f in FEATURES) + " FROM site"
    far = ["(" + " + ".join(f"(z_{f} - {c!r}) * (z_{f} - {c!r})" for f in FEATURES) + ")" for c in CENTRES]
    out["nearsites"] = f"SELECT * EXCLUDE (d), CAST(list_position(d, list_min(d)) - 1 AS INT) AS cluster_id FROM (SELECT *, [{', '.join(far)}] AS d FROM zsites)"
    rate = [f"round(avg(CAST({c} > 0 AS DOUBLE)), 10) AS r{i}" for i, c in enumerate(PROFILE.values())]
    top = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'r': -r{i}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(PROFILE)) + "], lambda x: x.r < -0.1))[1:3], lambda x: x.k), ', ')"
    present = " + ".join(f"CAST(r{i} > 0.2 AS INT)" for i in range(len(PROFILE)))
    name = "CASE WHEN r0 > 0.3 OR r1 > 0.4 THEN 'Safety Concerns' WHEN r2 > 0.4 OR r3 > 0.4 THEN 'Data Laggards' WHEN present >= 3 OR (avg_dqi_score > 0.15 AND avg_high_risk_rate > 0.2) THEN 'Systemic Issues' WHEN avg_dqi_score < 0.05 AND avg_high_risk_rate < 0.05 AND present <= 1 THEN 'High Performers' WHEN avg_dqi_score < 0.1 THEN 'Moderate Performers' ELSE 'Needs Improvement' END AS cluster_name"
    out["nearshares"] = "SELECT cluster_id, count(*) AS site_count, round(avg(avg_dqi_score), 10) AS avg_dqi_score, round(avg(subject_count), 10) AS avg_subject_count, round(sum(high_risk_count) / GREATEST(sum(subject_count), 1), 10) AS avg_high_risk_rate, round(round(count(*) / (SELECT count(*) FROM site) * 100, 10), 1) AS pct_of_total, " + ", ".join(rate) + " FROM nearsites GROUP BY cluster_id"
    out["nearnames"] = f"SELECT *, {top} AS dominant_issues, {name} FROM (SELECT *, {present} AS present FROM nearshares)"
    each = {c: "CASE cluster_name " + " ".join(f"WHEN '{k}' THEN {v[i]!r}" for k, v in ARCHETYPES.items()) + " END" for i, c in enumerate(("risk_level", "intervention_priority"))}
    out["nearprofiles"] = "SELECT * EXCLUDE (present, " + ", ".join(f"r{i}" for i in range(len(PROFILE))) + "), " + ", ".join(f"{e} AS {c}" for c, e in each.items()) + " FROM nearnames"
    out["namedsites"] = "SELECT nearsites.*, cluster_name, risk_level, intervention_priority FROM nearsites JOIN nearprofiles USING (cluster_id)"
    return out


CTES |= _clusters()


def needs(sql: str) -> list[str]:
    """Names of the expressions that a text uses, in order of definition."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in found and re.search(rf"(?<![\w.]){name}(?![\w(])", text):
                found.add(name)
                todo.append(CTES[name])
    return [n for n in sorted(CTES, key=lambda n: n.startswith("rc_")) if n in found]


def query(sql: str) -> str:
    """A query with the expressions that it needs in front."""
    names = needs(sql)
    out = ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + sql) if names else sql
    # exact halves up, as functions.stats.r10 does
    return out.replace(", 10)", " + 1e-13, 10)")
