"""Registered queries over the projected domain, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .operators import anomaly, clustering, diagnostics, graph, master, perspectives, portfolio, recommend, rollup, rootcause, scoring, validation
from .oracle import concentrated, dense, inside, query
from .plans import projection
from .plans.tables import staged
from .sources import discovery
from .streaming import rescore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Domain:
    """The tables of one run. Those that later thresholds read again are staged once: each is a global barrier anyway."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def _get(self, name: str, make: Callable[[], DataFrame], keep: bool) -> DataFrame:
        if name not in self._made:
            self._made[name] = staged(make(), name) if keep else make()
        return self._made[name]

    @property
    def spine(self) -> DataFrame:
        return self._get("spine", lambda: projection.spine(self.spark, self.sf_dir), False)

    @property
    def extracts(self) -> dict[str, DataFrame]:
        return projection.extracts(self.spark, self.sf_dir)

    def metrics(self, types: list[str] | None = None) -> DataFrame:
        return master.metrics(projection.facts(self.spark, self.sf_dir, types))

    @property
    def master(self) -> DataFrame:
        return self._get("master", lambda: master.master_subject(self.spine, projection.facts(self.spark, self.sf_dir)), True)

    @property
    def scored(self) -> DataFrame:
        return self._get("scored", lambda: scoring.score_subjects(self.master), True)

    @property
    def risk(self) -> DataFrame:
        return self._get("risk", lambda: scoring.subject_risk(self.scored), False)

    @property
    def site(self) -> DataFrame:
        return self._get("site", lambda: rollup.site_risk(staged(rollup.site_metrics(self.risk), "site")), False)

    @property
    def study(self) -> DataFrame:
        return self._get("study", lambda: rollup.study_rollup(self.site), False)

    @property
    def region(self) -> DataFrame:
        return self._get("region", lambda: rollup.region_rollup(self.site), False)

    @property
    def country(self) -> DataFrame:
        return self._get("country", lambda: rollup.country_rollup(self.site), False)

    @property
    def anomalies(self) -> DataFrame:
        return self._get("anomalies", lambda: anomaly.detect(self.site, self.country, self.region), True)

    @property
    def enriched(self) -> DataFrame:
        return self._get("enriched", lambda: perspectives.enrich(self.site, anomaly.site_scores(self.anomalies), self.study, self.country), True)

    @property
    def geography(self) -> DataFrame:
        return self._get("geography", lambda: rootcause.geographic(self.site, self.country, self.region), False)

    @property
    def causes(self) -> DataFrame:
        return self._get("causes", lambda: rootcause.root_causes(self.site, self.geography, rootcause.patterns(rootcause.cooccurrence(self.risk))), False)

    @property
    def near(self) -> DataFrame:
        """Sites at the nearest of fixed centres."""
        return self._get("near", lambda: self.site.join(clustering.nearest_centres(_vectors(self)).select(*C.SITE_KEYS, "cluster_id"), C.SITE_KEYS), True)

    @property
    def clustered(self) -> DataFrame:
        """These sites, named by their clusters' profiles."""
        return self._get("clustered", lambda: clustering.named_sites(self.near, clustering.profiles(self.near)), True)

    @property
    def fitted(self) -> DataFrame:
        """Sites of k-means clusters, named by their profiles."""

        def make() -> DataFrame:
            sites = staged(self.site.join(_kmeans(_vectors(self)).select(*C.SITE_KEYS, "cluster_id"), C.SITE_KEYS), "clusters")
            return clustering.named_sites(sites, clustering.profiles(sites))

        return self._get("fitted", make, True)

    @property
    def nodes(self) -> DataFrame:
        return self._get("nodes", lambda: graph.nodes(self.risk, self.site, self.study, self.region, self.country), True)

    @property
    def edges(self) -> DataFrame:
        return self._get("edges", lambda: graph.edges(self.risk, self.site, self.country), True)

    @property
    def predictions(self) -> DataFrame:
        return self._get("predictions", lambda: validation.predictions(staged(validation.folds(self.risk), "folds")), True)


def register(name: str, sql: str | None):
    """Add a query of a Domain; sql uses the expressions of oracle.CTES."""

    def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = query(sql)
        return f

    return add


def _joined_lists(df: DataFrame) -> DataFrame:
    """Lists of strings as one string, for comparison with SQL."""
    return df.withColumns({c: F.array_join(c, "; ") for c, t in df.dtypes if t == "array<string>"})


def _metric(names: list[str], types: list[str]):
    some = " OR ".join(f"{n} IS NOT NULL" for n in names)
    return lambda d: d.metrics(types).select(*C.SUBJECT_KEYS, *names).where(some)


register("spine", "SELECT * FROM spine")(lambda d: d.spine)
for _name, (_cols, _types) in {
    "visit_metrics": (["missing_visit_count", "max_days_outstanding"], ["visit_tracker"]),
    "lab_metrics": (["lab_issues_count"], ["missing_lab"]),
    "sae_metrics": (["sae_total_count", "sae_pending_count"], ["sae_dashboard"]),
    "pages_metrics": (["missing_pages_count", "max_days_page_missing"], ["missing_pages"]),
    "coding_metrics": (["uncoded_meddra_count", "uncoded_whodd_count"], ["meddra_coding", "whodd_coding"]),
    "inactivated_metrics": (["inactivated_forms_count"], ["inactivated"]),
    "edrr_metrics": (["edrr_open_issues"], ["edrr"]),
}.items():
    register(_name, f"SELECT study, subject_id, {', '.join(_cols)} FROM metrics WHERE {' OR '.join(f'{c} IS NOT NULL' for c in _cols)}")(_metric(_cols, _types))

register("master_subject", "SELECT * FROM master")(lambda d: d.master)
register("outlier_cap", "SELECT " + ", ".join(f"CASE WHEN {c}_q3 - {c}_q1 > 0 THEN GREATEST(0.0, {c}_q1 - 3.0 * ({c}_q3 - {c}_q1)) END AS {c}_low, CASE WHEN {c}_q3 - {c}_q1 > 0 THEN {c}_q3 + 3.0 * ({c}_q3 - {c}_q1) END AS {c}_high" for c in C.CAPPED_COLUMNS) + " FROM quartiles")(
    lambda d: master.quartile_bounds(d.spine.join(d.metrics(), C.SUBJECT_KEYS, "left"), C.CAPPED_COLUMNS)
)
register("fill_categoricals", "SELECT subject_status, count(*) AS n FROM master GROUP BY subject_status")(
    lambda d: d.spine.select(master.fill_category(F.col("subject_status")).alias("subject_status")).groupBy("subject_status").agg(F.count("*").alias("n"))
)
_keys = ", ".join(C.SITE_KEYS)
_counts = [c for c in C.ISSUE_COLUMNS if not c.startswith("max_days")]
_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _counts)
register("master_site", f"SELECT {_keys}, count(*) AS subject_count, {_sums} FROM master WHERE site_id IS NOT NULL AND site_id <> '' GROUP BY {_keys}")(lambda d: master.master_site(d.master))
register("master_study", f"SELECT study, count(*) AS subject_count, count(DISTINCT site_id) AS site_count, {_sums} FROM master GROUP BY study")(lambda d: master.master_study(d.master))
register("duplicates", "SELECT * FROM spine QUALIFY count(*) OVER (PARTITION BY study, site_id, subject_status) > 1")(lambda d: master.duplicates(d.spine, ["study", "site_id", "subject_status"]))
register("reference_max", "SELECT * FROM refs")(lambda d: scoring.reference_max(scoring.with_issue_types(d.master)))
register("dqi_components", " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({w} AS DOUBLE) AS weight, '{t}' AS tier, count(*) FILTER ({f} > 0) AS n_positive, round(avg(CAST({f} AS DOUBLE)), 8) AS mean_raw, CAST(max({f}) AS DOUBLE) AS max_raw, round(avg({f}_component), 8) AS mean_component, round(max({f}_component), 8) AS max_component FROM scored" for f, (w, t) in C.WEIGHTS.items()))(
    lambda d: scoring.component_statistics(d.scored)
)
register("dqi_subject", "SELECT study, subject_id, n_issue_types, dqi_score FROM scored")(lambda d: d.scored.select("study", "subject_id", "n_issue_types", "dqi_score"))
register("dqi_risk", "SELECT study, subject_id, site_id, country, region, dqi_score, has_issues, risk_category FROM risk")(lambda d: d.risk.select("study", "subject_id", "site_id", "country", "region", "dqi_score", "has_issues", "risk_category"))
register("dqi_overrides", "SELECT count(*) FILTER (sae_pending_count > 0) AS sae_subjects, count(*) FILTER (sae_pending_count > 0 AND dqi_score < threshold) AS overridden FROM risk")(lambda d: scoring.overrides(d.risk))
_mean = {k: f"round(COALESCE(avg(CASE WHEN risk_category = '{k}' THEN dqi_score END), 0.0), 10)" for k in ("High", "Medium", "Low")}
register(
    "dqi_checks",
    f"""SELECT 'sae_capture' AS check_name, count(*) FILTER (sae_pending_count > 0) = count(*) FILTER (sae_pending_count > 0 AND risk_category = 'High') AS passed FROM risk
UNION ALL SELECT 'capture_rate', CASE WHEN sum(has_issues) > 0 THEN count(*) FILTER (risk_category <> 'Low') / sum(has_issues) >= 0.99 ELSE true END FROM risk
UNION ALL SELECT 'pyramid_shape', count(*) FILTER (risk_category = 'Medium') >= count(*) FILTER (risk_category = 'High') FROM risk
UNION ALL SELECT 'score_alignment', {_mean['High']} > {_mean['Medium']} AND {_mean['Medium']} > {_mean['Low']} FROM risk
UNION ALL SELECT 'site_pyramid', count(*) FILTER (site_risk_category = 'Medium') >= count(*) FILTER (site_risk_category = 'High') FROM site""",
)(lambda d: scoring.checks(d.risk, d.site))
register("site_rollup", "SELECT * FROM site")(lambda d: d.site)
register("study_rollup", "SELECT * FROM study_dqi")(lambda d: d.study)
register("region_rollup", "SELECT * FROM region_dqi")(lambda d: d.region)
register("country_rollup", "SELECT * FROM country_dqi")(lambda d: d.country)
register("risk_distribution", " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER (risk_category = '{k}') AS n FROM risk" for k in ("High", "Medium", "Low")))(lambda d: rollup.distribution(d.risk, "risk_category"))

register("anomaly_statistical", "SELECT * FROM a_statistical")(lambda d: anomaly.statistical(d.site))
register("anomaly_pattern", "SELECT * FROM a_pattern")(lambda d: anomaly.pattern(d.site))
register("anomaly_regional", "SELECT * FROM a_regional")(lambda d: anomaly.regional(d.site, d.country, d.region))
register("anomaly_regional_sites", "SELECT * FROM s_regional")(lambda d: anomaly.regional(d.site))
register("anomaly_cross_study", "SELECT * FROM a_cross")(lambda d: anomaly.cross_study(d.site))
register("anomaly_density", "SELECT * FROM a_density")(lambda d: anomaly.density(d.site))
register("anomaly_density_low", dense(1.0, 2.0))(lambda d: anomaly.density(d.site, 1.0, 2.0))
register("anomaly_concentration", concentrated(50, 0.5))(lambda d: anomaly.concentration(d.site))
register("anomaly_concentration_low", concentrated(50, 0.02))(lambda d: anomaly.concentration(d.site, share=0.02))
register("anomaly_all", "SELECT * FROM anomalies")(lambda d: d.anomalies)
register("anomaly_site_score", "SELECT * FROM site_scores")(lambda d: anomaly.site_scores(d.anomalies))
register("anomaly_summary", "SELECT 'severity' AS kind, severity AS name, count(*) AS n FROM anomalies GROUP BY severity UNION ALL SELECT 'anomaly_type', anomaly_type, count(*) FROM anomalies GROUP BY anomaly_type")(lambda d: anomaly.summary(d.anomalies))

register("rec_subject", "SELECT * FROM rec_subjects")(lambda d: recommend.flattened(recommend.subjects(d.risk)))
register("rec_site", "SELECT * FROM rec_sites")(lambda d: recommend.flattened(recommend.sites(d.site)))
register("rec_study", "SELECT * FROM rec_studies")(lambda d: recommend.flattened(recommend.studies(d.site)))
register("rec_region", "SELECT * FROM rec_regions")(lambda d: recommend.flattened(recommend.regions(d.site)))
register("rec_country", "SELECT * FROM rec_countries")(lambda d: recommend.flattened(recommend.countries(d.site)))
register("issue_totals", " UNION ALL ".join(f"SELECT '{k}' AS issue_type, count(*) AS subjects, CAST(sum({k}) AS BIGINT) AS total FROM risk WHERE risk_category = 'High' AND {k} > 0 HAVING count(*) > 0" for k in recommend.ACTIONS))(lambda d: recommend.issue_totals(recommend.subjects(d.risk)))
register("action_summary", " UNION ALL ".join(f"SELECT '{n}' AS level, priority, count(*) AS n FROM {t} GROUP BY priority" for n, t in (("subject", "rec_subjects"), ("site", "rec_sites"), ("study", "rec_studies"), ("region", "rec_regions"), ("country", "rec_countries"))))(
    lambda d: recommend.action_summary(recommend.subjects(d.risk), recommend.sites(d.site), recommend.studies(d.site), recommend.regions(d.site), recommend.countries(d.site))
)

register("agent_context", "SELECT * FROM agent_context")(lambda d: perspectives.context(d.site))
register("agent_candidates", "SELECT * FROM agent_candidates ORDER BY rank_score DESC, study, site_id, country, region LIMIT 20")(lambda d: perspectives.candidates(d.enriched, 20).select(*C.SITE_KEYS, "rank_score"))
for _k in perspectives.PERSPECTIVES:
    register(f"agent_{_k}", f"SELECT {', '.join(C.SITE_KEYS)}, {_k} AS score, array_to_string({_k}_findings, '; ') AS findings, array_to_string({_k}_actions, '; ') AS actions FROM views")(
        lambda d, k=_k: d.enriched.select(*C.SITE_KEYS, perspectives.PERSPECTIVES[k]().alias("v")).select(*C.SITE_KEYS, "v.score", F.array_join("v.findings", "; ").alias("findings"), F.array_join("v.actions", "; ").alias("actions"))
    )
_level = "CASE WHEN {0} >= 0.8 THEN 'Critical' WHEN {0} >= 0.6 THEN 'High' WHEN {0} >= 0.4 THEN 'Medium' ELSE 'Low' END"
register("agent_views", " UNION ALL ".join(f"SELECT {_keys}, '{k}' AS perspective, {k} AS score, {_level.format(k)} AS level, array_to_string({k}_findings, '; ') AS findings, array_to_string({k}_actions, '; ') AS actions FROM views" for k in perspectives.PERSPECTIVES))(lambda d: _joined_lists(perspectives.Registry().by_sql(d.enriched, C.SITE_KEYS)).drop("confidence"))
register("agent_consensus", "SELECT * FROM agent_out")(lambda d: perspectives.consensus(d.enriched))
register("cooccurrence", "SELECT * FROM cooc")(lambda d: rootcause.cooccurrence(d.risk))
_strength = "CASE WHEN lift > 2 THEN 'strongly' WHEN lift > 1.5 THEN 'moderately' ELSE 'slightly' END"
_pair = "CASE " + " ".join("WHEN issue_a = '{}' AND issue_b = '{}' THEN '{}' || {} || '{}'".format(a, b, t[0], "printf('%.1f', round(lift, 1))" if rootcause.pair_kind(a, b) == "other" else _strength, t[1]) for a, b in combinations(C.SUMMED, 2) for t in [rootcause.pair_text(a, b)]) + " END"
register("cooccurrence_patterns", f"SELECT *, {_pair} AS interpretation FROM cooc WHERE lift > 1.2 AND cooccurrence_count >= 10")(lambda d: rootcause.patterns(rootcause.cooccurrence(d.risk)))
_both = "SELECT issue_a, issue_b, lift FROM cooc UNION ALL SELECT issue_b, issue_a, lift FROM cooc"
register("cooccurrence_matrix", "SELECT issue_a AS issue, " + ", ".join(f"COALESCE(max(lift) FILTER (issue_b = '{c}'), 1.0) AS {c}" for c in C.SUMMED) + f" FROM ({_both}) GROUP BY issue_a")(lambda d: rootcause.matrix(rootcause.cooccurrence(d.risk)))
register("geo_patterns", "SELECT * FROM geo")(lambda d: d.geography)
register("factor_size", "SELECT * FROM f_size")(lambda d: rootcause.factor_size(d.site))
register("factor_study", "SELECT * FROM f_study")(lambda d: rootcause.factor_study(d.site))
register("factor_region", "SELECT * FROM f_region")(lambda d: rootcause.factor_region(d.site))
register("factor_complexity", "SELECT * FROM f_complexity")(lambda d: rootcause.factor_complexity(d.site))
register("root_causes", "SELECT * FROM rc_rows")(lambda d: _joined_lists(d.causes))

register("graph_nodes", "SELECT * FROM g_nodes")(lambda d: d.nodes)
register("graph_edges", "SELECT * FROM g_edges")(lambda d: d.edges)
register("graph_counts", "SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM g_nodes GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*) FROM g_edges GROUP BY edge_type")(lambda d: graph.counts(d.nodes, d.edges))
register("graph_high_risk", inside("g_high"))(lambda d: graph.high_risk(d.nodes, d.edges))
register("graph_top_studies", inside("g_top"))(lambda d: graph.top_studies(d.nodes, d.edges, d.risk, 2))
register("graph_sample", inside("g_sample"))(lambda d: graph.sample(d.nodes, d.edges, 200))
register("graph_risk_by_country", "SELECT country, risk_category, count(*) AS n FROM risk GROUP BY country, risk_category")(lambda d: graph.risk_by_country(d.risk))

register("kfold", "SELECT study, subject_id, risk_category, own AS fold FROM folded")(lambda d: validation.folds(d.risk).select("study", "subject_id", "risk_category", "fold"))
register("kfold_predictions", "SELECT * FROM pred")(lambda d: d.predictions)
register("kfold_metrics", "SELECT * FROM foldresults")(lambda d: validation.fold_results(d.predictions, d.risk))
register("kfold_stability", "SELECT round(avg(threshold), 10) AS mean, round(stddev_pop(threshold), 10) AS std, round(COALESCE(stddev_pop(threshold) / NULLIF(avg(threshold), 0), 0.0), 10) AS cv, min(threshold) AS min, max(threshold) AS max, round(max(threshold) - min(threshold), 10) AS range FROM foldresults")(lambda d: validation.stability(validation.fold_results(d.predictions, d.risk)))
register("rank_correlation", "SELECT * FROM foldcorr")(lambda d: validation.rank_correlation(d.predictions))
register("sensitivity", "SELECT * FROM sens")(lambda d: validation.sensitivity(d.risk))

_hp = "floor(round(100 * (1 - (count(*) FILTER (risk_category = 'High') + 0.3 * count(*) FILTER (risk_category = 'Medium')) / GREATEST(count(*), 1)), 10))"
register("health", f"SELECT *, CASE WHEN health >= 85 THEN 'Excellent' WHEN health >= 70 THEN 'Good' WHEN health >= 50 THEN 'Fair' ELSE 'Poor' END AS band FROM (SELECT count(*) AS subjects, count(*) FILTER (risk_category = 'High') AS high, count(*) FILTER (risk_category = 'Medium') AS medium, CAST({_hp} AS INT) AS health FROM risk)")(lambda d: portfolio.health(d.risk))
register("study_bands", "SELECT count(*) FILTER (high_risk_rate >= 0.20) AS critical, count(*) FILTER (high_risk_rate >= 0.10 AND high_risk_rate < 0.20) AS warning, count(*) FILTER (high_risk_rate < 0.10) AS good FROM study_dqi")(lambda d: portfolio.study_bands(d.study))
register("top_issues", " UNION ALL ".join(f"SELECT '{c}' AS issue, CAST(sum({c}) AS BIGINT) AS total FROM risk" for c in portfolio.TOP_ISSUES))(lambda d: portfolio.top_issues(d.risk))
register("region_comparison", "SELECT region, avg_dqi_score, portfolio, CASE WHEN avg_dqi_score > portfolio * 1.1 THEN 'above' WHEN avg_dqi_score < portfolio * 0.9 THEN 'below' ELSE 'average' END AS position FROM region_dqi, (SELECT round(avg(avg_dqi_score), 10) AS portfolio FROM site)")(lambda d: portfolio.region_comparison(d.region, d.site))
register("anomaly_line", "SELECT round(quantile_cont(anomaly_score, 0.9), 10) AS p90 FROM site_scores")(lambda d: portfolio.anomaly_line(anomaly.site_scores(d.anomalies)))
register("strongest_pair", "SELECT issue_a, issue_b, lift FROM cooc ORDER BY lift DESC, issue_a, issue_b LIMIT 1")(lambda d: portfolio.strongest_pair(rootcause.cooccurrence(d.risk)))
register("alerts", "SELECT study, CAST(sum(sae_pending_count_sum) AS BIGINT) AS pending_sae FROM site GROUP BY study ORDER BY pending_sae DESC, study LIMIT 3")(lambda d: portfolio.alerts(d.site))
register("alert_counts", "SELECT (SELECT CAST(COALESCE(sum(sae_pending_count_sum), 0) AS BIGINT) FROM site) AS pending_sae, (SELECT count(*) FROM site WHERE sae_pending_count_sum > 0) AS sae_sites, (SELECT count(*) FROM rc_rows WHERE severity = 'Critical') AS critical_causes, (SELECT count(*) FROM anomalies WHERE severity = 'CRITICAL') AS critical_anomalies, (SELECT count(*) FROM anomalies WHERE severity = 'HIGH') AS high_anomalies")(lambda d: portfolio.alert_counts(d.site, d.causes, d.anomalies))
register("action_items", "SELECT (SELECT count(*) FROM risk) AS total_subjects, (SELECT count(*) FROM site) AS total_sites, (SELECT count(*) FROM rec_regions) AS total_regions, (SELECT count(*) FROM rec_countries) AS total_countries_flagged, (SELECT count(*) FROM rec_sites WHERE priority = 'CRITICAL') AS critical_items, (SELECT count(*) FROM rec_sites WHERE priority = 'HIGH') AS high_priority_items")(
    lambda d: recommend.action_items(d.risk, d.site, recommend.sites(d.site), recommend.regions(d.site), recommend.countries(d.site))
)
register("rec_site_first", "SELECT study, site_id, country, region, priority, avg_dqi_score FROM rec_sites ORDER BY CASE priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, avg_dqi_score DESC, study, site_id, country, region LIMIT 20")(lambda d: recommend.first_sites(recommend.sites(d.site)).select(*C.SITE_KEYS, "priority", "avg_dqi_score"))
register("study_sites", "SELECT study, site_count, known_sites FROM study_dqi JOIN (SELECT study, count(*) AS known_sites FROM site GROUP BY study) USING (study)")(lambda d: graph.study_sites(d.study, d.site).select("study", "site_count", "known_sites"))
_place = "CASE priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"
register("action_list", f"SELECT 'site' AS source, study || ' ' || site_id AS target, {_place} AS urgency FROM rec_sites UNION ALL SELECT 'study', study, {_place} FROM rec_studies UNION ALL SELECT 'country', country || ' ' || region, {_place} FROM rec_countries UNION ALL SELECT 'anomaly', study || ' ' || site_id, 1 FROM site_scores WHERE critical_count > 0 UNION ALL SELECT 'root cause', cause_id || ' ' || category, CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END FROM rc_rows")(
    lambda d: portfolio.actions(recommend.sites(d.site), recommend.studies(d.site), recommend.countries(d.site), anomaly.site_scores(d.anomalies), d.causes)
)
register("impact", "SELECT high, CAST(floor(round(high * 0.66, 10)) AS BIGINT) AS resolved, CAST(floor(round(high * 0.47, 10)) AS BIGINT) AS prevented FROM (SELECT CAST(count(*) FILTER (risk_category = 'High') AS BIGINT) AS high FROM risk)")(lambda d: portfolio.impact(d.risk))
register("drilldown", "SELECT CAST(LEAST(floor(dqi_score * 30), 29) AS INT) AS bin, count(*) AS n FROM risk WHERE study = 'BUILDING' AND risk_category IN ('High', 'Medium') GROUP BY 1")(lambda d: portfolio.drilldown(d.risk, study="BUILDING", categories=["High", "Medium"]))

_z = ", ".join(f"CASE WHEN COALESCE(stddev_samp(CAST({f} AS DOUBLE)) OVER (), 0) = 0 THEN 0.0 ELSE round((CAST({f} AS DOUBLE) - avg(CAST({f} AS DOUBLE)) OVER ()) / stddev_samp(CAST({f} AS DOUBLE)) OVER (), 10) END AS z_{f}" for f in clustering.FEATURES)
register("cluster_features", f"SELECT study, site_id, country, region, {_z} FROM site")(lambda d: clustering.features(d.site).select(*C.SITE_KEYS, *(f"z_{f}" for f in clustering.FEATURES)))


def _vectors(d: Domain) -> DataFrame:
    return staged(clustering.vectors(clustering.features(d.site)).withColumn("site_key", F.concat_ws("|", *C.SITE_KEYS)), "vectors")


def _kmeans(vec: DataFrame) -> DataFrame:
    return clustering.best_kmeans(vec, "site_key")[0]


def _mixture(vec: DataFrame) -> DataFrame:
    return clustering.best_mixture(vec)[0]


def _dbscan(vec: DataFrame, eps: float) -> DataFrame:
    return vec.join(clustering.dbscan(vec, "site_key", [f"z_{f}" for f in clustering.FEATURES], eps, 5), "site_key")


register("cluster_kmeans", None)(lambda d: _kmeans(_vectors(d)).select(*C.SITE_KEYS, "cluster_id", "cluster_probability"))
register("cluster_gmm", None)(lambda d: _mixture(_vectors(d)).select(*C.SITE_KEYS, "cluster_id", "cluster_probability"))
register("cluster_pca", None)(lambda d: clustering.principal_components(_vectors(d)).select(*C.SITE_KEYS, "pc1", "pc2"))


_four = f"{_keys}, cluster_id, cluster_name, risk_level, intervention_priority"
register("cluster_sites", f"SELECT {_four} FROM namedsites")(lambda d: d.clustered.select(*_four.split(", ")))
register("cluster_sites_fitted", None)(lambda d: d.fitted.select(*_four.split(", ")))
register("cluster_comparison", "SELECT cluster_name, count(*) AS site_count, round(avg(avg_dqi_score), 10) AS avg_dqi_score, CAST(sum(subject_count) AS BIGINT) AS subject_count, CAST(sum(high_risk_count) AS BIGINT) AS high_risk_count FROM namedsites GROUP BY cluster_name")(lambda d: portfolio.cluster_comparison(d.clustered))
register("site_dashboard", f"SELECT {', '.join(f'n.{k}' for k in C.SITE_KEYS)}, avg_dqi_score, site_risk_category, COALESCE(s.anomaly_score, 0.0) AS anomaly_score, cluster_name FROM namedsites n LEFT JOIN site_scores s ON n.study = s.study AND n.site_id = s.site_id")(
    lambda d: portfolio.site_dashboard(d.site, anomaly.site_scores(d.anomalies), d.clustered).select(*C.SITE_KEYS, "avg_dqi_score", "site_risk_category", "anomaly_score", "cluster_name")
)
register("root_causes_clustered", "SELECT * FROM rc_clustered")(lambda d: _joined_lists(rootcause.root_causes(d.site, d.geography, rootcause.patterns(rootcause.cooccurrence(d.risk)), d.clustered)))
_zs = [f"z_{f}" for f in clustering.FEATURES]
register("cluster_heatmap", "SELECT * FROM (WITH m AS (SELECT cluster_id, " + ", ".join(f"avg({z}) AS {z}" for z in _zs) + " FROM nearsites GROUP BY cluster_id) SELECT cluster_id, " + ", ".join(f"round(COALESCE(({z} - min({z}) OVER ()) / NULLIF(max({z}) OVER () - min({z}) OVER (), 0), 0.0), 10) AS {z}" for z in _zs) + " FROM m)")(
    lambda d: clustering.heatmap(clustering.nearest_centres(_vectors(d)), _zs)
)


def _embedded(d: Domain) -> DataFrame:
    e = projection.table(d.spark, d.sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))


def _density(eps: float, least: int = 5) -> str:
    gap = " + ".join(f"(a.{z} - b.{z}) * (a.{z} - b.{z})" for z in _zs)
    return f"""SELECT * FROM (WITH RECURSIVE zs AS MATERIALIZED (SELECT {_keys}, concat_ws('|', {_keys}) AS k, {', '.join(_zs)} FROM zsites),
pr AS MATERIALIZED (SELECT a.k AS p, b.k AS q FROM zs a JOIN zs b ON {gap} <= {eps * eps!r}),
core AS MATERIALIZED (SELECT p FROM pr GROUP BY p HAVING count(*) >= {least}),
reach AS (SELECT p, p AS q FROM core UNION SELECT r.p, pr.q FROM reach r JOIN pr ON pr.p = r.q JOIN core c ON c.p = pr.q),
root AS (SELECT p, min(q) AS r FROM reach GROUP BY p),
num AS (SELECT r, CAST(row_number() OVER (ORDER BY r) - 1 AS INT) AS n FROM (SELECT DISTINCT r FROM root)),
lab AS (SELECT pr.p, min(root.r) AS r FROM pr JOIN root ON root.p = pr.q GROUP BY pr.p)
SELECT {_keys}, COALESCE(n, -1) AS cluster_id FROM zs LEFT JOIN lab ON lab.p = zs.k LEFT JOIN num ON num.r = lab.r)"""


for _name, _eps in {"cluster_dbscan": 0.5, "cluster_dbscan_wide": 1.6}.items():
    _sql = query(_density(_eps))
    register(_name, None)(lambda d, e=_eps: _dbscan(_vectors(d), e).select(*C.SITE_KEYS, "cluster_id"))
    ORACLES[_name] = _sql
register("cluster_silhouette", f"""WITH e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label >= 0),
d AS MATERIALIZED (SELECT a.vec_id, a.label AS own, b.label AS other, avg(sqrt({"list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"})) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
SELECT (SELECT count(*) FROM e) AS points, round((SELECT sum(CASE WHEN a IS NULL OR b IS NULL OR GREATEST(a, b) = 0 THEN 0.0 ELSE (b - a) / GREATEST(a, b) END) FROM s) / (SELECT count(*) FROM e), 6) AS silhouette""")(
    lambda d: clustering.silhouette(_embedded(d), "vec_id", "label", _all).select("points", F.round("silhouette", 6).alias("silhouette"))
)
_all = [f"x{i}" for i in range(64)]
_sq = "list_sum(list_transform(range(1, 65), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))"
register(
    "cluster_metrics",
    f"""WITH e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v) AS v FROM embeddings),
u AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM e),
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL) GROUP BY label),
w AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, avg(x) AS x FROM u GROUP BY i)),
g AS (SELECT e.label, c, count(*) AS n, sum({_sq.format('v', 'c')}) AS inside, avg(sqrt({_sq.format('v', 'c')})) AS spread FROM e JOIN m USING (label) GROUP BY ALL),
d AS (SELECT max((a.spread + b.spread) / sqrt({_sq.format('a.c', 'b.c')})) AS r FROM g a JOIN g b ON a.label <> b.label GROUP BY a.label)
SELECT (SELECT count(*) FROM g) AS k, round((SELECT sum(n * {_sq.format('c', 't')}) / (count(*) - 1) / (sum(inside) / (sum(n) - count(*))) FROM g, w), 6) AS calinski_harabasz, round((SELECT avg(r) FROM d), 6) AS davies_bouldin""",
)(lambda d: clustering.metrics(_embedded(d), "label", _all).select("k", F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin")))
register("cluster_profiles", "SELECT * FROM nearprofiles")(lambda d: clustering.profiles(d.near))

_files = ["CPID_EDC_Metrics_v1.xlsx", "Visit Projection Tracker.xlsx", "Missing_Lab_Name_and_Missing_Ranges.xlsx", "eSAE Dashboard_Standard.xlsx", "Global_Missing_Pages_Report.xlsx", "GlobalCodingReport_MedDRA.xlsx", "GlobalCodingReport_WHODD.xlsx", "Inactivated Forms, Folders.xlsx", "Compiled_EDRR.xlsx", "notes.xlsx", "missing visit list.xlsx"]
_kinds = list(C.FILE_PATTERNS)
_names = ", ".join(f"'{x}'" for x in _files)
# a file of every customer, in a folder of their nation
_paths = f"'/data/' || [{', '.join(map(repr, ['Study_', 'STUDY ', 'study', 'Archive ']))}][c_custkey % 4 + 1] || c_nationkey || '/' || c_custkey || ' ' || [{_names}][c_custkey % {len(_files)} + 1]"
_case = "CASE " + " ".join(f"WHEN regexp_matches(filename, '{'|'.join(f'(?:{p})' for p in ps)}', 'i') THEN '{k}'" for k, ps in C.FILE_PATTERNS.items()) + " ELSE 'unknown' END"
_number = "regexp_extract(folder, '(?i)Study[_\\s]*(\\d+)', 1)"
ORACLES["classify_files"] = f"WITH f AS (SELECT path, string_split(path, '/')[-1] AS filename, string_split(path, '/')[-2] AS folder FROM (SELECT {_paths} AS path FROM customer)) SELECT CASE WHEN {_number} <> '' THEN 'Study_' || {_number} ELSE folder END AS study, folder, filename, {_case} AS file_type, path FROM f"


def _customers(d: Domain) -> DataFrame:
    return projection.table(d.spark, d.sf_dir, "customer")


def _nth(values: list[str], at: str):
    return F.array(*map(F.lit, values))[(F.col(at) % len(values)).cast("int")]


register("classify_files", None)(lambda d: discovery.file_mapping(_customers(d).select(F.concat(F.lit("/data/"), _nth(["Study_", "STUDY ", "study", "Archive "], "c_custkey"), "c_nationkey", F.lit("/"), "c_custkey", F.lit(" "), _nth(_files, "c_custkey")).alias("path"))))
_prefixes = ["Subject ", "SUBJ-", "pat_0", "", "0", "PT ", "x-", "patient", " Sub_000"]
ORACLES["standardise_ids"] = f"SELECT s AS subject_id, CASE WHEN b = '' THEN '0' ELSE b END AS id FROM (SELECT s, regexp_replace(regexp_replace(upper(trim(s)), '^(SUBJECT|SUBJ|SUB|PATIENT|PAT|PT)[\\s_\\-]*', ''), '^0+', '') AS b FROM (SELECT [{', '.join(map(repr, _prefixes))}][c_custkey % {len(_prefixes)} + 1] || c_custkey AS s FROM customer))"
register("standardise_ids", None)(lambda d: _customers(d).select(F.concat(_nth(_prefixes, "c_custkey"), "c_custkey").alias("subject_id")).select("subject_id", discovery.standard_id(F.col("subject_id")).alias("id")))
# against enrolled subjects alone, so that some ids of the extracts are strangers
_match = "SELECT '{k}' AS file_type, count(*) AS ids, count(s.subject_id) AS matched, count(*) - count(s.subject_id) AS unmatched FROM (SELECT DISTINCT study, subject_id FROM metrics WHERE {w}) i LEFT JOIN (SELECT DISTINCT study, subject_id FROM spine WHERE subject_status = 'Enrolled') s ON s.study = i.study AND s.subject_id = i.subject_id"
register("id_match", _match.format(k="sae_dashboard", w="sae_total_count > 0"))(lambda d: discovery.id_match(d.spine.where("subject_status = 'Enrolled'"), d.extracts["sae_dashboard"], "sae_dashboard"))
# a header of every customer: an accepted name with the market segment behind it
_accepted = [(k, c, v) for k, m in C.HEADERS.items() for c, names in m.items() for v in names]
_heads = [("edc_metrics", h) for h in ("Project Name", "Region", "Country Code", "Site ID", "Subject ID", "Latest Visit (SV)")] + [("sae_dashboard", h) for h in ("Patient ID", "Site", "Review Status")] + [("missing_pages", h) for h in ("Subject Name", "Site Number")]
ORACLES["map_columns"] = f"""WITH a(file_type, canonical, part) AS (VALUES {', '.join("('" + "', '".join((k, c, v.lower().replace("'", "''"))) + "')" for k, c, v in _accepted)}),
n(i, file_type, header) AS (VALUES {', '.join(f"({i}, '{k}', '{h}')" for i, (k, h) in enumerate(_heads))}),
h AS (SELECT file_type, header || ' ' || c_mktsegment AS header, c_custkey AS position FROM customer JOIN n ON c_custkey % {len(_heads)} = i),
b AS (SELECT h.file_type, canonical, arg_min(header, position) AS header FROM h JOIN a ON h.file_type = a.file_type AND contains(lower(header), part) GROUP BY ALL)
SELECT w.file_type, w.canonical, b.header FROM (SELECT DISTINCT a.file_type, canonical FROM a JOIN h ON a.file_type = h.file_type) w LEFT JOIN b ON b.file_type = w.file_type AND b.canonical = w.canonical"""
register("map_columns", None)(
    lambda d: discovery.map_headers(_customers(d).select(_nth([k for k, _ in _heads], "c_custkey").alias("file_type"), F.concat(_nth([h for _, h in _heads], "c_custkey"), F.lit(" "), "c_mktsegment").alias("header"), F.col("c_custkey").alias("position")))
)
register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL")(
    lambda d: rescore.windowed_counts(projection.table(d.spark, d.sf_dir, "events")).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})
)

_q = {c: f"quantile_cont(CASE WHEN {c} > 0 THEN CAST({c} AS DOUBLE) END, {{}})" for c in C.ISSUE_COLUMNS}
register("diagnose_outliers", " UNION ALL ".join(f"SELECT '{c}' AS metric, count(*) FILTER ({c} > 0 AND {c} > q3 + 3.0 * (q3 - q1)) AS outliers, CAST(max(CASE WHEN {c} > 0 THEN {c} END) AS DOUBLE) AS largest, round({e.format(0.99)}, 10) AS p99 FROM master, (SELECT {e.format(0.25)} AS q1, {e.format(0.75)} AS q3 FROM master)" for c, e in _q.items()))(lambda d: diagnostics.outliers(d.master))
register("diagnose_small_sites", f"SELECT count(*) AS sites, count(*) FILTER (n < 5) AS small, min(n) AS fewest, max(n) AS most FROM (SELECT count(*) AS n FROM master WHERE site_id <> '' GROUP BY {_keys})")(lambda d: diagnostics.small_sites(d.master))
_by_file = {"visit_tracker": "missing_visit_count", "sae_dashboard": "sae_total_count", "missing_lab": "lab_issues_count", "missing_pages": "missing_pages_count", "meddra_coding": "uncoded_meddra_count", "whodd_coding": "uncoded_whodd_count", "inactivated": "inactivated_forms_count", "edrr": "edrr_open_issues"}
register("diagnose_matches", " UNION ALL ".join(_match.format(k=k, w=f"{m} IS NOT NULL") for k, m in _by_file.items()))(lambda d: diagnostics.matches(d.spine.where("subject_status = 'Enrolled'"), d.extracts))
register("diagnose_presence", " UNION ALL ".join(f"SELECT '{k}' AS file_type, count(DISTINCT study) AS with_data, (SELECT count(DISTINCT study) FROM spine) - count(DISTINCT study) AS without_data, string_agg(DISTINCT study, ', ' ORDER BY study) AS studies FROM metrics WHERE {m} IS NOT NULL" for k, m in _by_file.items()))(lambda d: diagnostics.presence(d.spine, d.extracts))
_cut = "CASE WHEN count(CASE WHEN avg_dqi_score > 0 THEN 1 END) = 0 THEN {1} ELSE round(GREATEST(quantile_cont(CASE WHEN avg_dqi_score > 0 THEN avg_dqi_score END, {0}), {2}), 10) END"
register("level_risk", f"WITH lv AS (SELECT study, region, count(*) AS site_count, CAST(sum(subject_count) AS BIGINT) AS subject_count, round(avg(avg_dqi_score), 10) AS avg_dqi_score, CAST(sum(high_risk_count) AS BIGINT) AS high_risk_subjects FROM site GROUP BY study, region), ct AS (SELECT {_cut.format(0.85, 0.1, 0.05)} AS hi, {_cut.format(0.5, 0.04, 0.02)} AS med FROM lv) SELECT lv.*, CASE WHEN avg_dqi_score >= hi THEN 'High' WHEN avg_dqi_score >= med THEN 'Medium' ELSE 'Low' END AS risk_category FROM lv, ct".replace("WITH lv", "SELECT * FROM (WITH lv", 1) + ")")(lambda d: diagnostics.level_risk(d.site, ["study", "region"]))
