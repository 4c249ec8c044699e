"""The phases as stages with requirements (ORC-1..8): each reads tables of a folder and writes its own."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import anomaly, clustering, graph, master, perspectives, recommend, rollup, rootcause, scoring, validation
from ..sources import documents, files, reports, workbook
from . import projection
from .tables import staged

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Stage:
    requires: tuple[str, ...]
    make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    outputs: tuple[str, ...]


def _scores(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"scored": scoring.score_subjects(t["master"])}


def _clusters(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """CLU-1..9, JN-8: k-means with the k of the best silhouette; the sites carry their cluster's name."""
    site = t["site"]
    names = [f"z_{f}" for f in clustering.FEATURES]
    vec = staged(clustering.vectors(clustering.features(site)).withColumn("site_key", F.concat_ws("|", *C.SITE_KEYS)), "vectors")
    labelled = site.join(clustering.best_kmeans(vec, "site_key", DEFAULTS["clusters"]["largest"])[0].select(*C.SITE_KEYS, "cluster_id", *names), C.SITE_KEYS)
    profile = clustering.profiles(labelled)
    return {"cluster_profiles": profile, "cluster_sites": clustering.named_sites(labelled, profile), "cluster_heatmap": clustering.heatmap(labelled, names)}


#: ORC-7: the parameters that stages run with unless others are given.
DEFAULTS: dict[str, dict] = {"clusters": {"largest": 10}, "root_causes": {"lift": 1.2, "least": 10}, "validation": {"k": 5, "seed": 42}}

STAGES: dict[str, Stage] = {
    "score": Stage(("master",), _scores, ("scored",)),
    "risk": Stage(("scored",), lambda t: {"risk": scoring.subject_risk(t["scored"])}, ("risk",)),
    "site_metrics": Stage(("risk",), lambda t: {"site_metrics": rollup.site_metrics(t["risk"])}, ("site_metrics",)),
    "site": Stage(("site_metrics",), lambda t: {"site": rollup.site_risk(t["site_metrics"])}, ("site",)),
    "levels": Stage(("site",), lambda t: {"study": rollup.study_rollup(t["site"]), "region": rollup.region_rollup(t["site"]), "country": rollup.country_rollup(t["site"])}, ("study", "region", "country")),
    "graph": Stage(("risk", "site", "study", "region", "country"), lambda t: {"nodes": graph.nodes(t["risk"], t["site"], t["study"], t["region"], t["country"]), "edges": graph.edges(t["risk"], t["site"], t["country"])}, ("nodes", "edges")),
    "recommendations": Stage(("risk", "site"), lambda t: {"subject_recommendations": recommend.subjects(t["risk"]), "site_recommendations": recommend.sites(t["site"]), "study_recommendations": recommend.studies(t["site"]), "region_recommendations": recommend.regions(t["site"]), "country_recommendations": recommend.countries(t["site"])}, ("subject_recommendations", "site_recommendations", "study_recommendations", "region_recommendations", "country_recommendations")),
    "anomalies": Stage(("site", "region", "country"), lambda t: {"anomalies": anomaly.detect(t["site"], t["country"], t["region"])}, ("anomalies",)),
    "anomaly_scores": Stage(("anomalies",), lambda t: {"site_scores": anomaly.site_scores(t["anomalies"])}, ("site_scores",)),
    "perspectives": Stage(("site", "site_scores", "study", "country"), lambda t: {"consensus": perspectives.consensus(perspectives.enrich(t["site"], t["site_scores"], t["study"], t["country"]))}, ("consensus",)),
    "clusters": Stage(("site",), _clusters, ("cluster_profiles", "cluster_sites", "cluster_heatmap")),
    "root_causes": Stage(("risk", "site", "region", "country"), lambda t: {"cooccurrence": (pairs := rootcause.cooccurrence(t["risk"])), "geography": (g := rootcause.geographic(t["site"], t["country"], t["region"])), "causes": rootcause.root_causes(t["site"], g, rootcause.patterns(pairs, **DEFAULTS["root_causes"]))}, ("cooccurrence", "geography", "causes")),
    "validation": Stage(("risk",), lambda t: {"folds": validation.folds(t["risk"], **DEFAULTS["validation"]), "sensitivity": validation.sensitivity(t["risk"])}, ("folds", "sensitivity")),
}


def check_config() -> None:
    """ORC-8, DQI-12."""
    if not scoring.check_weights():
        raise ValueError("weights must sum to 1")
    if set(C.SUMMED) - set(C.ISSUE_COLUMNS):
        raise ValueError("a weighted feature is no issue column")


def order(wanted: list[str] | None = None) -> list[str]:
    """ORC-2: the stages wanted and those that they need, in order."""
    by_table = {o: n for n, s in STAGES.items() for o in s.outputs}
    out: list[str] = []

    def add(name: str) -> None:
        for r in STAGES[name].requires:
            if r in by_table:
                add(by_table[r])
        if name not in out:
            out.append(name)

    for name in wanted or STAGES:
        add(name)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path}/_SUCCESS")


# What a run needs.
PACKAGES = ["pyspark", "pyarrow", "pandas", "numpy"]
LEAST_PYTHON = (3, 8)
LEAST_BYTES = 100 << 20


def preflight(spark: SparkSession, source: str, to: str, workbooks: bool = False) -> list[str]:
    """ORC-6: what is missing before a run: Python, packages, data, room where results go (as their file system tells it)."""
    out = [] if sys.version_info >= LEAST_PYTHON else [f"Python {'.'.join(map(str, LEAST_PYTHON))} or later is needed"]
    for name in PACKAGES:
        try:
            importlib.import_module(name)
        except ImportError:
            out.append(f"package {name} is missing")
    need = [source] if workbooks else [f"{source}/{t}.parquet" for t in ("region", "nation", "customer", "orders", "lineitem")]
    out += [f"{p} is missing" for p in need if not files.exists(spark, p)]
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus().getRemaining() < LEAST_BYTES:
        out.append(f"less than {LEAST_BYTES >> 20} MB are free at {to}")
    return out


def subject_table(spark: SparkSession, source: str, workbooks: bool = False) -> DataFrame:
    """The subject table of the driver's tables, or of a folder of workbooks."""
    if not workbooks:
        return master.master_subject(projection.spine(spark, source), projection.facts(spark, source))
    spine, extracts, issues = workbook.load(spark, source)
    for r in issues.limit(100).collect():  # log lines, not data
        log.warning("%s: %s", r.path, r.issue)
    files.missing_columns(spine, ["study", "subject_id", "site_id", "country", "region", "subject_status"], strict=True)
    return master.master_subject(spine, extracts)


def run(spark: SparkSession, sf_dir: str, to: str, wanted: list[str] | None = None, again: bool = False, workbooks: bool = False) -> list[str]:
    """ORC-3..5: write every stage's tables as Parquet under ``to``; what is there already is skipped unless ``again``. The first failure ends the run. Gives the stages that ran."""
    check_config()
    ran = []
    if again or not _exists(spark, f"{to}/master"):
        subject_table(spark, sf_dir, workbooks).write.mode("overwrite").parquet(f"{to}/master")
        ran.append("master")
    for name in order(wanted):
        stage = STAGES[name]
        if not again and all(_exists(spark, f"{to}/{o}") for o in stage.outputs):
            log.info("stage %s is complete", name)
            continue
        tables = {r: spark.read.parquet(f"{to}/{r}") for r in stage.requires}
        for table, df in stage.make(tables).items():
            df.write.mode("overwrite").parquet(f"{to}/{table}")
        ran.append(name)
    return ran


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exports(spark: SparkSession, to: str) -> list[str]:
    """SNK-3..6: reports, summaries and the graph's document, of the tables that stages have written, under ``to``/exports. Gives the files' names."""
    have = {o for s in STAGES.values() for o in (*s.requires, *s.outputs) if _exists(spark, f"{to}/{o}")}
    texts: dict[str, Callable[[], str]] = {}

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{to}/{name}")

    def add(name: str, needs: set[str], make: Callable[[], str]) -> None:
        if needs <= have:
            texts[name] = make

    add("index.md", {"risk", "scored", "site"}, lambda: reports.index_report(rollup.distribution(t("risk"), "risk_category"), scoring.checks(t("risk"), t("site")), scoring.component_statistics(t("scored")), scoring.overrides(t("risk"))))
    add("anomalies.md", {"anomalies", "site_scores"}, lambda: reports.anomaly_report(anomaly.summary(t("anomalies")), t("site_scores"), t("anomalies")))
    add("anomalies.json", {"anomalies", "site_scores"}, lambda: json.dumps(reports.anomaly_summary(anomaly.summary(t("anomalies")), t("site_scores")), indent=1))
    add("perspectives.md", {"consensus"}, lambda: reports.consensus_report(t("consensus")))
    add("clusters.md", {"cluster_profiles"}, lambda: reports.cluster_report(t("cluster_profiles")))
    add("graph.md", {"nodes", "edges", "risk", "study"}, lambda: reports.graph_report(graph.counts(t("nodes"), t("edges")), graph.risk_by_country(t("risk")), t("study")))
    add("site_actions.txt", {"site_recommendations"}, lambda: reports.site_actions(t("site_recommendations")))
    add("summary.txt", {"risk", "site", "site_recommendations", "subject_recommendations", "region_recommendations", "country_recommendations"}, lambda: reports.executive_summary(recommend.action_items(t("risk"), t("site"), t("site_recommendations"), t("region_recommendations"), t("country_recommendations")), t("site_recommendations"), recommend.issue_totals(t("subject_recommendations"))))
    add("root_causes.txt", {"causes", "cooccurrence", "geography"}, lambda: reports.root_cause_report(t("causes"), rootcause.patterns(t("cooccurrence"), **DEFAULTS["root_causes"]), t("geography")))
    if {"folds", "sensitivity", "risk"} <= have:
        pred = validation.predictions(t("folds"), DEFAULTS["validation"]["k"])
        folds = staged(validation.fold_results(pred, t("risk")), "fold_results")
        texts["validation.md"] = lambda: reports.validation_report(folds, validation.stability(folds), validation.rank_correlation(pred), t("sensitivity"))
        texts["validation.json"] = lambda: json.dumps(reports.validation_summary(folds, validation.stability(folds), t("sensitivity")), indent=1)
    for name, make in texts.items():
        _put(spark, f"{to}/exports/{name}", make())
    out = list(texts)
    if {"nodes", "edges"} <= have:
        documents.write_graphml(t("nodes"), t("edges"), f"{to}/exports/graph.graphml")
        out.append("graph.graphml")
    return out


def main(arguments: list[str] | None = None) -> int:
    """ORC-2: python -m trialpulse.plans.pipeline SOURCE OUT [--stages a,b] [--again] [--workbooks] [--exports] [--list]."""
    p = argparse.ArgumentParser(prog="trialpulse", description="Run the stages of the data quality pipeline.")
    p.add_argument("source", nargs="?", help="folder of the tables, or of the workbooks")
    p.add_argument("to", nargs="?", help="folder for the results")
    p.add_argument("--stages", help="stages to run, with those that they need; all unless given")
    p.add_argument("--again", action="store_true", help="run stages again that are complete")
    p.add_argument("--workbooks", action="store_true", help="the source is a folder of workbooks")
    p.add_argument("--exports", action="store_true", help="write reports and documents of the results")
    p.add_argument("--list", action="store_true", help="name the stages and end")
    o = p.parse_args(arguments)
    if o.list:
        print("\n".join(STAGES))
        return 0
    wanted = o.stages.split(",") if o.stages else None
    if not o.source or not o.to or set(wanted or ()) - set(STAGES):
        p.print_usage(sys.stderr)
        return 2
    spark = SparkSession.builder.appName("trialpulse").getOrCreate()
    if missing := preflight(spark, o.source, o.to, o.workbooks):
        print("\n".join(missing), file=sys.stderr)
        return 1
    print("\n".join(run(spark, o.source, o.to, wanted, o.again, o.workbooks)))
    if o.exports:
        print("\n".join(exports(spark, o.to)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
