"""Discovery, workbooks, exports, the stage runner, streams, and agreement of queries with their SQL."""

import json
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialpulse import catalog
from trialpulse.operators import graph
from trialpulse.plans import pipeline
from trialpulse.sources import discovery, documents, files, sheets, sinks, workbook
from trialpulse.streaming import rescore

SMALL = "/root/testdata/sf0.001"


def test_first_matching_type_wins_and_columns_are_found():
    assert discovery.find_column(["Site", "Subject ID (x)"], ["Subject ID"]) == "Subject ID (x)"
    headers = ["Subject Name", "Subject"]
    assert discovery.find_column(headers, ["Subject ID", "Subject"]) == "Subject"
    assert discovery.find_column(["My Site Number", "Site ID"], ["Site Number", "Site ID"]) == "My Site Number"
    assert discovery.find_column(["My Site Number", "Site ID"], ["Site Number", "Site ID"], exact_first=True) == "Site ID"


def test_file_issues(spark):
    files = spark.createDataFrame([("/d/Study_1/Compiled_EDRR.xlsx",), ("/d/Study_1/odd.xlsx",)], "path string")
    headers = spark.createDataFrame([("edrr", "Subject", 0)], "file_type string, header string, position int")
    got = {(r.issue, r.detail) for r in discovery.issues(discovery.file_mapping(files), headers).collect()}
    assert ("unknown_file", "odd.xlsx") in got and ("missing_column", "edrr.open_issues") in got and ("missing_type", "inactivated") in got and ("missing_type", "edrr") not in got


def _xlsx(path: Path, sheets: dict[str, list[list[str]]]) -> None:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{j + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row) if v) + "</row>" for j, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx", {"SAE Dashboard": [["Report"], ["Patient ID", "Site", "Review Status"], ["p1", "s1", "Open"], ["p2", "", "Review Completed"], ["Responsible: x"]], "Other": [["Patient ID"], ["p9"]]})
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    cells = workbook.scan(spark, str(tmp_path))
    assert cells.where("error is not null").count() == 1
    got = workbook.table(cells, "sae_dashboard", "SAE|Dashboard").orderBy("subject_id").collect()
    assert [(r.subject_id, r.site_id, r.review_status, r._source_sheet) for r in got] == [("p1", "s1", "Open", "SAE Dashboard"), ("p2", None, "Review Completed", "SAE Dashboard")]


def test_headers_that_match_by_substring_only(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx", {"SAE Dashboard": [["Subject ID (EDC)", "", "Site Location", "Case Review Status"], ["p1", "x", "s1", "Open"]]})
    _xlsx(tmp_path / "b.xlsx", {"SAE Dashboard": [["Review Status", "Patient ID"], ["Review Completed", "p2"]]})
    got = workbook.table(workbook.scan(spark, str(tmp_path)), "sae_dashboard").orderBy("subject_id").collect()
    assert [(r.subject_id, r.site_id, r.review_status) for r in got] == [("p1", "s1", "Open"), ("p2", None, "Review Completed")]


def test_a_task_reads_a_sheet_and_filters_drop_sheets(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx", {"SAE Dashboard": [["x", "", "1"], [], ["y"]], "Other": [["z"]]})
    _xlsx(tmp_path / "b.xlsx", {"Other": [["w"]]})
    cells = sheets.read(spark, str(tmp_path))
    got = {(r.path.rpartition("/")[2], r.sheet, r.row): r.cells for r in cells.collect()}
    assert got == {("a.xlsx", "SAE Dashboard", 0): ["x", None, "1"], ("a.xlsx", "SAE Dashboard", 1): [], ("a.xlsx", "SAE Dashboard", 2): ["y"], ("a.xlsx", "Other", 0): ["z"], ("b.xlsx", "Other", 0): ["w"]}
    assert cells.rdd.getNumPartitions() == 3 and sheets.read(spark, str(tmp_path), "sae|dash").rdd.getNumPartitions() == 1
    one = cells.where("sheet = 'Other' and path like '%b.xlsx' and row < 9")
    assert [r.cells for r in one.collect()] == [["w"]] and one.rdd.getNumPartitions() == 1


def test_a_large_sheet_is_read_in_bounded_memory(tmp_path):
    import tracemalloc

    n = 60_000
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    _xlsx(tmp_path / "a.xlsx", {"S": [["x"]]})
    with zipfile.ZipFile(tmp_path / "a.xlsx") as old, zipfile.ZipFile(tmp_path / "big.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        for name in old.namelist()[:-1]:
            z.writestr(name, old.read(name))
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>s{i}</t></si>" for i in range(500)) + "</sst>")
        with z.open("xl/worksheets/s1.xml", "w") as out:
            out.write(f"<worksheet {ns}><sheetData>".encode())
            for i in range(n):
                out.write(f'<row><c r="A{i}"><v>{i}</v></c><c r="C{i}" t="s"><v>{i % 500}</v></c></row>'.encode())
            out.write(b"</sheetData></worksheet>")
    reader = sheets.WorkbookReader({"path": str(tmp_path / "big.xlsx")})
    (part,) = reader.partitions()
    tracemalloc.start()
    seen, last = 0, None
    for batch in reader.read(part):
        seen += batch.num_rows
        last = batch.column("cells")[batch.num_rows - 1].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and last == [str(n - 1), None, f"s{(n - 1) % 500}"] and peak < 12 << 20


def test_graphml_is_a_document(spark, tmp_path):
    n = spark.createDataFrame([("a", "Site", 'x<"&'), ("b", "Study", None)], "node_id string, node_type string, name string").repartition(2)
    e = spark.createDataFrame([("a", "b", "IN")], "source string, target string, edge_type string")
    documents.write_graphml(n, e, str(tmp_path / "g.xml"))
    root = ElementTree.parse(tmp_path / "g.xml").getroot()
    assert sorted(x.get("id") for x in root.iter("{http://graphml.graphdrawing.org/xmlns}node")) == ["a", "b"] and len(list(root.iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 1
    assert 'x<"&' in [d.text for d in root.iter("{http://graphml.graphdrawing.org/xmlns}data")]
    documents.write_graphml(n.limit(0), e.limit(0), str(tmp_path / "none.xml"))
    assert not list(ElementTree.parse(tmp_path / "none.xml").getroot().iter("{http://graphml.graphdrawing.org/xmlns}node"))


def test_json_documents_appear_whole_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, t string")
    many = spark.range(1000).repartition(7)
    at = tmp_path / "d.json"
    documents.write_json(str(at), rows=df, more=df.limit(0), many=many)
    got = json.loads(at.read_text())
    assert sorted(got["rows"], key=lambda r: r["n"]) == [{"n": 1, "t": "a|b"}, {"n": 2}] and got["more"] == [] and sorted(r["id"] for r in got["many"]) == list(range(1000))
    before = at.read_text()
    bad = many.select(F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    for name in ("d.json", "new.json"):
        with pytest.raises(Exception, match="no"):
            documents.write_json(str(tmp_path / name), many=bad)
    assert at.read_text() == before and [p.name for p in tmp_path.iterdir()] == ["d.json"]
    assert "| 1 | a\\|b |" in sinks.markdown(df, "T")


def test_neighbours_and_induced_edges(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("d", "c", "x")], "source string, target string, edge_type string")
    core = spark.createDataFrame([("b",)], "node_id string")
    near = graph.neighbours(e, core)
    assert {r.node_id for r in near.collect()} == {"a", "c"}
    assert graph.induced(e, core.union(near)).count() == 2


def test_stages_run_in_order_and_complete_ones_are_skipped(spark, tmp_path):
    assert pipeline.order(["anomalies"]) == ["score", "risk", "site_metrics", "site", "levels", "anomalies"]
    first = pipeline.run(spark, SMALL, str(tmp_path), ["anomalies"])
    assert first == ["master", *pipeline.order(["anomalies"])]
    assert pipeline.run(spark, SMALL, str(tmp_path), ["anomalies"]) == []
    pipeline.run(spark, SMALL, str(tmp_path), ["anomaly_scores", "graph", "validation"])
    made = pipeline.exports(spark, str(tmp_path))
    assert set(made) == {"index.md", "anomalies.md", "anomalies.json", "graph.md", "validation.md", "validation.json", "graph.graphml"}
    at = tmp_path / "exports"
    assert json.loads((at / "anomalies.json").read_text())["total"] == spark.read.parquet(str(tmp_path / "anomalies")).count()
    assert json.loads((at / "validation.json").read_text())["folds"] == 5 and "| Baseline | 0 |" in (at / "validation.md").read_text()
    nodes = [x for x in ElementTree.parse(at / "graph.graphml").getroot().iter("{http://graphml.graphdrawing.org/xmlns}node")]
    assert len(nodes) == spark.read.parquet(str(tmp_path / "nodes")).count()


def test_a_failing_stage_ends_the_run(spark, tmp_path, monkeypatch):
    """ORC-5, ORC-7, ORC-8."""
    assert pipeline.DEFAULTS["validation"]["k"] == 5 and pipeline.DEFAULTS["clusters"]["largest"] == 10
    broken = dict(pipeline.STAGES)
    broken["risk"] = pipeline.Stage(("scored",), lambda t: 1 / 0, ("risk",))
    monkeypatch.setattr(pipeline, "STAGES", broken)
    with pytest.raises(ZeroDivisionError):
        pipeline.run(spark, SMALL, str(tmp_path), ["site_metrics"])
    assert (tmp_path / "scored" / "_SUCCESS").exists() and not (tmp_path / "site_metrics").exists()
    monkeypatch.setattr(pipeline.scoring, "check_weights", lambda: False)
    with pytest.raises(ValueError, match="weights"):
        pipeline.run(spark, SMALL, str(tmp_path))


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    rescore.start(stream, lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("event_type").agg(F.sum("n")).count()
    assert got == events.select("event_type").distinct().count()
    assert rescore.windowed_counts(stream).isStreaming


SAMPLE = ["master_subject", "dqi_risk", "country_rollup", "anomaly_site_score", "rec_site", "geo_patterns", "rank_correlation", "graph_high_risk"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    for a, b in zip(*(sorted(df[columns].astype(str).itertuples(index=False, name=None)) for df in (got, want))):
        assert [x.removesuffix(".0") for x in a] == [x.removesuffix(".0") for x in b]


def test_every_query_has_sql_but_the_models():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"cluster_kmeans", "cluster_gmm", "cluster_pca", "cluster_sites_fitted"}
    assert catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", ["master_subject", "dqi_risk", "site_rollup"])
def test_every_order_feeds_the_extracts(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    for a, b in zip(*(sorted(df[columns].astype(str).itertuples(index=False, name=None)) for df in (got, want))):
        assert [x.removesuffix(".0") for x in a] == [x.removesuffix(".0") for x in b]


def test_from_workbooks_to_site_risk(spark, tmp_path):
    for n, folder in ((1, "Study_1 data"), (2, "study 2")):
        d = tmp_path / "in" / folder
        d.mkdir(parents=True)
        people = [[f"S{n}-{i}", f"site{i % 3}", "France", "EMEA", "Enrolled", "V1"] for i in range(12)]
        _xlsx(d / f"CPID_EDC_Metrics_{n}.xlsx", {"All": [["Report of metrics"], ["Subject ID", "Site ID", "Country", "Region", "Subject Status", "Latest Visit (SV)"], *people]})
        _xlsx(d / "eSAE Dashboard.xlsx", {"SAE Dashboard": [["Patient ID", "Site", "Review Status"], [f"S{n}-1", "site1", "Open"], [f"S{n}-2", "site2", "Review Completed"]]})
        _xlsx(d / "Visit Projection Tracker.xlsx", {"x": [["Site", "Subject", "Visit", "# Days Outstanding"], ["site0", f"S{n}-3", "V2", "40"], ["site0", f"S{n}-3", "V3", "-5"], ["site0", "", "V3", "9"]]})
    (tmp_path / "in" / "study 2" / "EDRR broken.xlsx").write_bytes(b"nothing")
    ran = pipeline.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["site"], workbooks=True)
    assert ran == ["master", "score", "risk", "site_metrics", "site"]
    got = {(r.study, r.subject_id): r for r in spark.read.parquet(str(tmp_path / "out/master")).collect()}
    assert len(got) == 24 and {s for s, _ in got} == {"Study_1", "Study_2"}
    assert got["Study_1", "S1-3"].missing_visit_count == 2 and got["Study_1", "S1-3"].max_days_outstanding == 40
    assert (got["Study_2", "S2-1"].sae_pending_count, got["Study_2", "S2-2"].sae_pending_count, got["Study_2", "S2-2"].sae_total_count) == (1, 0, 1)
    sites = {(r.study, r.site_id): r.high_risk_count for r in spark.read.parquet(str(tmp_path / "out/site")).collect()}
    assert len(sites) == 6 and sites["Study_1", "site1"] == 1 and sites["Study_1", "site2"] == 0
    _, _, issues = workbook.load(spark, str(tmp_path / "in"))
    assert [r.path.rsplit("/", 1)[1].replace("%20", " ") for r in issues.collect()] == ["EDRR broken.xlsx"]


def test_header_rules(spark):
    rows = [("a", 0, ["Project Name", ""]), ("a", 1, ["x"]), ("a", 2, ["Subject ID", "Site"]), ("b", 0, ["Site", "Subject ID"]), ("b", 1, ["Subject"]), ("c", 0, ["Unnamed: 0"]), ("c", 1, ["Patient", "y"]), ("d", 0, ["Country"]), ("d", 1, ["nothing"])]
    cells = spark.createDataFrame(rows, "file string, row long, cells array<string>")
    assert {r.file: r.header_row for r in discovery.edc_header_row(cells).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0}
    assert {r.file: r.header_row for r in discovery.sample_header_row(cells).collect()} == {"a": 2, "b": 0, "c": 1, "d": 0}
    assert {r.path.rstrip("/").rsplit("/", 1)[1] for r in discovery.list_files(spark, SMALL, "region.parquet").collect()} == {"region.parquet"}


def test_flat_files_and_value_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('site,days_open,note\ns1,-2,"a, b"\ns2,4000,\n')
    (tmp_path / "a.json").write_text('{"causes": [{"id": 1}, {"id": 2}]}')
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("s1", -2, "a, b"), ("s2", 4000, None)] and files.read_csv(spark, str(tmp_path / "b.csv"), optional=True) is None
    assert len(files.read_json(spark, str(tmp_path / "a.json")).first().causes) == 2 and files.read_text(spark, str(tmp_path / "a.json")).first().value.startswith("{")
    got = {(r.column, r.issue): r.n for r in files.value_issues(df, {"days_open": (0, 10)}).collect()}
    assert got == {("days_open", "negative values set to 0"): 1, ("days_open", "values above 1825 capped"): 1, ("days_open", "values below 0"): 1, ("days_open", "values above 10"): 1}
    assert [r.days_open for r in files.clean(df).collect()] == [0, 1825]
    assert files.missing_columns(df, ["site", "region"]) == ["region"]
    with pytest.raises(ValueError, match="region"):
        files.missing_columns(df, ["region"], strict=True)


def test_command_line_and_preflight(spark, tmp_path, capsys):
    assert pipeline.main(["--list"]) == 0 and "clusters" in capsys.readouterr().out
    assert pipeline.main([]) == 2 and pipeline.main([SMALL, str(tmp_path), "--stages", "none"]) == 2
    assert pipeline.preflight(spark, SMALL, str(tmp_path)) == []
    assert any("orders" in m for m in pipeline.preflight(spark, str(tmp_path), str(tmp_path)))


def test_cluster_names_reach_the_sites(spark):
    from trialpulse.operators import clustering, portfolio

    site = spark.createDataFrame([("s", "a", 0, 1.0, 5, 1), ("s", "b", -1, 2.0, 5, 0), ("s", "c", 0, 3.0, 5, 1)], "study string, site_id string, cluster_id int, avg_dqi_score double, subject_count long, high_risk_count long")
    profile = spark.createDataFrame([(0, "Safety Concerns", "Critical", 1)], "cluster_id int, cluster_name string, risk_level string, intervention_priority int")
    named = clustering.named_sites(site, profile)
    assert {r.site_id: r.cluster_name for r in named.collect()} == {"a": "Safety Concerns", "b": "Noise", "c": "Safety Concerns"}
    assert {r.cluster_name: (r.site_count, r.avg_dqi_score) for r in portfolio.cluster_comparison(named).collect()} == {"Safety Concerns": (2, 2.0), "Noise": (1, 2.0)}


def test_rows_are_numbered_in_order(spark):
    from trialpulse.functions import stats as S

    got = S.numbered(spark.range(0, 5000, 7).select((F.col("id") * 37 % 5003).alias("k")), "k", 9).orderBy("number").collect()
    assert [r.number for r in got] == list(range(len(got))) and [r.k for r in got] == sorted(r.k for r in got)


def test_reports_name_what_is_urgent(spark):
    from trialpulse.queries import Domain
    from trialpulse.operators import recommend, rootcause
    from trialpulse.sources import reports

    d = Domain(spark, SMALL)
    sites = recommend.sites(d.site)
    items = recommend.action_items(d.risk, d.site, sites, recommend.regions(d.site), recommend.countries(d.site))
    first = recommend.first_sites(sites, 1).first()
    text = reports.executive_summary(items, sites, recommend.issue_totals(recommend.subjects(d.risk)))
    assert f"1. [{first.priority}] {first.study} - {first.site_id}" in text and "instances" in text
    assert f"1. {first.study} - {first.site_id}" in reports.site_actions(sites, 3)
    text = reports.root_cause_report(d.causes, rootcause.patterns(rootcause.cooccurrence(d.risk), least=1), d.geography)
    assert "RC001" in text and "CO-OCCURRENCE\n* " in text


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_keeps_the_metrics_of_the_table(spark, tmp_path, seed):
    from trialpulse.operators import master
    from trialpulse.plans import projection
    from trialpulse.streaming import subjects

    facts = projection.facts(spark, SMALL).withColumn("fact_id", F.concat_ws("-", F.lit("f"), F.monotonically_increasing_id())).toPandas()
    rng = np.random.default_rng(seed)
    facts = facts.sample(min(len(facts), 150), random_state=3).assign(version=1, withdrawn=False)
    later = facts.sample(40, random_state=seed).assign(version=2)
    later["open_issues"] = "3"
    gone = facts.sample(25, random_state=seed + 7).assign(version=3, withdrawn=True)
    rows = pd.concat([facts, later, gone, later.head(5)])
    schema = "file_type string, days_outstanding int, review_status string, days_missing int, coding_status string, open_issues string, study string, subject_id string, fact_id string, version long, withdrawn boolean"
    rows = rows[[c.split()[0] for c in schema.split(", ")]]

    def table(pdf):
        return spark.createDataFrame([tuple(None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r) for r in pdf.itertuples(index=False, name=None)], schema)

    order = rng.permutation(len(rows))
    for i, part in enumerate(np.array_split(order, 3)):
        table(rows.iloc[part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rescore.start(subjects.metrics(stream), lambda b: b, str(tmp_path / "out"), str(tmp_path / "check"), mode="update").awaitTermination()
    final = rows.sort_values("version").drop_duplicates("fact_id", keep="last")
    want = master.metrics(table(final[~final.withdrawn.astype(bool)]))
    got = subjects.latest(spark, str(tmp_path / "out"))
    assert want.count() == got.count() > 50 and want.exceptAll(got.select(want.columns)).count() == 0


def test_every_report_has_its_tables(spark):
    from trialpulse.operators import validation
    from trialpulse.sources import reports

    frame = spark.createDataFrame
    anomalies = frame([("s", "a", "HIGH", "x", "m"), ("s", "b", "CRITICAL", "what | is wrong", "m")], "study string, site_id string, severity string, description string, metric string")
    scores = frame([("s", "a", 0.2, 1, 0, 1, True), ("s", "b", 0.9, 2, 1, 0, True)], "study string, site_id string, anomaly_score double, anomaly_count long, critical_count long, high_count long, is_anomaly boolean")
    summary = frame([("severity", "HIGH", 1), ("severity", "CRITICAL", 1), ("anomaly_type", "PATTERN_ANOMALY", 2)], "kind string, name string, n long")
    text = reports.anomaly_report(summary, scores, anomalies)
    assert text.index("| s | b | 0.9 | 2 | critical |") < text.index("| s | a | 0.2 | 1 | high |") and "what \\| is wrong" in text and "Pattern Anomaly" in text
    assert reports.anomaly_summary(summary, scores, 1) == {"total": 2, "sites": 2, "by_severity": {"high": 1, "critical": 1}, "by_type": {"pattern_anomaly": 2}, "top_sites": [{"study": "s", "site_id": "b", "anomaly_score": 0.9, "anomaly_count": 2}]}
    levels = frame([("High", 1), ("Medium", 0), ("Low", 3)], "category string, n long")
    checks = frame([("sae_capture", True)], "check_name string, passed boolean")
    features = frame([("lab_issues_count", 0.1, "t", 2, 5.0)], "feature string, weight double, tier string, n_positive long, max_raw double")
    text = reports.index_report(levels, checks, features, frame([(4, 1)], "sae_subjects long, overridden long"))
    assert "| High | 1 | 25.0% |" in text and "| Sae Capture | yes |" in text and "| 4 | 1 |" in text
    folds = frame([(1, 10, 0.2, 0.9, 1.0)], "fold int, test_size long, threshold double, agreement double, sae_capture double")
    spread, ranks = validation.stability(folds), frame([], "fold_a int, fold_b int, common_sites long, correlation double")
    weights = frame([("Baseline", 0, 0.0, 100.0, 1.0), ("Inverted", 3, 30.0, 100.0, 0.4)], "scenario string, category_shifts long, shift_pct double, sae_capture_pct double, rank_correlation double")
    text = reports.validation_report(folds, spread, ranks, weights)
    assert "Nothing to report." in text and "| Inverted | 3 | 30 | 100 | 0.4 |" in text
    assert reports.validation_summary(folds, spread, weights)["most_sensitive"] == {"scenario": "Inverted", "rank_correlation": 0.4, "shift_pct": 30.0}
    profiles = frame([(0, "Safety Concerns", "Critical", 1, 3, 30.0, 0.3, 0.2, "SAE Pending")], "cluster_id int, cluster_name string, risk_level string, intervention_priority int, site_count long, pct_of_total double, avg_dqi_score double, avg_high_risk_rate double, dominant_issues string")
    assert "| 0.6 | excellent |" in reports.cluster_report(profiles, 0.6) and "Mixtures" not in reports.cluster_report(profiles)
    views = frame([("s", "a", 1, "Critical", 0.7, True, "t", "do")], "study string, site_id string, priority int, risk_category string, composite_score double, escalation_required boolean, top_issues string, recommended_actions string")
    assert "| s | a | 1 | 0.7 | yes | t | do |" in reports.consensus_report(views)
    size = frame([("node", "Site", 3)], "what string, kind string, n long")
    country = frame([("US", "High", 2), ("US", "Low", 9)], "country string, risk_category string, n long")
    assert "| US | 2 |" in reports.graph_report(size, country, frame([("s", 3)], "study string, site_count long"))
    files_ = discovery.file_mapping(frame([("/d/Study_1/Compiled_EDRR.xlsx",), ("/d/Study_1/odd.xlsx",)], "path string"))
    text = reports.discovery_report(files_, discovery.issues(files_, frame([("edrr", "Subject", 0)], "file_type string, header string, position int")))
    assert "| edrr | 1 | 1 |" in text and "odd.xlsx" in text


def test_exports_and_scaling(spark, tmp_path):
    from trialpulse.operators import clustering, master

    df = spark.createDataFrame([("a", ["x", "y"], 1)], "k string, l array<string>, n int")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert [r.asDict() for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [{"k": "a", "l": "x; y", "n": "1", "first_l": "x"}]
    got = discovery.standardise(spark.createDataFrame([("1", "s")], "`Patient ID` string, Odd string"), "sae_dashboard")
    assert got.columns == ["subject_id", "Odd"] and discovery.standardise(got, "no such type").columns == got.columns
    sites = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 6.0, 5.0)], "cluster_id int, a double, b double")
    assert sorted(map(tuple, clustering.heatmap(sites, ["a", "b"]).collect())) == [(0, 0.0, 0.0), (1, 1.0, 0.0)]
    assert [r.v for r in spark.createDataFrame([("-3",), ("12",), ("9999",), ("x",)], "v string").select(master.clamped_days(F.col("v")).alias("v")).collect()] == [0.0, 12.0, 1825.0, None]
