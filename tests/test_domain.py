"""Rules of the index and its analyses, on small tables with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialpulse import catalog
from trialpulse import config as C
from trialpulse.operators import anomaly, clustering, master, models, rollup, rootcause, scoring, silhouette, validation
from trialpulse.operators import recommend as R

SMALL = "/root/testdata/sf0.001"


def subjects(spark, rows):
    """rows: (study, subject_id, site_id, {issue: count})."""
    full = [(s, i, site, "C", "R", *(issues.get(c, 0) for c in C.ISSUE_COLUMNS)) for s, i, site, issues in rows]
    return spark.createDataFrame(full, "study string, subject_id string, site_id string, country string, region string, " + ", ".join(f"{c} long" for c in C.ISSUE_COLUMNS))


def test_weights_sum_to_one():
    assert scoring.check_weights() and not scoring.check_weights({"a": 0.9})


@pytest.mark.parametrize(("n", "ref"), [(19, 100.0), (20, 81.0)])
def test_reference_switches_to_p95_at_twenty_values(spark, n, ref):
    rows = [("s", str(i), "1", {"lab_issues_count": 80 if i else 100}) for i in range(n)] + [("s", "zero", "1", {})]
    got = scoring.reference_max(scoring.with_issue_types(subjects(spark, rows))).first()
    assert got.lab_issues_count_ref == pytest.approx(ref) and got.edrr_open_issues_ref == 1.0


def test_scores_and_the_safety_override(spark):
    df = subjects(spark, [("s", "a", "1", {"sae_pending_count": 1}), ("s", "b", "1", {"lab_issues_count": 2}), ("s", "c", "1", {})])
    risk = {r.subject_id: r for r in scoring.subject_risk(scoring.score_subjects(df)).collect()}
    # presence and full severity of the feature, and of the number of issue types
    assert risk["a"].dqi_score == pytest.approx(0.20 + 0.05) and risk["b"].dqi_score == pytest.approx(0.10 + 0.05) and risk["c"].dqi_score == 0
    assert [risk[k].risk_category for k in "abc"] == ["High", "High", "Low"]
    assert risk["a"].threshold == pytest.approx(0.15)
    only_sae = scoring.score_subjects(subjects(spark, [("s", "a", "1", {"sae_pending_count": 1})]))
    assert scoring.subject_threshold(only_sae).first().threshold == C.SUBJECT_FALLBACK


def test_cleaning(spark):
    x = spark.createDataFrame([("-3",), ("12",), ("9999",), ("text",), (None,)], "v string")
    assert [r[0] for r in x.select(master.clamped_days(F.col("v"))).collect()] == [0.0, 12.0, 1825.0, None, None]
    y = spark.createDataFrame([(" a ",), ("",), ("nan",), (None,)], "v string")
    assert [r[0] for r in y.select(master.fill_category(F.col("v"))).collect()] == ["a", "Unknown", "Unknown", "Unknown"]
    z = spark.createDataFrame([("Review Completed",), ("Open",), (None,)], "review_status string")
    assert [r[0] for r in z.select(master.pending(z)).collect()] == [False, True, True]
    u = spark.createDataFrame([("Coded",), ("UnCoded",), ("not coded",), (None,)], "coding_status string")
    assert [r[0] for r in u.select(master.uncoded(u)).collect()] == [False, True, True, False]
    assert [r[0] for r in z.select(master.uncoded(z)).collect()] == [True] * 3


def test_outliers_are_capped_unless_quartiles_meet(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 3, 4, 1000)] + [(None, None)], "a double, b double")
    got = master.cap_outliers(df, ["a", "b"]).collect()
    assert max(r.a for r in got if r.a is not None) == 4 + 3 * 2 and {r.b for r in got} == {5.0, None}
    with pytest.raises(ValueError, match="unknown method"):
        master.cap_outliers(df, ["a"], method="none")


def test_extracts_make_one_row_a_subject_and_duplicates_of_the_spine_stay(spark):
    spine = spark.createDataFrame([("s", " 1 ", "x"), ("s", "1", "x"), ("s", "2", None)], "study string, subject_id string, site_id string").withColumns({c: F.lit("") for c in ("country", "region", "subject_status", "latest_visit")})
    visits = spark.createDataFrame([("s", "1 ", "10"), ("s", "1", "bad"), ("s", "3", "7"), ("s", None, "1")], "study string, subject_id string, days_outstanding string")
    sae = spark.createDataFrame([("s", "1", "Review Completed"), ("s", "1", None)], "study string, subject_id string, review_status string")
    got = master.master_subject(spine, {"visit_tracker": visits, "sae_dashboard": sae})
    one = got.where("subject_id = '1'").collect()
    assert len(one) == 2 and all((r.missing_visit_count, r.max_days_outstanding, r.sae_total_count, r.sae_pending_count) == (2, 10, 2, 1) for r in one)
    assert got.count() == 3 and master.duplicates(got).count() == 2


def site_rows(spark, rows):
    columns = {c: "long" for c in ["subject_count", "high_risk_count", "subjects_with_issues", *(f"{f}_sum" for f in C.SUMMED)]} | {"avg_dqi_score": "double", "site_risk_category": "string"}
    full = [(s, i, c, r, *(x.get(k, 0.0 if t == "double" else "Low" if t == "string" else 0) for k, t in columns.items())) for s, i, c, r, x in rows]
    return spark.createDataFrame(full, "study string, site_id string, country string, region string, " + ", ".join(f"{k} {t}" for k, t in columns.items()))


def test_patterns_fire_at_their_thresholds(spark):
    site = site_rows(
        spark,
        [
            ("s", "sae", "c", "r", {"subject_count": 5, "sae_pending_count_sum": 3, "uncoded_meddra_count_sum": 1, "avg_dqi_score": 0.1}),
            ("s", "quiet", "c", "r", {"subject_count": 30}),
            ("s", "stale", "c", "r", {"subject_count": 5, "missing_visit_count_sum": 3, "missing_pages_count_sum": 2, "max_days_page_missing_sum": 45, "avg_dqi_score": 0.1}),
            ("s", "most", "c", "r", {"subject_count": 10, "high_risk_count": 4, "avg_dqi_score": 0.1}),
            ("s", "one", "c", "r", {"subject_count": 5, "lab_issues_count_sum": 12, "missing_visit_count_sum": 4, "avg_dqi_score": 0.1}),
            ("s", "few", "c", "r", {"subject_count": 5, "lab_issues_count_sum": 14, "avg_dqi_score": 0.1}),
        ],
    )
    got = {(r.site_id, r.detection_method) for r in anomaly.pattern(site).collect()}
    assert got == {("sae", "SAE_NOT_FLAGGED"), ("quiet", "ZERO_ISSUES_HIGH_VOLUME"), ("stale", "STALE_MISSING_DATA"), ("most", "MAJORITY_HIGH_RISK"), ("one", "SINGLE_ISSUE_DOMINANCE")}


def test_sites_in_several_studies(spark):
    rows = [(f"s{i}", "all", "c", "r", {"site_risk_category": "High"}) for i in range(2)]
    rows += [(f"s{i}", "some", "c", "r", {"site_risk_category": "High" if i < 2 else "Low"}) for i in range(5)]
    rows += [(f"s{i}", "raised", "c", "r", {"avg_dqi_score": 0.2, "site_risk_category": "High" if i < 1 else "Low"}) for i in range(3)]
    got = {(r.site_id, r.detection_method, r.severity) for r in anomaly.cross_study(site_rows(spark, rows)).collect()}
    assert got == {("all", "REPEAT_OFFENDER", "CRITICAL"), ("some", "REPEAT_OFFENDER", "HIGH"), ("raised", "ELEVATED_DQI_MULTI_STUDY", "MEDIUM")}


def test_roll_ups_keep_totals(spark):
    df = subjects(spark, [(f"s{i % 2}", str(i), f"site{i % 3}", {"lab_issues_count": i % 4, "sae_pending_count": int(i % 7 == 0)}) for i in range(40)] + [("s0", "lost", "", {})])
    risk = scoring.subject_risk(scoring.score_subjects(df))
    site = rollup.site_risk(rollup.site_metrics(risk))
    study = rollup.study_rollup(site)
    assert site.agg(F.sum("subject_count")).first()[0] == study.agg(F.sum("subject_count")).first()[0] == 40
    assert site.where("subject_count = 1 and std_dqi_score <> 0").count() == 0
    checks = {r.check_name: r.passed for r in scoring.checks(risk, site).collect()}
    assert checks["sae_capture"] and checks["capture_rate"] and checks["score_alignment"]


def test_recommendations_are_ordered_by_urgency(spark):
    df = subjects(spark, [("s", "a", "1", {"sae_pending_count": 1, "edrr_open_issues": 2, "uncoded_meddra_count": 1})])
    rec = R.subjects(scoring.subject_risk(scoring.score_subjects(df))).first()
    assert [i.type for i in rec.issues] == ["sae_pending_count", "uncoded_meddra_count", "edrr_open_issues"] and rec.priority == "CRITICAL"


def test_equal_values_share_a_bin_when_edges_collide(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 1, 1, 1, 1, 2, 9)], "subject_count long")
    got = df.crossJoin(rootcause.quantile_edges(df, "subject_count", 4)).select("subject_count", rootcause.quantile_bins(df, "subject_count", rootcause.SIZE_LABELS).alias("b")).distinct()
    assert {(r.subject_count, r.b) for r in got.collect()} == {(1, "Small"), (2, "Very Large"), (9, "Very Large")}


def test_folds_are_even_and_repeatable(spark):
    df = spark.createDataFrame([("s", str(i), "High" if i % 5 == 0 else "Low") for i in range(103)], "study string, subject_id string, risk_category string")
    got = validation.folds(df)
    sizes = [r["count"] for r in got.groupBy("risk_category", "fold").count().collect()]
    assert got.count() == 103 and max(sizes) - min(s for s in sizes if s > 10) <= 1
    assert got.exceptAll(validation.folds(df.repartition(7))).count() == 0


def test_dbscan_and_cluster_metrics(spark):
    pts = [(i, 0.0 + i * 0.1, 0.0) for i in range(10)] + [(20 + i, 5.0 + i * 0.1, 5.0) for i in range(6)] + [(99, 50.0, 50.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.cluster_id for r in clustering.dbscan(df, "id", ["x", "y"], 0.15, 2).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[20 + i] for i in range(6)} == {1} and got[99] == -1
    labelled = df.join(spark.createDataFrame(list(got.items()), "id long, c int"), "id")
    assert clustering.metrics(labelled, "c", ["x", "y"]).first().k == 2
    assert clustering.silhouette(labelled, "id", "c", ["x", "y"]).first().silhouette > 0.9


def test_empty_site_table_gives_no_anomalies(spark):
    assert anomaly.detect(site_rows(spark, [])).count() == 0


def blobs(spark, n=36, spread=0.3):
    rng = np.random.default_rng(5)
    pts = [(i, *(float(v) for v in rng.normal(0, spread, 2) + [(0, 0), (6, 0), (0, 6)][i % 3])) for i in range(n)]
    return clustering.vectors(spark.createDataFrame(pts, "id long, z_x double, z_y double")), np.array([p[1:] for p in pts])


def test_number_of_clusters_by_either_measure(spark):
    vec, _ = blobs(spark)
    assert clustering.choose_k(vec, 4, key="id") == 3 and clustering.choose_k(vec, 3) == 3


@pytest.mark.parametrize("rows", [50_000, 10])
def test_models_of_one_scan_are_those_of_single_fits(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "ROWS", rows)
    vec, x = blobs(spark, 60, 1.5)
    points = models.Points.of(vec, ["z_x", "z_y"])
    assert points.parts == -(-60 // rows)
    first = models.starts(points, 4, 3, 7)
    assert all(min(((x - c) ** 2).sum(1)) == 0 for r in first for c in r) and len({tuple(map(tuple, r)) for r in first}) == 3
    fits = models.lloyd(points, [2, 4], restarts=3, seed=7)
    for m in fits:
        c = first[m.restart, : m.k].copy()
        for _ in range(300):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(m.k)])
            if np.allclose(new, c, atol=1e-9):
                break
            c = new
        assert np.allclose(m.centres, c, atol=1e-6) and m.cost == pytest.approx(((x - m.centres[((x[:, None] - m.centres[None]) ** 2).sum(2).argmin(1)]) ** 2).sum())
    mixtures = models.expectation_maximisation(points, fits)
    for m in mixtures:  # one more step by hand changes next to nothing, and the criteria follow from the likelihood
        dens = np.array([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(s), x - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(s))) for w, mu, s in zip(m.weights, m.means, m.covariances)]).T
        assert m.score == pytest.approx(np.log(dens.sum(1)).mean()) and m.converged
        p = m.k - 1 + m.k * 2 + m.k * 3
        assert m.bic == pytest.approx(-2 * m.score * 60 + p * np.log(60)) and m.aic == pytest.approx(-2 * m.score * 60 + 2 * p)
        r = dens / dens.sum(1, keepdims=True)
        assert np.allclose(m.responsibilities(x)[0], r)
        mu = (r.T @ x) / r.sum(0)[:, None]
        assert np.log((dens).sum(1)).mean() > -10 and abs(mu - m.means).max() < 0.5


def test_one_step_of_a_mixture(spark):
    vec, x = blobs(spark, 45, 1.0)
    points = models.Points.of(vec, ["z_x", "z_y"])
    start = models.lloyd(points, [3], restarts=1)
    (got,) = models.expectation_maximisation(points, start, most=1)
    own = ((x[:, None] - start[0].centres[None]) ** 2).sum(2).argmin(1)
    w, mu = np.bincount(own) / 45, np.array([x[own == k].mean(0) for k in range(3)])
    s = np.array([np.cov(x[own == k].T, bias=True) for k in range(3)]) + 1e-6 * np.eye(2)
    dens = np.array([a * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for a, m, c in zip(w, mu, s)]).T
    r = dens / dens.sum(1, keepdims=True)
    mean = (r.T @ x) / r.sum(0)[:, None]
    assert np.allclose(got.weights, r.mean(0)) and np.allclose(got.means, mean)
    assert np.allclose(got.covariances, [(r[:, k, None] * (x - mean[k])).T @ (x - mean[k]) / r[:, k].sum() + 1e-6 * np.eye(2) for k in range(3)])


def test_mixture_tables(spark):
    vec, _ = blobs(spark)
    out, ranked = clustering.best_mixture(vec, 4, restarts=2)
    shares = clustering.probabilities(out, ["id"]).toPandas()
    assert len(shares) == 36 * ranked[0].k and np.allclose(shares.groupby("id").probability.sum(), 1)
    table = clustering.criteria(spark, ranked).toPandas()
    assert list(table.bic) == sorted(table.bic) and set(table.k) == {2, 3, 4} and (table.aic < table.bic).all()


def silhouette_by_hand(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in np.flatnonzero(label >= 0):
        mine = (label == label[i]) & (np.arange(len(x)) != i)
        others = [d[i][label == k].mean() for k in np.unique(label[label >= 0]) if k != label[i]]
        a, b = (d[i][mine].mean() if mine.any() else None), min(others, default=None)
        out.append(0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return len(out), np.mean(out)


@pytest.mark.parametrize("tile", [2048, 16, 1])
def test_silhouettes_of_many_labellings_by_tiles(spark, tile):
    _, x = blobs(spark, 40, 2.0)
    rng = np.random.default_rng(1)
    labels = np.stack([rng.integers(-1, 3, 40), np.arange(40) % 3, np.zeros(40, int), np.where(np.arange(40) == 5, 7, 1)], 1)
    df = spark.createDataFrame([(i, *map(float, p), [int(v) for v in row]) for i, (p, row) in enumerate(zip(x, labels))], "id long, a double, b double, labels array<int>")
    got = {r.labelling: (r.points, r.silhouette) for r in silhouette.silhouettes(df, "id", "labels", ["a", "b"], tile=tile).collect()}
    for i in range(4):
        n, s = silhouette_by_hand(x, labels[:, i])
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-9)
    assert silhouette.silhouettes(df.where("id < 0"), "id", "labels", ["a", "b"]).collect() == []


def test_silhouettes_shuffle_as_many_bytes_a_point_for_more_points(spark):
    def written():
        return sum(e.totalShuffleWrite() for e in (lambda l: [l.apply(i) for i in range(l.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))

    rng = np.random.default_rng(4)
    x, label = rng.normal(0, 1, (4000, 8)), rng.integers(0, 3, 4000)
    names = [f"x{i}" for i in range(8)]
    sent = []
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, *map(float, x[i]), [int(label[i])]) for i in range(n)], ["id", *names, "labels"]).withColumn("labels", F.col("labels").cast("array<int>"))
        before = written()
        got = silhouette.silhouettes(df, "id", "labels", names, tile=16).first()
        sent.append(written() - before)
        points, mean = silhouette_by_hand(x[:n], label[:n])
        assert (got.points, got.silhouette) == (points, pytest.approx(mean, abs=1e-9))
    assert 0 < sent[1] < 5 * sent[0]


@pytest.mark.parametrize("bound", [60, 1000])
def test_silhouettes_of_more_bands(spark, monkeypatch, bound):
    monkeypatch.setattr(silhouette, "BAND_BYTES", bound)
    _, x = blobs(spark, 40, 2.0)
    label = np.arange(40) % 3
    df = spark.createDataFrame([(i, *map(float, p), [int(label[i])]) for i, p in enumerate(x)], "id long, a double, b double, labels array<int>")
    got = silhouette.silhouettes(df, "id", "labels", ["a", "b"]).first()
    assert (got.points, got.silhouette) == (40, pytest.approx(silhouette_by_hand(x, label)[1], abs=1e-9))


def dbscan_by_hand(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    root = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], root[None], len(x)).min(1), len(x))
        if (new == root).all():
            break
        root = new
    border = np.where(near & core[None], root[None], len(x)).min(1)
    names = {r: i for i, r in enumerate(sorted(set(root[core].tolist())))}
    return [names[r] if r < len(x) else -1 for r in border.tolist()]


@pytest.mark.parametrize("dims, eps, least, chunk", [(2, 0.35, 5, 3), (3, 0.8, 4, 1024), (5, 1.5, 3, 50), (1, 0.02, 2, 4)])
def test_density_clusters_are_those_of_all_pairs(spark, dims, eps, least, chunk):
    rng = np.random.default_rng(dims * 10 + least)
    x = np.concatenate((rng.normal(0, 0.5, (70, dims)), rng.normal(3, 0.7, (50, dims)), rng.uniform(-4, 6, (40, dims))))[rng.permutation(160)].round(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"f{k} double" for k in range(dims))).repartition(3)
    got = dict(map(tuple, clustering.dbscan(df, "id", [f"f{k}" for k in range(dims)], eps, least, chunk=chunk).collect()))
    assert [got[i] for i in range(160)] == dbscan_by_hand(x, eps, least)


def test_a_dense_cell_makes_no_pairs(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 1000 / 1e6).alias("x"), (F.floor(F.col("id") / 1000) / 1e6).alias("y"))
    got = clustering.dbscan(df.union(spark.createDataFrame([(100_000, 0.9, 0.0), (100_001, 9.0, 9.0)], "id long, x double, y double")), "id", ["x", "y"], 1.0, 5)
    assert {r.cluster_id: r["count"] for r in got.groupBy("cluster_id").count().collect()} == {0: 100_001, -1: 1}


def test_dbscan_of_sites_uses_every_feature(spark):
    site = catalog.QUERIES["cluster_features"](spark, SMALL).toPandas()
    got = catalog.QUERIES["cluster_dbscan"](spark, SMALL).toPandas()
    both = site.merge(got, on=C.SITE_KEYS)
    x = both[[f"z_{f}" for f in clustering.FEATURES]].to_numpy()
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.25
    core = near.sum(1) >= 5
    reach = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        reach = np.array([min((reach[j] for j in range(len(x)) if core[j] and near[i, j]), default=-1) if core[i] else -1 for i in range(len(x))])
    assert len(both) == len(site) == len(got) and core.any()
    label = both.cluster_id.to_numpy()
    assert all((label[i] == label[j]) == (reach[i] == reach[j]) for i in np.flatnonzero(core) for j in np.flatnonzero(core))
    assert ((label >= 0) == (near & core[None]).any(1)).all()


def test_cluster_metrics_use_every_component(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x, label = np.array([np.asarray(v, float) for v in e.embedding]), e.label.to_numpy()
    names = np.unique(label)
    centre = np.array([x[label == k].mean(0) for k in names])
    own = np.searchsorted(names, label)
    within, between = ((x - centre[own]) ** 2).sum(), sum((label == k).sum() * ((c - x.mean(0)) ** 2).sum() for k, c in zip(names, centre))
    spread = np.array([np.sqrt(((x[label == k] - c) ** 2).sum(1)).mean() for k, c in zip(names, centre)])
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1)) + np.diag([np.inf] * len(names))
    got = catalog.QUERIES["cluster_metrics"](spark, SMALL).first()
    assert x.shape[1] == 64 and got.k == len(names)
    assert got.calinski_harabasz == pytest.approx((between / (len(names) - 1)) / (within / (len(x) - len(names))), rel=1e-4)
    assert got.davies_bouldin == pytest.approx(((spread[:, None] + spread[None]) / gap).max(1).mean(), rel=1e-4)


def test_percentiles_are_exact_in_two_passes(spark):
    from trialpulse.functions import stats as S

    df = spark.range(30_000).select((F.xxhash64("id") % 100_000).cast("double").alias("x"), (F.col("id") % 2).alias("g")).withColumn("x", F.when(F.col("x") > -90_000, F.col("x")))
    shares = (0.0, 0.5, 0.9, 1.0)
    got = S.percentiles(df, **{f"p{i}": (F.col("x"), p) for i, p in enumerate(shares)}, none=(F.when(F.col("x") > 1e9, F.col("x")), 0.5)).first()
    assert [got[f"p{i}"] for i in range(4)] == [df.agg(F.percentile("x", F.lit(p))).first()[0] for p in shares] and got.none is None


def test_ranks_of_ranges_are_those_of_whole_groups(spark):
    from trialpulse.functions import stats as S

    rng = np.random.default_rng(9)
    pairs = pd.DataFrame({"g": rng.integers(0, 3, 900), "x": np.where(rng.random(900) < 0.4, 0.0, rng.integers(0, 60, 900) / 7), "y": rng.integers(0, 50, 900) * 1.0})
    pairs.loc[pairs.g == 2, "y"] = 1.0
    got = {r.g: (r.n, r.correlation) for r in S.spearman(spark.createDataFrame(pairs), ["g"]).collect()}
    for g, rows in pairs.groupby("g"):
        want = rows.x.rank().corr(rows.y.rank())
        assert got[g][0] == len(rows) and (got[g][1] is None if g == 2 else got[g][1] == pytest.approx(want))


def test_folds_by_subtraction_are_those_of_copies(spark):
    rng = np.random.default_rng(4)
    rows = [("s", str(i), f"site{i % 4}", {"lab_issues_count": int(rng.integers(0, 9)) if i % 3 else 0, "missing_visit_count": int(i % 29 == 0) * int(i), "sae_pending_count": int(i % 40 == 0)}) for i in range(240)]
    risk = scoring.subject_risk(scoring.score_subjects(subjects(spark, rows)))
    folded = validation.folds(risk)
    refs = validation.fold_references(folded, 5).first().refs
    table, names = folded.toPandas(), list(validation.WEIGHTS)
    for f in range(1, 6):
        for train in (0, 1):
            part = table[(table.fold != f) == bool(train)]
            for i, c in enumerate(names):
                x = part[c][part[c] > 0].astype(float)
                want = max(1.0, (np.percentile(x, 95) if len(x) >= C.MIN_FOR_P95 else x.max()) if len(x) else 1.0)
                assert refs[((f - 1) * 2 + train) * len(names) + i] == pytest.approx(want)
    plan = validation.predictions(folded)._jdf.queryExecution().toString()
    assert validation.predictions(folded).count() == 240 and "Expand" not in plan


def test_sensitivity_counts_repeated_subjects_once_a_row(spark):
    rows = [("s", str(i), f"site{i % 3}", {"lab_issues_count": i % 5, "sae_pending_count": int(i % 9 == 0)}) for i in range(30)] + [("s", "4", "site1", {"lab_issues_count": 4})]
    risk = scoring.subject_risk(scoring.score_subjects(subjects(spark, rows)))
    got = {r.scenario: r for r in validation.sensitivity(risk).collect()}
    assert set(got) == set(validation.scenarios()) and len(got) == 10
    assert all(r.high_count + r.medium_count + r.low_count == 31 for r in got.values())
    assert got["Baseline"].category_shifts == 0 and {r.rank_correlation for r in got.values()} == {1.0} and got["Baseline"].sae_capture_pct == 100.0


def test_pairs_of_issues_get_the_first_text_that_fits(spark):
    df = spark.createDataFrame([("sae_pending_count", "uncoded_meddra_count", 20, 2.5), ("missing_visit_count", "missing_pages_count", 20, 1.6), ("missing_pages_count", "max_days_outstanding", 20, 1.3), ("uncoded_meddra_count", "uncoded_whodd_count", 20, 1.3), ("lab_issues_count", "edrr_open_issues", 20, 1.34), ("lab_issues_count", "uncoded_whodd_count", 9, 9.0)], "issue_a string, issue_b string, cooccurrence_count long, lift double")
    got = {r.issue_a + r.issue_b: r.interpretation for r in rootcause.patterns(df).collect()}
    assert got == {
        "sae_pending_countuncoded_meddra_count": "Safety data entry backlog: Sites with SAE backlogs are strongly likely to also have uncoded adverse events, suggesting resource constraints in safety data processing.",
        "missing_visit_countmissing_pages_count": "General data entry issues: Missing Visits and missing CRF pages moderately co-occur, indicating systemic site capacity problems.",
        "missing_pages_countmax_days_outstanding": "Timeliness correlation: Sites with missing CRF pages are slightly likely to have data entry delays, suggesting chronic data entry delays.",
        "uncoded_meddra_countuncoded_whodd_count": "Coding backlog: Both uncoded adverse events and uncoded medications slightly co-occur, indicating coding resource constraints.",
        "lab_issues_countedrr_open_issues": "Sites with lab data issues are 1.3x more likely to also have reconciliation issues.",
    }


def test_one_metric_reads_line_items_once_and_orders_alone_where_it_can(spark):
    from trialpulse.plans import projection

    def scans(types):
        plan = projection.facts(spark, SMALL, types)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation") , plan.count("l_orderkey")

    assert scans(["visit_tracker"])[1] == 0 and scans(None)[0] == 4
    got = {k: df.count() for k, df in projection.extracts(spark, SMALL).items()}
    whole = {r.file_type: r["count"] for r in projection.facts(spark, SMALL).groupBy("file_type").count().collect()}
    assert {k: n for k, n in got.items() if n} == whole


def test_default_concentration_fires(spark):
    rows = [("s", f"x{i}", "c", "r", {"subject_count": 9, "lab_issues_count_sum": 90 if i == 0 else 1}) for i in range(12)]
    got = anomaly.concentration(site_rows(spark, rows)).collect()
    assert {r.site_id for r in got} == {"x0"}


def test_perspectives_that_users_add(spark):
    from trialpulse.operators import perspectives

    cols = {"study": "s", "site_id": "a", "country": "US", "region": "AM", "subject_count": 10, "high_risk_count": 0, "avg_dqi_score": 0.01, "site_risk_category": "Low", "anomaly_score": 0.0, "is_anomaly": False, "study_risk_category": "Low", "country_risk_category": "Low", "portfolio_dqi": 0.1, "portfolio_subjects": 10.0, "portfolio_sae": 0.5, "portfolio_high_rate": 0.1}
    cols |= {f"{c}_sum": 0 for c in C.SUMMED}
    site = spark.createDataFrame([tuple(cols.values()), tuple((cols | {"site_id": "b", "inactivated_forms_count_sum": 40}).values())], list(cols))
    forms = perspectives.Perspective("forms", ("inactivated_forms_count_sum",), "inactivated_forms_count_sum / 50D", 1.0, "forms are withdrawn", (("inactivated_forms_count_sum > 30", "concat('forms: ', inactivated_forms_count_sum)"),), (("inactivated_forms_count_sum > 30", "'Ask the site'"),))
    registry = perspectives.Registry().add(forms)
    got = {r.site_id: r for r in perspectives.consensus(site, registry).collect()}
    assert got["b"].risk_category == "Critical" and got["b"].forms_score == 0.8 and got["b"].composite_score == 0.4013 and got["b"].agent_consensus == "forms are withdrawn"
    assert "forms: 40" in got["b"].top_issues and "Ask the site" in got["b"].recommended_actions and got["a"].risk_category == "Low"
    rows = {(r.site_id, r.perspective): (r.score, r.level, r.findings) for r in registry.by_sql(site, ["site_id"]).collect()}
    assert rows["b", "forms"] == (0.8, "Critical", ["forms: 40"]) and rows["a", "forms"] == (0.0, "Low", []) and len(rows) == 8
    assert "forms_score" not in perspectives.consensus(site).columns
    with pytest.raises(ValueError):
        registry.add(perspectives.Perspective("no name", (), "0D", 0.1, ""))


def test_dense_sites_by_default(spark):
    rows = [("s", f"site{i}", f"p{i}-{j}", {"lab_issues_count": 60 if i == 0 else 1}) for i in range(15) for j in range(6)]
    site = rollup.site_metrics(scoring.subject_risk(scoring.score_subjects(subjects(spark, [(s, f"{p}", site, c) for s, site, p, c in rows]))))
    got = anomaly.density(site).collect()
    assert [(r.site_id, r.severity, r.value) for r in got] == [("site0", "HIGH", 60.0)]


def test_capping_by_deviations_and_ranges(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in [10] * 20 + [100]] + [(None, 1.0)], "x double, same double")
    x = np.array([10.0] * 20 + [100.0])
    got = master.cap_outliers(df, ["x", "same"], method="zscore", multiplier=3.0).toPandas()
    high = x.mean() + 3 * x.std(ddof=1)
    assert sorted(got.x.dropna()) == pytest.approx(sorted(np.minimum(x, high))) and high < 100 and got.x.isna().sum() == 1 and (got.same == 1).all()
    with pytest.raises(ValueError):
        master.quartile_bounds(df, ["x"], method="other")
    ints = spark.createDataFrame([(-5, 1.5), (50, None), (7, 9.0)], "n int, v double")
    assert sorted(map(tuple, master.clamp(ints, {"n": (0, 10), "v": (None, 2.0)}).collect()), key=str) == [(0, 1.5), (10, None), (7, 2.0)]
