"""Clustering of sites (CLU-1..10): features, models of every k in one scan, density clusters, metrics, profiles and archetypes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans.tables import staged
from . import models as M
from .cells import dbscan
from .silhouette import silhouettes

__all__ = ["dbscan"]

FEATURES = ["avg_dqi_score", "subject_count", "sae_pending_count_sum", "missing_visit_count_sum", "lab_issues_count_sum", "missing_pages_count_sum", "uncoded_meddra_count_sum", "uncoded_whodd_count_sum"]
#: Fixed centres, each the same in every feature: a quiet, a middling and a busy site.
CENTRES = [-0.5, 0.2, 1.2]
DERIVED = ["high_risk_rate", "issue_rate"]


def features(site: DataFrame, names: list[str] | None = None) -> DataFrame:
    """CLU-1: z_<f> of every feature; derived rates join in if fewer than three are there. 0 where a column is constant."""
    names = [f for f in (names or FEATURES) if f in site.columns]
    df = site.withColumns({"high_risk_rate": S.ratio(F.col("high_risk_count"), F.col("subject_count")), "issue_rate": S.ratio(F.col("subjects_with_issues"), F.col("subject_count"))})
    names = names if len(names) >= 3 else names + DERIVED
    clean = df.withColumns({f: F.when(F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")), 0.0).otherwise(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in names})
    stats = S.one_row(clean, *(a for f in names for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))))
    out = clean.crossJoin(stats).withColumns({f"z_{f}": S.r10(S.zscore(F.col(f), F.col(f"_m_{f}"), F.col(f"_s_{f}"))) for f in names})
    return out.drop(*(f"_{k}_{f}" for f in names for k in "ms"))


def vectors(featured: DataFrame) -> DataFrame:
    names = [c for c in featured.columns if c.startswith("z_")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(featured)


def _names(vec: DataFrame) -> list[str]:
    return [c for c in vec.columns if c.startswith("z_")]


def _assigned(vec: DataFrame, model: M.KMeans | M.Mixture) -> DataFrame:
    """cluster_id, its probability, and the probabilities of all clusters."""
    out = M.labelled(vec.drop("features"), _names(vec), [model]).withColumn("cluster_id", F.col("labels")[0])
    return out.withColumn("cluster_probability", M.share_of(F.col("cluster_id"), F.col("shares"))).withColumnRenamed("shares", "probabilities").drop("labels")


def _candidates(n: int, largest: int) -> list[int]:
    return list(range(2, max(2, min(largest, n // 5 - 1)) + 1))


def kmeans(vec: DataFrame, k: int, seed: int = 42, restarts: int = 10) -> DataFrame:
    """CLU-3: the restart with the smallest cost; pseudo-probabilities from inverse distances to the centres."""
    fits = M.lloyd(M.Points.of(vec, _names(vec)), [k], restarts, seed)
    return _assigned(vec, min(fits, key=lambda m: m.cost))


def gaussian_mixture(vec: DataFrame, k: int, seed: int = 42, restarts: int = 10) -> tuple[DataFrame, M.Mixture]:
    """CLU-2: the restart with the best likelihood, with its BIC and AIC."""
    points = M.Points.of(vec, _names(vec))
    fits = M.expectation_maximisation(points, M.lloyd(points, [k], restarts, seed))
    best = max(fits, key=lambda m: m.score)
    return _assigned(vec, best), best


def best_kmeans(vec: DataFrame, key: str, largest: int = 10, seed: int = 42, restarts: int = 10) -> tuple[DataFrame, M.KMeans]:
    """CLU-6: of k = 2 to min(largest, n // 5 - 1) that with the best mean silhouette. All models share their scans, and all silhouettes theirs."""
    names = _names(vec)
    points = M.Points.of(vec, names)
    ks = _candidates(points.n, largest)
    best = list(M.best_of_each(M.lloyd(points, ks, restarts, seed), lambda a, b: a.cost < b.cost).values())
    all_ = staged(M.labelled(vec.select(key, *names), names, best).drop("shares"), "labelled")
    got = {r.labelling: r.silhouette for r in silhouettes(all_, key, "labels", names).collect()}  # a row a k
    chosen = best[max(range(len(best)), key=lambda i: (got.get(i) or 0.0, -i))]
    return _assigned(vec, chosen), chosen


def best_mixture(vec: DataFrame, largest: int = 10, seed: int = 42, restarts: int = 10) -> tuple[DataFrame, list[M.Mixture]]:
    """CLU-6: of the same k the mixture with the lowest BIC; and the best mixture of every k, from the lowest BIC on."""
    points = M.Points.of(vec, _names(vec))
    fits = M.expectation_maximisation(points, M.lloyd(points, _candidates(points.n, largest), restarts, seed))
    ranked = sorted(M.best_of_each(fits, lambda a, b: a.score > b.score).values(), key=lambda m: m.bic)
    return _assigned(vec, ranked[0]), ranked


def criteria(spark, ranked: list[M.Mixture]) -> DataFrame:
    """CLU-2: what a choice among mixtures goes by, a row a k."""
    return spark.createDataFrame([(m.k, m.score * m.n, m.bic, m.aic, m.rounds, m.converged) for m in ranked], "k int, log_likelihood double, bic double, aic double, rounds int, converged boolean")


def probabilities(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """CLU-2: a row for each row and cluster."""
    return assigned.select(*keys, F.posexplode("probabilities").alias("cluster_id", "probability"))


def nearest_centres(vec: DataFrame, centres: list[float] | None = None) -> DataFrame:
    """Sites at the nearest of fixed centres instead of fitted ones: clusters that stay the same from run to run."""
    names = _names(vec)
    at = np.array([[c] * len(names) for c in (CENTRES if centres is None else centres)])
    return _assigned(vec, M.KMeans(len(at), 0, at))


def choose_k(vec: DataFrame, largest: int = 10, seed: int = 42, key: str | None = None) -> int:
    """CLU-6: the chosen k, by the BIC of mixtures or, with the ``key`` of a row, by silhouettes of k-means."""
    return best_mixture(vec, largest, seed)[1][0].k if key is None else best_kmeans(vec, key, largest, seed)[1].k


def principal_components(vec: DataFrame, k: int = 2) -> DataFrame:
    """CLU-10: coordinates for a scatter plot (the features are centred)."""
    got = PCA(k=k, inputCol="features", outputCol="pca").fit(vec).transform(vec)
    a = vector_to_array("pca")
    return got.withColumns({f"pc{i + 1}": a[i] for i in range(k)}).drop("pca")


def _square(a: list[Column], b: list[Column]) -> Column:
    return S.total([(x - y) * (x - y) for x, y in zip(a, b)])


def metrics(points: DataFrame, label: str, dims: list[str]) -> DataFrame:
    """CLU-7: Calinski-Harabasz and Davies-Bouldin, by aggregates; noise (-1) left out."""
    df = points.where(F.col(label) >= 0)
    centre = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c_{c}") for c in dims))
    whole = S.one_row(df, F.count("*").alias("_n"), *(F.avg(c).alias(f"w_{c}") for c in dims))
    spread = df.join(F.broadcast(centre), label).withColumn("d2", _square([F.col(c) for c in dims], [F.col(f"c_{c}") for c in dims]))
    per = spread.groupBy(label, "n", *(f"c_{c}" for c in dims)).agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s")).crossJoin(whole)
    between = F.col("n") * _square([F.col(f"c_{c}") for c in dims], [F.col(f"w_{c}") for c in dims])
    ch = per.agg(F.sum(between).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.first("_n").alias("n")).select("k", F.when((F.col("k") >= 2) & (F.col("w") > 0), (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    x, y = per.alias("x"), per.alias("y")
    gap = F.sqrt(_square([F.col(f"x.c_{c}") for c in dims], [F.col(f"y.c_{c}") for c in dims]))
    worst = x.join(y, F.col(f"x.{label}") != F.col(f"y.{label}")).groupBy(f"x.{label}").agg(F.max(F.try_divide(F.col("x.s") + F.col("y.s"), gap)).alias("r"))
    return ch.crossJoin(worst.agg(F.avg("r").alias("davies_bouldin")))


def silhouette(points: DataFrame, key: str, label: str, dims: list[str]) -> DataFrame:
    """CLU-7: the mean Euclidean silhouette of one labelling; noise (-1) left out."""
    rows = points.select(key, *dims, F.array(F.col(label).cast("int")).alias("_labels"))
    return silhouettes(rows, key, "_labels", dims).select("points", "silhouette")


# Issues of a profile and the archetypes' interventions.
PROFILE = {"SAE Pending": "sae_pending_count_sum", "Uncoded MedDRA": "uncoded_meddra_count_sum", "Missing Visits": "missing_visit_count_sum", "Missing Pages": "missing_pages_count_sum", "Lab Issues": "lab_issues_count_sum", "Uncoded WHODD": "uncoded_whodd_count_sum", "EDRR Issues": "edrr_open_issues_sum"}
ARCHETYPES = {"Safety Concerns": ("Critical", 1), "Data Laggards": ("High", 2), "Systemic Issues": ("High", 2), "High Performers": ("Low", 5), "Moderate Performers": ("Low", 4), "Needs Improvement": ("Medium", 3)}


def profiles(clustered: DataFrame, label: str = "cluster_id") -> DataFrame:
    """CLU-8, CLU-9: sizes, means, three most frequent issues above a tenth, and the archetype with its level and priority."""
    share = {k: S.r10(F.avg((F.col(c) > 0).cast("double"))) for k, c in PROFILE.items()}
    out = clustered.groupBy(F.col(label).alias("cluster_id")).agg(F.count("*").alias("site_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), S.r10(F.avg("subject_count")).alias("avg_subject_count"), S.r10(F.sum("high_risk_count") / F.greatest(F.sum("subject_count"), F.lit(1))).alias("avg_high_risk_rate"), *(s.alias(f"r_{i}") for i, s in enumerate(share.values())))
    out = out.crossJoin(S.one_row(clustered, F.count("*").alias("_n"))).withColumn("pct_of_total", F.round(S.r10(F.col("site_count") / F.col("_n") * 100), 1))
    rates = [F.col(f"r_{i}") for i in range(len(PROFILE))]
    frequent = F.array_sort(F.filter(F.array(*(F.struct((-r).alias("r"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, r) in enumerate(zip(PROFILE, rates)))), lambda x: x["r"] < -0.1))
    sae, meddra, visits, pages = rates[:4]
    present, dqi, high = S.total([(r > 0.2).cast("int") for r in rates]), F.col("avg_dqi_score"), F.col("avg_high_risk_rate")
    name = (
        F.when((sae > 0.3) | (meddra > 0.4), "Safety Concerns").when((visits > 0.4) | (pages > 0.4), "Data Laggards").when((present >= 3) | ((dqi > 0.15) & (high > 0.2)), "Systemic Issues")
        .when((dqi < 0.05) & (high < 0.05) & (present <= 1), "High Performers").when(dqi < 0.1, "Moderate Performers").otherwise("Needs Improvement")
    )
    out = out.withColumns({"dominant_issues": F.array_join(F.transform(F.slice(frequent, 1, 3), lambda x: x["k"]), ", "), "cluster_name": name})
    level = F.coalesce(*(F.when(F.col("cluster_name") == k, F.lit(v[0])) for k, v in ARCHETYPES.items()))
    place = F.coalesce(*(F.when(F.col("cluster_name") == k, F.lit(v[1])) for k, v in ARCHETYPES.items()))
    return out.withColumns({"risk_level": level, "intervention_priority": place}).drop("_n", *(f"r_{i}" for i in range(len(PROFILE))))


def named_sites(clustered: DataFrame, profile: DataFrame, label: str = "cluster_id") -> DataFrame:
    """JN-8: sites with the name, level and priority of their cluster; sites of no cluster are Noise."""
    names = F.broadcast(profile.select(F.col("cluster_id").alias(label), "cluster_name", "risk_level", "intervention_priority"))  # a row a cluster
    return clustered.join(names, label, "left").withColumn("cluster_name", F.when(F.col(label) < 0, "Noise").otherwise(F.coalesce("cluster_name", F.lit("Noise"))))


def heatmap(clustered: DataFrame, columns: list[str], label: str = "cluster_id") -> DataFrame:
    """CLU-10, SNK-7: cluster means scaled to 0..1 over clusters."""
    means = clustered.groupBy(F.col(label).alias("cluster_id")).agg(*(F.avg(c).alias(c) for c in columns))
    ends = S.one_row(means, *(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    wide = means.crossJoin(ends)
    return wide.select("cluster_id", *(S.r10(F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))).alias(c) for c in columns))
