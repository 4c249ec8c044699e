"""Entity graph as two tables, nodes and edges (GRA-1..6, SNK-4, SNK-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ["node_id", "node_type", "name", "study", "region", "risk_category", "score"]


def _id(kind: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *(F.col(p) for p in parts))


def _nodes(df: DataFrame, kind: str, name: str, keys: list[str], **columns: Column) -> DataFrame:
    none = F.lit(None)
    out = {"node_id": _id(kind.lower(), *keys), "node_type": F.lit(kind), "name": F.col(name)}
    out |= {c: columns.get(c, none) for c in NODE[3:]}
    return df.select(*(out[c].cast("double" if c == "score" else "string").alias(c) for c in NODE))


def nodes(risk: DataFrame, site: DataFrame, study: DataFrame, region: DataFrame, country: DataFrame) -> DataFrame:
    """GRA-1. A site node is a site of a study; of its rows the last by country and region gives the attributes."""
    c = F.col
    last = F.max(F.struct("country", "region", "site_risk_category", "avg_dqi_score"))
    sites = site.groupBy("study", "site_id").agg(last.alias("x")).select("study", "site_id", "x.*")
    parts = [
        _nodes(region, "Region", "region", ["region"], risk_category=c("region_risk_category"), score=c("avg_dqi_score")),
        _nodes(country, "Country", "country", ["country"], region=c("region"), risk_category=c("country_risk_category"), score=c("avg_dqi_score")),
        _nodes(study, "Study", "study", ["study"], risk_category=c("study_risk_category"), score=c("avg_dqi_score")),
        _nodes(sites, "Site", "site_id", ["study", "site_id"], study=c("study"), region=c("region"), risk_category=c("site_risk_category"), score=c("avg_dqi_score")),
        _nodes(risk.dropDuplicates(["study", "subject_id"]), "Subject", "subject_id", ["study", "subject_id"], study=c("study"), region=c("region"), risk_category=c("risk_category"), score=c("dqi_score")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(risk: DataFrame, site: DataFrame, country: DataFrame) -> DataFrame:
    """GRA-1: (source, target, edge_type), distinct."""
    def of(df: DataFrame, a: Column, b: Column, kind: str) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"))

    home = risk.where("site_id is not null and site_id <> ''")
    parts = [
        of(country, _id("country", "country"), _id("region", "region"), "IN_REGION"),
        of(site, _id("site", "study", "site_id"), _id("study", "study"), "PARTICIPATES_IN"),
        of(site, _id("site", "study", "site_id"), _id("country", "country"), "LOCATED_IN"),
        of(home, _id("subject", "study", "subject_id"), _id("site", "study", "site_id"), "ENROLLED_AT"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def study_sites(study: DataFrame, site: DataFrame) -> DataFrame:
    """JN-7: study metrics with the number of their sites; 0 where none is known."""
    n = site.groupBy("study").agg(F.count("*").alias("known_sites"))
    return study.join(n, "study", "left").fillna(0, ["known_sites"])


def counts(n: DataFrame, e: DataFrame) -> DataFrame:
    """GRA-2: by type."""
    a = n.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "*")
    return a.unionByName(e.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "*"))


def induced(e: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among (node_id)."""
    inside = e.join(kept.select(F.col("node_id").alias("source")), "source", "left_semi")
    return inside.join(kept.select(F.col("node_id").alias("target")), "target", "left_semi").select("source", "target", "edge_type")


def neighbours(e: DataFrame, some: DataFrame, outgoing: bool = True, incoming: bool = True) -> DataFrame:
    """Direct neighbours of (node_id), one hop (JN-14)."""
    parts = []
    if outgoing:
        parts.append(e.join(some.select(F.col("node_id").alias("source")), "source", "left_semi").select(F.col("target").alias("node_id")))
    if incoming:
        parts.append(e.join(some.select(F.col("node_id").alias("target")), "target", "left_semi").select(F.col("source").alias("node_id")))
    return reduce(DataFrame.unionByName, parts).distinct()


def high_risk(n: DataFrame, e: DataFrame) -> DataFrame:
    """GRA-3: edges among High subjects and sites and their neighbours."""
    core = n.where("node_type in ('Subject', 'Site') and risk_category = 'High'").select("node_id")
    return induced(e, core.union(neighbours(e, core)).distinct())


def top_studies(n: DataFrame, e: DataFrame, risk: DataFrame, k: int = 5) -> DataFrame:
    """GRA-4: edges among the k studies with most subjects, their sites, the sites' subjects and targets."""
    best = risk.groupBy("study").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "study").limit(k).select(_id("study", "study").alias("node_id"))
    sites = neighbours(e.where("edge_type = 'PARTICIPATES_IN'"), best, outgoing=False)
    return induced(e, best.union(sites).union(neighbours(e, sites)).distinct())


def sample(n: DataFrame, e: DataFrame, size: int = 1000) -> DataFrame:
    """GRA-5, PRJ-18: subjects by the hash of their id, and two hops of successors."""
    some = n.where("node_type = 'Subject'").select("node_id").orderBy(F.md5("node_id"), "node_id").limit(size)
    one = neighbours(e, some, incoming=False)
    return induced(e, some.union(one).union(neighbours(e, one, incoming=False)).distinct())


def risk_by_country(risk: DataFrame) -> DataFrame:
    """GRA-6: subjects by their own country."""
    return risk.groupBy("country", "risk_category").agg(F.count("*").alias("n"))
