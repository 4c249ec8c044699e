"""Exports (SNK-1..8): CSV, lines of GraphML, Markdown tables; documents.py makes one file of many tasks."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recommend import flattened


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-1: with header; lists as text."""
    flattened(df).write.mode("overwrite").csv(path, header=True)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-4: lines of a GraphML document by place: the opening (0), nodes, edges, the closing (3); all attributes as text."""
    spark = nodes.sparkSession
    attributes = [c for c in nodes.columns if c != "node_id"]
    head = "<graphml xmlns=" + quoteattr("http://graphml.graphdrawing.org/xmlns") + ">" + "".join(f'<key id="{escape(a)}" for="node" attr.name="{escape(a)}" attr.type="string"/>' for a in attributes)
    head += '<key id="edge_type" for="edge" attr.name="edge_type" attr.type="string"/><graph edgedefault="directed">'
    data = F.concat(*(F.coalesce(F.concat(F.lit(f'<data key="{a}">'), _xml(F.col(a).cast("string")), F.lit("</data>")), F.lit("")) for a in attributes))
    n = nodes.select(F.lit(1).alias("place"), F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('">'), data, F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"><data key="edge_type">'), F.col("edge_type"), F.lit("</data></edge>")))
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "place int, line string")
    return ends.union(n).union(e)


def markdown(df: DataFrame, title: str, limit: int = 50) -> str:
    """SNK-6: the first rows of a table as Markdown."""
    rows = df.limit(limit).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"
