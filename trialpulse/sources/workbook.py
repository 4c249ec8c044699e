"""Workbook scan (SRC-1..7): .xlsx files to rows of cells, and those to tables with canonical columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import discovery
from . import sheets as workbooks


def scan(spark: SparkSession, root: str, sheets: str | None = None) -> DataFrame:
    """Cells of all workbooks below a folder (sheets.ROWS): a task for every sheet; a file that can't be read is one row with its error."""
    return workbooks.read(spark, root, sheets)


def table(cells: DataFrame, kind: str, sheets: str | None = None) -> DataFrame:
    """SRC-6, SRC-7, SRC-14: rows of one file type with study (from the folder, SRC-9), canonical columns and _source_sheet. ``sheets``: a pattern for sheet names (SAE|Dashboard for safety extracts). Headers of different files may differ: values meet by canonical name, found as discovery.standardise does."""
    from .. import config as C

    rows = cells.where("error is null")
    if sheets:
        rows = rows.where(F.col("sheet").rlike(f"(?i){sheets}"))
    rows = rows.withColumn("file", F.concat_ws("#", "path", "sheet"))
    start = discovery.edc_header_row(rows) if kind == "edc_metrics" else discovery.header_row(rows)
    rows = rows.join(start, "file").withColumn("study", discovery.study_name(F.element_at(F.split("path", "/"), -2)))
    heads = rows.where("row = header_row").select("file", F.posexplode("cells").alias("position", "header"))

    def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
        left = sorted((p, h) for p, h in zip(pdf["position"], pdf["header"]) if h and h.strip())
        out = []
        for name, candidates in C.HEADERS[kind].items():
            found = discovery.find_column([h for _, h in left], candidates)
            if found is not None:
                at = next(p for p, h in left if h == found)
                left = [(p, h) for p, h in left if p != at]
                out.append((pdf["file"].iloc[0], name, at))
        return pd.DataFrame(out, columns=["file", "canonical", "position"])

    found = heads.groupBy("file").applyInPandas(canonical, "file string, canonical string, position int")  # one row of headers a group
    values = rows.where("row > header_row").select("file", "sheet", "row", "study", F.posexplode("cells").alias("position", "value"))
    wide = values.join(found, ["file", "position"]).groupBy("file", "sheet", "row", "study").pivot("canonical", list(C.HEADERS[kind])).agg(F.first("value"))
    return discovery.drop_junk(wide.withColumnRenamed("sheet", "_source_sheet").drop("file", "row"))


def load(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """All workbooks below a folder: the subject spine, the extracts by file type, and the issues (files that can't be read, unknown types) as rows (path, issue)."""
    from ..plans.tables import staged

    cells = staged(scan(spark, root).withColumn("file_type", discovery.file_type(F.element_at(F.split("path", "/"), -1))), "cells")
    kinds = {r.file_type for r in cells.where("error is null").select("file_type").distinct().collect()}  # at most ten names
    issues = cells.where("error is not null").select("path", F.col("error").alias("issue")).union(cells.where("file_type = 'unknown'").select("path", F.lit("unknown file type")).distinct())

    def of(kind: str) -> DataFrame:
        return table(cells.where(F.col("file_type") == kind).drop("file_type"), kind, "SAE|Dashboard" if kind == "sae_dashboard" else None)

    spine = of("edc_metrics").drop("_source_sheet")
    return spine, {k: of(k).drop("_source_sheet") for k in kinds - {"edc_metrics", "unknown"}}, issues
