"""File discovery and header mapping (SRC-3..15): listing, study names, file types, canonical columns, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

# Words that mark a header row.
HEADER_WORDS = ["Subject ID", "Subject", "Patient ID", "Site ID", "Site", "Project Name", "Study", "Country"]


def list_files(spark: SparkSession, root: str, glob: str = "*.xls*") -> DataFrame:
    """SRC-8: (path, length) of files below ``root``, through Spark's own file source; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def study_name(folder: Column) -> Column:
    """SRC-9: Study_<n> where the name has one, else the folder."""
    n = F.regexp_extract(folder, r"(?i)Study[_\s]*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("Study_"), n)).otherwise(folder)


def file_type(name: Column) -> Column:
    """SRC-10: the first type, in order of declaration, with a matching pattern."""
    out = None
    for kind, patterns in C.FILE_PATTERNS.items():
        hit = name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def file_mapping(files: DataFrame) -> DataFrame:
    """SRC-8..10: one row a file: study, folder, filename, file_type, path."""
    parts = F.split("path", "/")
    out = files.withColumns({"filename": F.element_at(parts, -1), "folder": F.element_at(parts, -2)})
    return out.select(study_name(F.col("folder")).alias("study"), "folder", "filename", file_type(F.col("filename")).alias("file_type"), "path")


def find_column(columns: list[str], candidates: list[str], exact_first: bool = False) -> str | None:
    """SRC-12 and SRC-13: a column by name, then by substring either way; candidate by candidate, or all exact matches first."""
    low = {c.strip().lower(): c for c in reversed(columns)}

    def part(name: str) -> str | None:
        return next((c for c in columns if name.lower() in c.lower() or c.lower() in name.lower()), None)

    if exact_first:
        return next((low[n.lower()] for n in candidates if n.lower() in low), None) or next((p for n in candidates if (p := part(n))), None)
    for n in candidates:
        if n.lower() in low:
            return low[n.lower()]
        if p := part(n):
            return p
    return None


def standardise(df: DataFrame, kind: str, exact_first: bool = False) -> DataFrame:
    """SRC-14: accepted headers to canonical names; an unknown type stays as it is."""
    names, taken = {}, set()
    for canonical, candidates in C.HEADERS.get(kind, {}).items():
        found = find_column([c for c in df.columns if c not in taken], candidates, exact_first)
        if found:
            names[found] = canonical
            taken.add(found)
    return df.withColumnsRenamed(names)


def map_headers(headers: DataFrame) -> DataFrame:
    """SRC-11: (file_type, header, position) rows to (file_type, canonical, header): the first header that contains an accepted name. NULL where none does."""
    spark = headers.sparkSession
    rules = [(k, c, v.lower()) for k, m in C.HEADERS.items() for c, names in m.items() for v in names]
    accepted = F.broadcast(spark.createDataFrame(rules, "file_type string, canonical string, part string"))  # a fixed table of config
    hit = headers.join(accepted, "file_type").where(F.contains(F.lower("header"), F.col("part")))
    best = hit.groupBy("file_type", "canonical").agg(F.min_by("header", F.struct("position", "header")).alias("header"))
    wanted = accepted.select("file_type", "canonical").distinct().join(headers.select("file_type").distinct(), "file_type", "left_semi")
    return wanted.join(best, ["file_type", "canonical"], "left")


def issues(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """SRC-15: unknown files, missing columns and missing file types of a study, as rows."""
    unknown = mapping.where("file_type = 'unknown'").select(F.lit("unknown_file").alias("issue"), "study", F.col("filename").alias("detail"))
    columns = map_headers(headers).where("header is null").select(F.lit("missing_column"), F.lit(None).cast("string"), F.concat_ws(".", "file_type", "canonical"))
    types = mapping.sparkSession.createDataFrame([(k,) for k in C.FILE_PATTERNS], "file_type string")
    want = mapping.select("study").distinct().crossJoin(F.broadcast(types))  # nine rows
    absent = want.join(mapping, ["study", "file_type"], "left_anti").select(F.lit("missing_type"), "study", "file_type")
    return unknown.union(columns).union(absent)


def header_row(rows: DataFrame, words: list[str] = HEADER_WORDS, scan: int = 10) -> DataFrame:
    """SRC-2..4: (file, row) of the first of ``scan`` rows that holds a header word, else 0. rows: (file, row, cells array)."""
    text = F.lower(F.array_join("cells", " "))
    hit = F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w))
    return rows.where(F.col("row") < scan).groupBy("file").agg(F.coalesce(F.min(F.when(hit, F.col("row"))), F.lit(0)).alias("header_row"))


# Words that mark the header of a subject extract, and first headers that call for a search.
EDC_WORDS = ["Subject ID", "Project Name"]
SAMPLE_WORDS = ["Subject", "Patient"]
FIRST_HEADERS = ["project name", "study", "country"]


def edc_header_row(rows: DataFrame) -> DataFrame:
    """SRC-2: the first of five rows that names a subject or a project."""
    return header_row(rows, EDC_WORDS, 5)


def sample_header_row(rows: DataFrame) -> DataFrame:
    """SRC-4: row 0, unless its first cell is empty, unnamed or a project, study or country; then the first of the five rows below it that names a subject or a patient."""
    first = F.lower(F.trim(F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit(""))))
    search = rows.where("row = 0").select("file", ((first == "") | F.contains(first, F.lit("unnamed")) | first.isin(FIRST_HEADERS)).alias("search"))
    found = header_row(rows, SAMPLE_WORDS, 6)
    return search.join(found, "file").select("file", F.when(F.col("search"), F.col("header_row")).otherwise(0).cast("long").alias("header_row"))


def drop_junk(df: DataFrame, column: str = "subject_id", totals: bool = False) -> DataFrame:
    """SRC-5: rows without a subject, repeated headers and, ``totals``, summary rows."""
    junk = "(?i)Subject ID|Responsible|Total|Summary" if totals else "Subject ID|Responsible"
    return df.where(F.col(column).isNotNull() & ~F.col(column).rlike(junk))


def standard_id(c: Column) -> Column:
    """PRJ-13: upper case without its prefix, separators behind it and leading zeros."""
    bare = F.regexp_replace(F.upper(F.trim(c.cast("string"))), r"^(SUBJECT|SUBJ|SUB|PATIENT|PAT|PT)[\s_\-]*", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0"))


def id_match(spine: DataFrame, extract: DataFrame, name: str) -> DataFrame:
    """AGG-27, JN-13: ids of an extract found in the spine, and not, by standardised id."""
    ids = extract.select("study", standard_id(F.col("subject_id")).alias("id")).distinct()
    base = spine.select("study", standard_id(F.col("subject_id")).alias("id")).distinct()
    flagged = ids.join(base.withColumn("known", F.lit(1)), ["study", "id"], "left")
    return flagged.agg(F.lit(name).alias("file_type"), F.count("*").alias("ids"), F.count("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("unmatched"))
