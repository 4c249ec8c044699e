"""The corpus pipeline: documents in, token ids out. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialpulse.llm import decontaminate, jaccard, pieces, quality, shared, superkmer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. Null text counts as empty; rows without an id and repeated rows are judged by their text like any other; with no labels to learn from everything stays, of an empty table nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, good_only=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, rows without one last. Rows are told apart by a hash of id and text, so null and repeated ids are grouped by their texts like any others; of rows with equal id and text one stays. Rows without words stay, one for each id and text; an empty table stays empty. Should two hashes meet, a row too many stays, never one too few."""
    row, place = unused("row", docs), unused("place", docs)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()))
    groups = jaccard.similar(keyed, id_col=row).select(F.col("doc_id").alias("r"), F.col("component_id").alias("g")).distinct()
    ids = keyed.select(F.col(row).alias("r"), F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"))
    first = groups.join(ids, "r").groupBy("g").agg(F.min(F.struct("id", "r")).alias("first")).select(F.col("first.r").alias(row)).distinct()
    kept = keyed.join(first, row, "left_semi")
    return kept.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(row))).where(F.col(place) == 1).select(*docs.columns)


def unused(name: str, docs: DataFrame) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the document with the smallest id; texts that lose nothing stay as they are. Null text becomes empty; a null id counts as larger than any other; of equal ids none loses words to the other; n_chars is that of the new text; an empty table stays empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = docs.select("doc_id", "text", F.struct(F.lit(1).alias(unused("none", docs)), *rest).alias("rest"))
    cut = superkmer.deduplicate(carried, with_text=True, keep=["rest"])
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return cut.select(*(new.get(c, F.col(f"rest.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null text has no words and stays; rows are told apart by id and text, so of rows with one id or none only those that hold a window go, repeated ones all; an empty table stays empty."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").select("doc_id", "key").distinct()
    d, f = docs.alias("d"), found.alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("f.key"))
    return d.join(f, same, "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, a row a document: null and empty text have no pieces; rows without an id and repeated rows stay rows; an empty table stays empty."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: A trained classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.staged(docs, f"stage{i}")
    return docs
