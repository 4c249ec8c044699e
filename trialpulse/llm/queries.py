"""The numbered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import annular, decontaminate, jaccard, langmodel, linerules, oracles, pieces, prefixfree, prefixtrie, quality, shared, superkmer, tokencount, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score_documents(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a new cache: every content misses once."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared.path(spark, "token-cache"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), at)
    return warc.read(spark, at, with_payload=False).selectExpr("key page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixfree.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.deduplicate(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annular.quantise(_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_lm_scoring,
        op3_token_counts,
        op4_warc,
        op5_decontamination,
        op6_sentencepiece,
        op7_suffix_array_dedup,
        op8_substring_dedup,
        op9_quality_classifier,
        op10_exact_top_k,
        op11_vector_codes,
        op12_quality_rules,
        op13_conversation_trie,
    )
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.OP1,
    "op4_warc": oracles.OP4,
    "op5_decontamination": oracles.OP5,
    "op7_suffix_array_dedup": oracles.OP7,
    "op8_substring_dedup": oracles.OP8,
    "op10_exact_top_k": oracles.OP10,
    "op11_vector_codes": oracles.OP11,
    "op12_quality_rules": oracles.OP12,
    "op13_conversation_trie": oracles.OP13,
}
