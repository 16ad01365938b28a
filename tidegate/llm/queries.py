"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, hilbert, html_text, language_id, language_model, near_dup, oracle, substring_dedup, suffix_dedup, top_k


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluated(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(_table(spark, sf_dir, "documents"), shards=24)


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op9_wrapper_induction": op9_wrapper_induction,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op10_exact_top_k": op10_exact_top_k,
    "op4_language_id": op4_language_id,
    "op8_byte_bpe": op8_byte_bpe,
    "op6_winnowing": op6_winnowing,
    "op1_substring_dedup": op1_substring_dedup,
    "op5_minhash_near_dup": op5_minhash_near_dup,
}

#: The other operators hold what SQL can't: models, tokens, trees, checksums or rolling hashes. They are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dup": oracle.NEAR_DUPLICATES,
    "op6_winnowing": oracle.CONTAMINATION,
    "op10_exact_top_k": oracle.TOP_K,
}
