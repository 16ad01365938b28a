"""Documents to token ids in five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontaminate, language_id, near_dup, substring_dedup
from tidegate.llm.shared import scratch, small_reads, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Similarity in percent from which the stage takes documents for near copies; op5's 85 is that query's alone.
NEAR = 80
#: Score below which the language stage rejects a document; None takes what the model was calibrated to.
LEAST: float | None = None


def reading_little(stage: Stage) -> Stage:
    """The stage with its texts read in small batches: executors keep the heap that large ones have made grow, beside their workers."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_reads(spark)
        return stage(spark, docs, sf_dir)

    return run


@reading_little
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go, by the model's own threshold (or LEAST); those without a label get the predicted one. It learns from the labels of a bounded sample."""
    docs = docs.select(*COLUMNS)
    return language_id.recognised(docs, language_id.fit(docs), LEAST)


@reading_little
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that with the smallest doc_id; a row without doc_id only if no other of its class has one.

    Every row is a document of its own here, so rows that repeat a doc_id, or have none,
    are in a class as others are. Texts without words have no class: of those, rows that
    repeat a doc_id go, and rows without one stay.
    """
    with scratch(spark) as kept_tables:
        rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
        found = near_dup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent=NEAR)
        has_words = F.col("n_shingles") > 0
        of = found.select(F.col("doc_id").alias("row"), has_words.alias("has_words"), F.when(has_words, F.col("component_id")).alias("class"))
        named = rows.select("row", "doc_id").join(of, "row")
        # What is one document: a class, or else a doc_id, or else a row.
        wordless = F.when(~F.col("has_words"), F.col("doc_id"))
        alone = F.when(~F.col("has_words") & F.col("doc_id").isNull(), F.col("row"))
        named = stored(named.select("row", "doc_id", "class", wordless.alias("wordless"), alone.alias("alone")), "named")
        first = F.min_by("row", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("row")
        kept = named.groupBy("class", "wordless", "alone").agg(first).select("row")
        gone = stored(named.select("row").join(kept, "row", "left_anti"), "gone")
        kept_tables += [rows, gone]
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


@reading_little
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text; the document stays."""
    cut = substring_dedup.with_cut_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@reading_little
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@reading_little
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (packed, little-endian unsigned 32-bit)."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the chunk digests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = stored(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
