"""What becomes of fetched entries, the completions they leave in the log, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RelayOptions


def settlements(outcomes: DataFrame, options: RelayOptions, rejected: Column | None = None, undeliverable: Column | None = None) -> DataFrame:
    """`outcomes` with route (RELAY, DLQ_EXPIRED, DLQ_UNRELAYABLE, DROP, FAIL or CARRY) and reason, the completion it leaves.

    `rejected` marks found records that the destination refuses for good, `undeliverable`
    those that the dead-letter topic refuses as well: where they should go there, nothing
    may be lost, so they FAIL.
    """
    refused = F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False))
    gone = {"DLQ": "DLQ_EXPIRED", "DROP": "DROP", "FAIL": "FAIL"}[options.on_unfetchable]
    bad = {"DLQ": "DLQ_UNRELAYABLE", "DROP": "DROP", "FAIL": "FAIL"}[options.on_unrelayable]
    outcome = F.col("fetch_outcome")
    out = outcomes.withColumn("_bad", (outcome == "FOUND") & refused)
    lost = F.lit(False) if undeliverable is None or bad != "DLQ_UNRELAYABLE" else F.coalesce(undeliverable, F.lit(False))
    out = out.withColumn("route", F.when(F.col("_bad") & lost, "FAIL").when(F.col("_bad"), bad).when(outcome == "FOUND", "RELAY").when(outcome == "GONE", gone).otherwise("CARRY"))
    reason = (
        F.when(F.col("route").isin("CARRY", "FAIL"), F.lit(None))
        .when(F.col("_bad"), "REJECTED")
        .when(F.col("route") == "RELAY", "DISPATCHED")
        .when(F.col("route") == "DROP", "DROPPED")
        .otherwise("PAYLOAD_MISSING_DLQ")
    )
    return out.withColumn("reason", reason).drop("_bad")


def with_refused(outcomes: DataFrame, refused: DataFrame) -> DataFrame:
    """`outcomes` with rejected: whether the position is among those (source_partition, source_offset) that the destination is known to refuse."""
    known = refused.select("source_partition", "source_offset").distinct().withColumn("rejected", F.lit(True))
    return outcomes.join(known, ["source_partition", "source_offset"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def completions(settled: DataFrame) -> DataFrame:
    """COMPLETE entries for the log, without a log offset yet; carried entries leave none."""
    return settled.filter("reason IS NOT NULL").select("source_partition", F.lit("COMPLETE").alias("op"), "source_offset", F.lit(None).cast("bigint").alias("dispatch_at_ms"), F.lit(None).cast("boolean").alias("clamped"), "reason")


def dispatch_counters(settled: DataFrame, now_ms: Column) -> DataFrame:
    """By route: entries and lag (how late, never negative)."""
    lag = F.greatest(F.lit(0).cast("bigint"), now_ms.cast("bigint") - F.col("dispatch_at_ms"))
    return settled.withColumn("lag_ms", lag).groupBy("route").agg(F.count("*").alias("n"), F.sum("lag_ms").alias("lag_sum_ms"), F.max("lag_ms").alias("lag_max_ms"), F.percentile("lag_ms", F.lit(0.5)).alias("lag_p50_ms"), F.percentile("lag_ms", F.lit(0.99)).alias("lag_p99_ms"))


def ingest_outcomes(decided: DataFrame) -> DataFrame:
    return decided.groupBy("outcome", "action").agg(F.count("*").alias("n"))


def ingest_rollup(decided: DataFrame) -> DataFrame:
    """The same with subtotals, for reports."""
    return decided.rollup("outcome", "action").agg(F.count("*").alias("n"))


def header_errors(decided: DataFrame) -> DataFrame:
    """One row: records with malformed, over-maximum and conflicting headers."""
    return decided.agg(F.count_if(F.col("outcome") == "MALFORMED").alias("malformed"), F.count_if(F.col("outcome") == "OVER_MAX").alias("over_max"), F.count_if("conflicted").alias("conflicts"))


def dlq_by_reason(decided: DataFrame) -> DataFrame:
    return decided.filter("action = 'DLQ'").groupBy("reason").agg(F.count("*").alias("n"))


def offsets(source: DataFrame) -> DataFrame:
    """first_offset and next_offset of each partition of a batch."""
    return source.groupBy("partition").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("next_offset"))


def orphan_partitions(source: DataFrame, known: DataFrame) -> DataFrame:
    """Partitions of the source that the log has no partition for."""
    return source.select("partition").distinct().join(known.select(F.col("source_partition").alias("partition")).distinct(), "partition", "left_anti")


def touched_partitions(settled: DataFrame) -> DataFrame:
    return settled.filter("reason IS NOT NULL").select("source_partition").distinct()
