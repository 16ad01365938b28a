"""Payloads for due pointers: a join on the position, with proof of loss and a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from .policy import record_bytes


def log_starts(source: DataFrame) -> DataFrame:
    """The smallest offset that each partition still has."""
    return source.groupBy(F.col("partition").alias("source_partition")).agg(F.min("offset").alias("log_start"))


def positioned(batch: DataFrame, *order: str) -> DataFrame:
    """A due batch with its position (from 0). A batch is bounded by its poll, so one task orders it."""
    return batch.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def runs(batch: DataFrame) -> DataFrame:
    """A positioned batch with run_no: partitions by first appearance, from 1. Offsets ascend in a run."""
    first = F.min("pos").over(Window.partitionBy("source_partition"))
    return batch.withColumn("first_pos", first).withColumn("run_no", F.dense_rank().over(Window.orderBy("first_pos"))).drop("first_pos")


#: Pointers that go to every task of the payload scan, at most: some megabytes.
BROADCAST_POINTERS = 100_000


def refetched(batch: DataFrame, source: DataFrame, most: int | None = None) -> DataFrame:
    """`batch` with the payload of each pointer, columns of `source` but the position; nulls and found = false without one.

    `most` bounds the batch's rows, as its poll does. Up to BROADCAST_POINTERS the pointers go
    to the source's scan, and no payload but those found is moved; beyond, or with no
    bound given, the source is shuffled by position.
    """
    position = ["source_partition", "source_offset"]
    payload = source.select(F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), *[c for c in source.columns if c not in ("partition", "offset")], F.lit(True).alias("found"))
    if most is not None and most <= BROADCAST_POINTERS:
        payload = payload.join(F.broadcast(batch.select(*position)), position, "left_semi")
    return batch.join(payload, position, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_outcome(fetched: DataFrame, starts: DataFrame, scanned_to: Column | None = None) -> DataFrame:
    """`fetched` with fetch_outcome: FOUND; GONE below the log's start or where a scan went past it; else TRANSIENT."""
    out = fetched.join(starts, "source_partition", "left")
    past = F.lit(False) if scanned_to is None else F.coalesce(F.col("source_offset") < scanned_to, F.lit(False))
    gone = F.coalesce(F.col("source_offset") < F.col("log_start"), F.lit(False)) | past
    out = bound(out, {"fetch_outcome": F.when(F.col("found"), "FOUND").when(gone, "GONE").otherwise("TRANSIENT")})
    return out.withColumn("bytes", F.when(F.col("found"), record_bytes(F.col("key"), F.col("value"))).otherwise(F.lit(0).cast("bigint")))


def within_budget(outcomes: DataFrame, budget: int) -> DataFrame:
    """Entries from the one after which the budget is used up become CARRY_OVER.

    Entries go by run and offset; one is taken if the bytes taken before it are below the
    budget, so the one that crosses it still is. All later ones are carried, gone or not.
    """
    before = F.sum("bytes").over(Window.orderBy("run_no", "source_offset").rowsBetween(Window.unboundedPreceding, -1))
    taken = F.coalesce(before, F.lit(0)) < budget
    return outcomes.withColumn("fetch_outcome", F.when(taken, F.col("fetch_outcome")).otherwise("CARRY_OVER")).withColumn("bytes", F.when(taken, F.col("bytes")).otherwise(F.lit(0).cast("bigint")))


def summary(outcomes: DataFrame) -> DataFrame:
    is_a = lambda v: F.count_if(F.col("fetch_outcome") == v)
    return outcomes.groupBy("source_partition").agg(is_a("FOUND").alias("found"), is_a("GONE").alias("gone"), is_a("TRANSIENT").alias("transient"), is_a("CARRY_OVER").alias("carried_over"), F.sum("bytes").alias("bytes"))
