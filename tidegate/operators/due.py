"""Which pending entries are due, in what order, and when to look again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms, saturating_add

ORDER = ("effective_at_ms", "source_partition", "dispatch_at_ms", "source_offset")


def active(pending: DataFrame, partitions: DataFrame) -> DataFrame:
    """Entries of partitions that may dispatch; a recovering partition contributes nothing."""
    return pending.join(partitions.select("source_partition").distinct(), "source_partition", "left_semi")


def with_effective(pending: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """`pending` with effective_at_ms: the due time, or the end of its partition's penalty if that is later. One penalty for each partition."""
    if penalties is None:
        return pending.withColumn("effective_at_ms", F.col("dispatch_at_ms"))
    own = penalties.select("source_partition", "not_before_ms")
    return pending.join(own, "source_partition", "left").withColumn("effective_at_ms", F.greatest("dispatch_at_ms", F.coalesce("not_before_ms", "dispatch_at_ms"))).drop("not_before_ms")


def due(pending: DataFrame, now_ms: Column, penalties: DataFrame | None = None) -> DataFrame:
    return with_effective(pending, penalties).filter(F.col("effective_at_ms") <= now_ms)


def top_due(pending: DataFrame, now_ms: Column, most: int, penalties: DataFrame | None = None) -> DataFrame:
    """The first `most` due entries in due order; no full sort."""
    return due(pending, now_ms, penalties).orderBy(*ORDER).limit(most)


def ranked(pending: DataFrame) -> DataFrame:
    """due_rank within a partition, by due time, then source offset."""
    return pending.withColumn("due_rank", F.row_number().over(Window.partitionBy("source_partition").orderBy("dispatch_at_ms", "source_offset")))


def counts(pending: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """Pending entries by partition; 0 for a partition of `partitions` that has none."""
    out = pending.groupBy("source_partition").agg(F.count("*").alias("pending"))
    if partitions is not None:
        out = partitions.select("source_partition").distinct().join(out, "source_partition", "left").fillna(0, ["pending"])
    return out


def next_deadline(pending: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """One row: the smallest effective due time, null if nothing is pending."""
    return with_effective(pending, penalties).agg(F.min("effective_at_ms").alias("next_deadline_ms"))


def poll_timeout(next_deadline_ms: Column, now_ms: Column, recovering: Column, longest_ms: int = 30_000, recovering_ms: int = 10) -> Column:
    """How long to wait: until the next deadline, within [0, longest]; shortly while a recovery goes on."""
    left = F.coalesce(F.try_subtract(next_deadline_ms, now_ms), F.lit(longest_ms).cast("bigint"))
    wait = F.greatest(F.lit(0).cast("bigint"), F.least(left, F.lit(longest_ms).cast("bigint")))
    return F.when(recovering, F.least(wait, F.lit(recovering_ms).cast("bigint"))).otherwise(wait)


def penalty_stamps(failures: DataFrame, now_ms: Column, initial_ms: int = 50, longest_ms: int = 10_000) -> DataFrame:
    """source_partition, not_before_ms from (source_partition, streak): doubling with each failure in a row, 0 after a success."""
    stamp = F.when(F.col("streak") > 0, saturating_add(now_ms.cast("bigint"), backoff_ms(F.col("streak"), initial_ms, longest_ms))).otherwise(F.lit(0).cast("bigint"))
    return failures.select("source_partition", "streak", stamp.alias("not_before_ms"))


def streaks(attempts: DataFrame) -> DataFrame:
    """(source_partition, attempt, failed) with streak: failures in a row up to each attempt."""
    own = Window.partitionBy("source_partition").orderBy("attempt")
    island = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(own)
    in_island = Window.partitionBy("source_partition", "_island").orderBy("attempt")
    return attempts.withColumn("_island", island).withColumn("streak", F.sum(F.col("failed").cast("bigint")).over(in_island)).drop("_island")


def backpressure(loads: DataFrame, high: int, cap: int) -> DataFrame:
    """(source_partition, pending, paused, recovering) with pauses: a partition pauses above `high`, or all do above `cap` in total, and resumes at half of both. A recovering one never pauses."""
    low, low_cap = max(1, high // 2), cap // 2
    total = loads.agg(F.sum("pending").alias("total"))
    out = loads.crossJoin(F.broadcast(total))  # one row
    over = (F.col("pending") > high) | (F.col("total") > cap)
    under = (F.col("pending") <= low) & (F.col("total") <= low_cap)
    return out.withColumn("pauses", F.when(F.col("recovering"), False).when(over, True).when(under, False).otherwise(F.col("paused"))).drop("total")
