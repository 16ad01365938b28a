"""Scheduler stores: a log that folds into pending entries, or a table that is upserted.

Both give DataFrames and take the clock as an argument. Kinds are registered by name.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import ConfigView, Report
from .operators import cursor, due, schedule_log, settle


@dataclass(frozen=True)
class Capabilities:
    kind: str
    exactly_once: bool
    replays: bool


class SchedulerStore(ABC):
    """Pending entries by source partition; partitions become active once recovered."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._active: set[int] = set()
        self._recovering: set[int] = set()
        self._not_before: dict[int, int] = {}
        self._streaks: dict[int, int] = {}
        self._state = "new"
        self.limit = 0

    @property
    @abstractmethod
    def capabilities(self) -> Capabilities: ...

    # A store is configured, validated and started before anything is polled, and closed at the end.

    def configure(self, view: ConfigView) -> None:
        """Take what the store needs from its own part of the configuration."""
        self.limit = view.integer("max-pending", 0)

    def validate(self, report: Report) -> None:
        """Add what speaks against a start."""
        if self.limit < 0:
            report.error("store.max-pending", "must not be negative")

    def start(self) -> None:
        if self._state != "new":
            raise RuntimeError(f"a store that is {self._state} can't start")
        self._state = "started"

    def close(self) -> None:
        self._state = "closed"
        self._active.clear()
        self._recovering.clear()

    def abort(self, batch: DataFrame, now_ms: int, initial_ms: int = 50, longest_ms: int = 10_000) -> None:
        """A polled batch was not committed: its entries stay pending, and their partitions wait, longer with each time in a row."""
        for r in batch.select("source_partition").distinct().collect():  # partitions, not entries
            p = r.source_partition
            self._streaks[p] = self._streaks.get(p, 0) + 1
            self.penalize(p, now_ms + min(longest_ms, initial_ms << min(self._streaks[p] - 1, 30)))

    def committed(self, partitions: set[int]) -> None:
        """Batches of these partitions went through: no penalty is left."""
        for p in partitions:
            self._streaks.pop(p, None)
            self._not_before.pop(p, None)

    def maintenance(self) -> None:
        """What a store does between batches, such as compaction; nothing, unless it says otherwise."""

    @abstractmethod
    def pending(self) -> DataFrame:
        """source_partition, source_offset, dispatch_at_ms, clamped (and log_offset, if there is a log)."""

    def assign(self, partitions: set[int], recovering: bool = False) -> None:
        (self._recovering if recovering else self._active).update(partitions)

    def recovered(self, partitions: set[int]) -> None:
        self._recovering -= partitions
        self._active |= partitions

    def revoke(self, partitions: set[int]) -> None:
        self._active -= partitions
        self._recovering -= partitions
        for p in partitions:
            self._not_before.pop(p, None)

    def penalize(self, partition: int, not_before_ms: int) -> None:
        self._not_before[partition] = not_before_ms

    def penalties(self) -> DataFrame:
        return self.spark.createDataFrame([(p, t) for p, t in sorted(self._not_before.items())], "source_partition int, not_before_ms bigint")

    def eligible(self) -> DataFrame:
        live = self.spark.createDataFrame([(p,) for p in sorted(self._active)], "source_partition int")
        return due.active(self.pending(), live)

    def poll_due(self, now_ms: int, most: int) -> DataFrame:
        return due.top_due(self.eligible(), F.lit(now_ms), most, self.penalties())

    def next_deadline_ms(self) -> int | None:
        return due.next_deadline(self.eligible(), self.penalties()).first()[0]

    def pending_count(self, partition: int) -> int:
        return self.pending().filter(F.col("source_partition") == partition).count() if partition in self._active | self._recovering else 0


class LogStore(SchedulerStore):
    """Reads entries from a log; commits are completions appended to it."""

    def __init__(self, spark: SparkSession, log: Callable[[], DataFrame], append: Callable[[DataFrame], None], replace: Callable[[DataFrame], None] | None = None):
        super().__init__(spark)
        self._log, self._append, self._replace = log, append, replace

    def maintenance(self) -> None:
        """Put the compacted log in the log's place, if there is a way to."""
        if self._replace is not None:
            self._replace(schedule_log.compacted(self._log()))

    def recover(self, pinned: DataFrame, cursors: DataFrame) -> DataFrame:
        """Pending entries from committed cursors and the log behind them, up to its end as of now; the partitions are active then."""
        log = self._log()
        barriers = schedule_log.high_watermarks(log).withColumnRenamed("high_watermark", "barrier")
        beyond = cursors.join(barriers, "source_partition", "left").filter("barrier IS NULL OR cursor_offset > barrier").first()
        if beyond:
            raise ValueError(f"partition {beyond.source_partition}: the cursor {beyond.cursor_offset} is beyond the log's end")
        self.recovered({r.source_partition for r in cursors.select("source_partition").distinct().collect()})
        return cursor.recovered(pinned, log, cursors, barriers)

    @property
    def capabilities(self) -> Capabilities:
        return Capabilities("log", exactly_once=True, replays=True)

    def pending(self) -> DataFrame:
        return schedule_log.folded(self._log())

    def commit(self, settled: DataFrame) -> None:
        """Append the completions of settled entries; carried ones stay pending."""
        self._append(settle.completions(settled))

    def cursors(self, text_budget: int, settling: DataFrame | None = None) -> DataFrame:
        log = self._log()
        pending = schedule_log.folded(log)
        if settling is not None:
            pending = cursor.unsettled(pending, settling)
        positions = schedule_log.high_watermarks(log).select("source_partition", F.col("high_watermark").alias("position"), F.lit(None).cast("bigint").alias("last_safe"))
        return cursor.committed_cursor(pending, positions, text_budget)


class TableStore(SchedulerStore):
    """Keeps one row for each pointer: the newest upsert wins, dispatched ones are marked. The table itself may be any that reads and appends."""

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], append: Callable[[DataFrame], None]):
        super().__init__(spark)
        self._read, self._append = read, append

    @property
    def capabilities(self) -> Capabilities:
        return Capabilities("table", exactly_once=False, replays=False)

    def _newest(self) -> DataFrame:
        own = Window.partitionBy("source_partition", "source_offset").orderBy(F.col("version").desc())
        return self._read().withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")

    def pending(self) -> DataFrame:
        return self._newest().filter("NOT dispatched").select("source_partition", "source_offset", "dispatch_at_ms", "clamped")

    def upsert(self, refs: DataFrame, version: int) -> None:
        """Insert or change pointers; a dispatched pointer stays dispatched."""
        done = self._newest().filter("dispatched").select("source_partition", "source_offset")
        fresh = refs.join(done, ["source_partition", "source_offset"], "left_anti")
        self._append(fresh.select("source_partition", "source_offset", "dispatch_at_ms", "clamped", F.lit(False).alias("dispatched"), F.lit(version).cast("bigint").alias("version")))

    def mark_dispatched(self, batch: DataFrame, version: int) -> None:
        self._append(batch.select("source_partition", "source_offset", "dispatch_at_ms", "clamped", F.lit(True).alias("dispatched"), F.lit(version).cast("bigint").alias("version")))

    def scan_pending(self, partition: int) -> DataFrame:
        return self.pending().filter(F.col("source_partition") == partition)

    def coordinates(self) -> DataFrame:
        """(source_partition, dispatch_at_ms, source_offset) of each partition's first pending entry: all before it is settled. What another engine needs to take over."""
        first = F.min(F.struct("dispatch_at_ms", "source_offset")).alias("first")
        return self.pending().groupBy("source_partition").agg(first).select("source_partition", "first.*")

    def cursor(self, partition: int) -> tuple[int, int] | None:
        """(due time, source offset) of the first pending entry: all before it is settled."""
        row = self.scan_pending(partition).orderBy("dispatch_at_ms", "source_offset").first()
        return (row.dispatch_at_ms, row.source_offset) if row else None


STORES: dict[str, type[SchedulerStore]] = {"log": LogStore, "table": TableStore}


def create(kind: str, *args, **kwargs) -> SchedulerStore:
    if kind not in STORES:
        raise ValueError(f"no store {kind!r}; there are {', '.join(sorted(STORES))}")
    return STORES[kind](*args, **kwargs)


def identity_blob(cluster_id: str, topic_id: str) -> str:
    return json.dumps({"v": 1, "cluster": cluster_id, "topic": topic_id}, sort_keys=True)


def same_identity(recorded: str | None, live: str) -> bool:
    """Whether a recorded identity is that of the live cluster and topic; none recorded passes, an unreadable one doesn't."""
    if not recorded:
        return True
    try:
        return json.loads(recorded) == json.loads(live)
    except ValueError:
        return False
