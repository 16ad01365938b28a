"""The ingest query: classify each micro-batch and commit its three outputs together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import SCHEDULE_LOG, RelayOptions
from ..operators import policy, schedule_log, settle
from ..plans.drain import outputs
from .ledger import Ledger

#: Up to where each source partition is ingested.
POSITIONS = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("next_offset", T.LongType())])
#: Where a batch may die: before anything, after its outputs, after its positions, after its marker.
CRASH_POINTS = ("I-1", "I-2", "I-3", "I-4")


class FailPolicy(RuntimeError):
    """A FAIL policy met a record; the batch wrote nothing."""


class WentBack(RuntimeError):
    """A batch holds offsets below those of a batch before it; what it schedules would be lost, so it wrote nothing."""


def positions(ledger: Ledger) -> DataFrame:
    """(partition, next_offset) after the last committed batch."""
    done = ledger.committed()
    return ledger.read("positions", POSITIONS, after=done[-1] - 1) if done else ledger.spark.createDataFrame([], POSITIONS)


def ingest_batch(records: DataFrame, batch_id: int, now_ms: int, options: RelayOptions, ledger: Ledger, crash: Callable[[str], None] = lambda _: None) -> bool:
    """Classify one batch and commit destination, dlq, schedule_log and positions; False if it is committed already.

    The log's rules ignore an ADD below the largest source offset before it, so batches must
    ascend by partition, as a log source's do. One that doesn't raises before any write, and
    so does one in which a FAIL policy meets a record.
    """
    if ledger.is_committed(batch_id):
        return False
    crash("I-1")
    now = F.lit(now_ms).cast("bigint")
    before = positions(ledger)
    decided = policy.with_size_route(policy.classified(records, now, options), options).persist()
    try:
        ends = settle.offsets(decided)
        back = ends.join(before.withColumnRenamed("next_offset", "reached"), "partition").filter("first_offset < reached").first()
        if back:
            raise WentBack(f"partition {back.partition} goes back from {back.reached} to {back.first_offset} in batch {batch_id}")
        if "FAIL" in (options.on_malformed, options.on_over_max, options.on_unrelayable) and (bad := policy.failing(decided).select("partition", "offset").first()):
            raise FailPolicy(f"record {bad.partition}/{bad.offset} in batch {batch_id}")
        for name, rows in outputs(decided, now, options).items():
            if name == "schedule_log":
                rows = schedule_log.appended(rows, batch_id).select(*[f.name for f in SCHEDULE_LOG])
            ledger.write(name, rows, batch_id)
        crash("I-2")
        reached = before.unionByName(ends.select("partition", "next_offset")).groupBy("partition").agg(F.max("next_offset").alias("next_offset"))
        ledger.write("positions", reached.coalesce(1), batch_id)
        crash("I-3")
        ledger.commit(batch_id)
        crash("I-4")
    finally:
        decided.unpersist()
    return True


def start(records: DataFrame, checkpoint: str, options: RelayOptions, ledger: Ledger, clock: Callable[[], int], crash: Callable[[str], None] = lambda _: None, **trigger) -> StreamingQuery:
    """Start the query, by default over what is there now. `crash` is told each point that a batch passes, for fault tests."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, clock(), options, ledger, crash)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
