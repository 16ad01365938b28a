"""One dispatch pass as a plan: log, due batch, payloads, outcomes, settlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RelayOptions
from ..operators import due, fetch, policy, relay, schedule_log, settle


def dispatch(log: DataFrame, source: DataFrame, now_ms: Column, options: RelayOptions, most: int = 10_000, budget: int = 32 << 20, penalties: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """The settlements of one due batch, payload columns included. Only pointers pass through fold and poll; payloads join last."""
    return settled(schedule_log.folded(log), source, now_ms, options, most, budget, penalties, refused)


def settled(pending: DataFrame, source: DataFrame, now_ms: Column, options: RelayOptions, most: int, budget: int, penalties: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """The same from pending entries. A found record is refused if it is in `refused` (source_partition, source_offset) or larger than the destination takes."""
    batch = fetch.runs(fetch.positioned(due.top_due(pending, now_ms, most, penalties), *due.ORDER))
    outcomes = fetch.within_budget(fetch.with_outcome(fetch.refetched(batch, source, most), fetch.log_starts(source)), budget)
    size = F.col("bytes") + policy.header_bytes(F.col("headers"))
    rejected = size > options.max_message_bytes
    if refused is not None:
        outcomes = settle.with_refused(outcomes, refused)
        rejected = rejected | F.col("rejected")
    return settle.settlements(outcomes, options, rejected, size > options.max_dlq_bytes if options.max_dlq_bytes else None)


def outputs(decided: DataFrame, now_ms: Column, options: RelayOptions) -> dict[str, DataFrame]:
    """What one ingest batch writes: destination, dead letters and schedule log."""
    return {
        "destination": relay.relayed(decided.filter("action = 'RELAY_NOW'"), now_ms, options),
        "dlq": relay.header_error_dlq(decided.filter("action = 'DLQ'"), now_ms, options),
        "schedule_log": schedule_log.adds(decided),
    }


def settled_outputs(settled: DataFrame, topic: str, now_ms: Column, options: RelayOptions) -> dict[str, DataFrame]:
    """What one dispatch batch writes."""
    found = settled.withColumnsRenamed({"source_partition": "partition", "source_offset": "offset"})
    refused = found.filter("route = 'DLQ_UNRELAYABLE'").withColumn("detail", F.lit("the destination refuses the record"))
    return {
        "destination": relay.relayed(found.filter("route = 'RELAY'"), now_ms, options, scheduled=True),
        "dlq": relay.payload_expired_dlq(settled.filter("route = 'DLQ_EXPIRED'"), topic, now_ms, options).unionByName(relay.unrelayable_dlq(refused, now_ms, options)),
        "schedule_log": settle.completions(settled),
    }
