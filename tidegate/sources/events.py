"""Source records derived from the `events` table, for tests, queries and benches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.headers import header
from ..model import CREATE_TIME, HeaderNames

PARTITIONS = 4
TOPIC = "events"


def source_records(spark: SparkSession, sf_dir: str, names: HeaderNames | None = None) -> DataFrame:
    """Event n of a user is a record of partition user_id % 4; its type chooses the headers.

    signup: none; click: a delay of value seconds (every tenth twice, the first time
    malformed); purchase: an absolute time; error: a malformed delay; view: both headers,
    the absolute one in the past. All but signup carry a user header between.
    """
    names = names or HeaderNames()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ts_ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    delay = F.floor(F.col("value") * 1000).cast("bigint")
    one = lambda name, value: F.array(header(name, value))
    trace = one("trace", F.col("event_id"))
    kind = F.col("event_type")
    headers: Column = (
        F.when(kind == "click", F.concat(F.when(F.col("event_id") % 10 == 0, one(names.delay_ms, F.lit("zzz"))).otherwise(F.expr("cast(array() as array<struct<key:string,value:binary>>)")), trace, one(names.delay_ms, delay)))
        .when(kind == "purchase", F.concat(trace, one(names.deliver_at, F.col("ts_ms") + delay)))
        .when(kind == "error", F.concat(one(names.delay_ms, F.lit("abc")), trace))
        .when(kind == "view", F.concat(one(names.delay_ms, delay), trace, one(names.deliver_at, F.col("ts_ms") - 1)))
        .otherwise(F.expr("cast(array() as array<struct<key:string,value:binary>>)"))
    )
    placed = bound(events, {"ts_ms": ts_ms, "partition": (F.col("user_id") % PARTITIONS).cast("int")})
    placed = placed.withColumn("offset", (F.row_number().over(Window.partitionBy("partition").orderBy("event_id")) - 1).cast("bigint"))
    return bound(placed, {"headers": headers}).select(
        F.lit(TOPIC).alias("topic"),
        "partition",
        "offset",
        "ts_ms",
        F.lit(CREATE_TIME).alias("timestamp_type"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode("props", "UTF-8").alias("value"),
        "headers",
    )


def schedule_log(decided: DataFrame) -> DataFrame:
    """A schedule log with gaps, duplicates, early and orphan completions and late ADDs, from classified records.

    Every ADD has log offset 3n in its partition. Offsets divisible by 11 are added again
    5 s later; those divisible by 3 complete (every sixth as DROPPED); completions of
    offsets of remainder 1 by 13 come just before their ADD; ADDs of remainder 2 by 17
    come last, below the largest offset seen.
    """
    own = Window.partitionBy("source_partition").orderBy("source_offset")
    base = decided.filter("action IN ('SCHEDULE', 'CLAMP')").select(F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), "dispatch_at_ms", "clamped").withColumn("n", F.row_number().over(own).cast("bigint"))
    n, due, so = F.col("n") * 3, F.col("dispatch_at_ms"), F.col("source_offset")
    late = 1_000_000_000_000
    entry = lambda when, at, op, due_ms, clamped, reason: F.struct(when.alias("keep"), at.alias("log_offset"), F.lit(op).alias("op"), due_ms.cast("bigint").alias("dispatch_at_ms"), clamped.cast("boolean").alias("clamped"), reason.cast("string").alias("reason"))
    none, flag = F.lit(None), F.col("clamped")
    entries = F.array(
        entry(F.lit(True), F.when(so % 17 == 2, n + 3 * late).otherwise(n), "ADD", due, flag, none),
        entry(so % 11 == 0, n + late, "ADD", due + 5000, flag, none),
        entry(so % 3 == 0, n + 2 * late, "COMPLETE", none, none, F.when(so % 6 == 0, "DROPPED").otherwise("DISPATCHED")),
        entry(so % 13 == 1, n - 2, "COMPLETE", none, none, F.lit("REJECTED")),
    )
    return base.select("source_partition", "source_offset", F.inline(entries)).filter("keep").select("source_partition", "log_offset", "op", "source_offset", "dispatch_at_ms", "clamped", "reason")
