"""The schedule log: its codec, its fold into pending entries, and its compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.scalars import bytes_to_long, long_to_bytes
from ..model import COMPLETION_REASONS

# Fixed values of the wire format.
MAGIC = 0xC5
VERSION = 1
TYPE_ADD = 1
TYPE_CANCEL = 2
FLAG_CLAMPED = 1
VALUE_BYTES = 12


def adds(decided: DataFrame) -> DataFrame:
    """ADD entries for scheduled and clamped records, without a log offset yet."""
    return decided.filter("action IN ('SCHEDULE', 'CLAMP')").select(F.col("partition").alias("source_partition"), F.lit("ADD").alias("op"), F.col("offset").alias("source_offset"), "dispatch_at_ms", "clamped", F.lit(None).cast("string").alias("reason"))


#: Log offsets that a batch has for itself.
BATCH_OFFSETS = 1 << 40


def appended(entries: DataFrame, batch_id: int) -> DataFrame:
    """Entries of one ingest batch with their log offsets: by batch, then source offset, which ascend together."""
    own = Window.partitionBy("source_partition").orderBy("source_offset")
    return entries.withColumn("log_offset", F.lit(batch_id * BATCH_OFFSETS).cast("bigint") + F.row_number().over(own))


def appended_after(entries: DataFrame, ends: DataFrame) -> DataFrame:
    """Entries with log offsets behind each partition's end, from (source_partition, high_watermark); a batch of completions is bounded by its poll."""
    own = Window.partitionBy("source_partition").orderBy("source_offset")
    return entries.join(ends, "source_partition").withColumn("log_offset", F.col("high_watermark") + F.row_number().over(own) - 1).drop("high_watermark")


def encoded(log: DataFrame, reason_header: str) -> DataFrame:
    """source_partition, log_offset, key, value and headers: 12 bytes for an ADD, a null value and a reason header for a COMPLETE."""
    head = F.hex(F.lit(MAGIC << 24 | VERSION << 16 | TYPE_ADD << 8) + F.when(F.col("clamped"), FLAG_CLAMPED).otherwise(0))
    value = F.unhex(F.concat(head, F.lpad(F.hex("dispatch_at_ms"), 16, "0")))
    reason = F.array(F.struct(F.lit(reason_header).alias("key"), F.encode("reason", "UTF-8").alias("value")))
    none = F.expr("cast(array() as array<struct<key:string,value:binary>>)")
    done = F.col("op") == "COMPLETE"
    return log.select("source_partition", "log_offset", long_to_bytes(F.col("source_offset")).alias("key"), F.when(~done, value).alias("value"), F.when(done, reason).otherwise(none).alias("headers"))


def _byte(value: Column, place: int) -> Column:
    return F.conv(F.hex(F.substring(value, place, 1)), 16, 10).cast("int")


def decoded(wire: DataFrame, reason_header: str) -> DataFrame:
    """source_partition, log_offset, op (ADD, CANCEL, COMPLETE or INVALID), source_offset, dispatch_at_ms, clamped, reason, detail.

    Every input has a result. Unknown flag bits are ignored; an unknown reason is a
    completion all the same; other unknown values are INVALID.
    """
    key, value = F.col("key"), F.col("value")
    found = F.try_element_at(F.filter("headers", lambda h: h["key"] == reason_header), F.lit(-1))
    reason = F.decode(found["value"], "UTF-8")
    size = F.octet_length(value)
    detail = (
        F.when(F.coalesce(F.octet_length(key), F.lit(-1)) != 8, "key is not 8 bytes")
        .when(value.isNull() & reason.isNull(), "tombstone without a reason")
        .when(value.isNull(), F.lit(None))
        .when(size < 2, "value is too short")
        .when(_byte(value, 1) != MAGIC, "wrong magic")
        .when(_byte(value, 2) != VERSION, "unknown version")
        .when(size != VALUE_BYTES, "value is not 12 bytes")
        .when(~_byte(value, 3).isin(TYPE_ADD, TYPE_CANCEL), "unknown type")
    )
    out = bound(wire, {"detail": detail, "reason": F.when(value.isNull(), reason)})
    op = F.when(F.col("detail").isNotNull(), "INVALID").when(value.isNull(), "COMPLETE").when(_byte(value, 3) == TYPE_ADD, "ADD").otherwise("CANCEL")
    out = bound(out, {"op": op})
    is_add = F.col("op") == "ADD"
    return out.select(
        "source_partition",
        "log_offset",
        "op",
        F.when(F.octet_length(key) == 8, bytes_to_long(key)).alias("source_offset"),
        F.when(is_add, bytes_to_long(F.substring(value, 5, 8))).alias("dispatch_at_ms"),
        F.when(is_add, _byte(value, 4).bitwiseAND(FLAG_CLAMPED) == 1).alias("clamped"),
        F.when(F.col("op") == "COMPLETE", F.col("reason")).alias("reason"),
        "detail",
    )


def known_reason(reason: Column) -> Column:
    """Whether a completion's reason is one of ours; it completes either way."""
    return reason.isin(*COMPLETION_REASONS)


#: Source offsets that one window goes over, at most; a partition is cut into ranges of as many.
RANGE = 1 << 20


def _entries(log: DataFrame, span: int) -> DataFrame:
    """By (partition, source offset): where it was inserted, its newest due time and flag, its ADDs, where it was completed last, and whether it is its partition's largest.

    An ADD inserts if no larger source offset was added before it, so only the first of a
    source offset can, and it does if it stands before the first ADD of every larger
    offset. The log is read once, for an aggregate with partial results in the map tasks.
    On its rows, each range of source offsets has its earliest ADD, a window over those few
    has the earliest beyond each range, and a window within each range has the rest: no
    task goes over a whole partition.
    """
    added, at = F.col("op") == "ADD", F.col("log_offset")
    by_key = log.groupBy("source_partition", "source_offset").agg(
        F.min(F.when(added, at)).alias("first_add"),
        F.max_by("dispatch_at_ms", F.when(added, at)).alias("dispatch_at_ms"),
        F.max_by("clamped", F.when(added, at)).alias("clamped"),
        F.max(F.when(F.col("op") == "COMPLETE", at)).alias("done_at"),
        F.count_if(added).alias("adds"),
    ).withColumn("_range", F.floor(F.col("source_offset") / F.lit(span)))
    beyond = Window.partitionBy("source_partition").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_key.groupBy("source_partition", "_range").agg(F.min("first_add").alias("_first")).select("source_partition", "_range", F.min("_first").over(beyond).alias("_beyond"))
    larger = Window.partitionBy("source_partition", "_range").orderBy(F.col("source_offset").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wide = by_key.join(ranges, ["source_partition", "_range"]).withColumn("_earliest", F.least(F.min("first_add").over(larger), "_beyond"))
    inserts = F.col("first_add").isNotNull() & (F.col("_earliest").isNull() | (F.col("first_add") < F.col("_earliest")))
    return wide.select("source_partition", "source_offset", F.when(inserts, F.col("first_add")).alias("log_offset"), "dispatch_at_ms", "clamped", "done_at", "adds", (F.col("_earliest").isNull() & (F.col("adds") > 0)).alias("is_largest"))


_PENDING = "log_offset IS NOT NULL AND (done_at IS NULL OR done_at < log_offset)"


def folded(log: DataFrame, span: int = RANGE) -> DataFrame:
    """Pending entries: source_partition, source_offset, log_offset, dispatch_at_ms, clamped.

    An ADD of a source offset above all seen before in its partition inserts. A further
    ADD of a pending offset changes due time and flag but keeps the first log offset; any
    other ADD is ignored. A COMPLETE removes an entry inserted earlier; a completed one
    never returns. CANCEL and INVALID entries change nothing.

    One aggregate by (partition, source offset) and windows over ranges of its rows; see
    `_entries`.
    """
    return _entries(log, span).filter(_PENDING).drop("done_at", "adds", "is_largest")


def anomalies(log: DataFrame, span: int = RANGE) -> DataFrame:
    """source_partition and anomalies: ADDs at or below the largest offset seen before them, which are all that don't insert."""
    return _entries(log, span).filter("adds > 0").groupBy("source_partition").agg((F.sum("adds") - F.count("log_offset")).alias("anomalies"))


def high_watermarks(log: DataFrame) -> DataFrame:
    return log.groupBy("source_partition").agg((F.max("log_offset") + 1).alias("high_watermark"))


def compacted(log: DataFrame, span: int = RANGE) -> DataFrame:
    """The log of pending entries only; it folds to the same pending entries.

    The entry with the largest source offset of each partition stays even if completed:
    later ADDs at or below it must still be ignored. The fold's aggregate names what stays;
    a semi join keeps it.
    """
    stays = _entries(log, span).filter(f"is_largest OR ({_PENDING})").select("source_partition", "source_offset")
    return log.join(stays, ["source_partition", "source_offset"], "left_semi").select(*log.columns)
