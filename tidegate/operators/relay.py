"""Records for the destination and for the dead-letter topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import has_timestamp, header, stripped
from ..model import PAYLOAD_EXPIRED, UNRELAYABLE, RelayOptions

_NONE = "cast(array() as array<struct<key:string,value:binary>>)"


def provenance(now_ms: Column, options: RelayOptions) -> Column:
    """Where and when a record comes from, as headers in a fixed order; the source timestamp only if there is one."""
    name = options.names.of
    timed = has_timestamp(F.col("ts_ms"), F.col("timestamp_type"))
    return F.concat(
        F.array(header(name("relayed-at"), now_ms), header(name("source-topic"), F.col("topic")), header(name("source-partition"), F.col("partition")), header(name("source-offset"), F.col("offset"))),
        F.when(timed, F.array(header(name("source-timestamp"), F.col("ts_ms")))).otherwise(F.expr(_NONE)),
    )


def relayed(records: DataFrame, now_ms: Column, options: RelayOptions, scheduled: bool = False) -> DataFrame:
    """topic-less records for the destination; scheduled ones need dispatch_at_ms and clamped.

    Control headers go, all others stay in order. A clamped record says so even if
    provenance is off.
    """
    own = stripped(F.col("headers"), options.names)
    parts = [own]
    if scheduled:
        parts.append(F.when(F.col("clamped"), F.array(header(options.names.of("clamped"), F.lit("true")))).otherwise(F.expr(_NONE)))
    if options.provenance:
        parts.append(provenance(now_ms, options))
        if scheduled:
            parts.append(F.array(header(options.names.of("scheduled-for"), F.col("dispatch_at_ms"))))
    timed = F.when(has_timestamp(F.col("ts_ms"), F.col("timestamp_type")), F.col("ts_ms"))
    return records.select(
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        (F.col("partition") if options.partitioning == "SOURCE_PARTITION" else F.lit(None).cast("int")).alias("out_partition"),
        (now_ms.cast("bigint") if options.timestamps == "DISPATCH" else timed).alias("out_ts_ms"),
        "key",
        "value",
        F.concat(*parts).alias("headers"),
    )


def header_error_dlq(records: DataFrame, now_ms: Column, options: RelayOptions, reason: Column | None = None) -> DataFrame:
    """Dead letters with the whole original record: all its headers, then reason, detail and provenance, whatever the options."""
    name = options.names.of
    extra = F.array(header(name("error-reason"), F.col("reason") if reason is None else reason), header(name("error-detail"), F.coalesce(F.col("detail"), F.lit(""))))
    return records.select(
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.lit(None).cast("int").alias("out_partition"),
        now_ms.cast("bigint").alias("out_ts_ms"),
        "key",
        "value",
        F.concat(F.coalesce(F.col("headers"), F.expr(_NONE)), extra, provenance(now_ms, options)).alias("headers"),
    )


def unrelayable_dlq(records: DataFrame, now_ms: Column, options: RelayOptions) -> DataFrame:
    return header_error_dlq(records, now_ms, options, F.lit(UNRELAYABLE))


def loss_notice(topic: Column, now_ms: Column) -> Column:
    """The JSON of a payload that is gone; its fields are fixed in name and order."""
    return F.to_json(
        F.struct(
            F.lit(1).alias("v"),
            topic.alias("sourceTopic"),
            F.col("source_partition").alias("sourcePartition"),
            F.col("source_offset").alias("sourceOffset"),
            F.col("dispatch_at_ms").alias("scheduledFor"),
            now_ms.cast("bigint").alias("detectedAt"),
            F.lit(PAYLOAD_EXPIRED).alias("reason"),
        )
    )


def payload_expired_dlq(gone: DataFrame, topic: str, now_ms: Column, options: RelayOptions) -> DataFrame:
    """Loss notices for pointers whose payload is gone."""
    return gone.select(
        "source_partition",
        "source_offset",
        F.lit(None).cast("int").alias("out_partition"),
        now_ms.cast("bigint").alias("out_ts_ms"),
        F.lit(None).cast("binary").alias("key"),
        F.encode(loss_notice(F.lit(topic), now_ms), "UTF-8").alias("value"),
        F.array(header(options.names.of("error-reason"), F.lit(PAYLOAD_EXPIRED))).alias("headers"),
    )


def headers_text(headers: Column) -> Column:
    """Headers as one string, for comparison."""
    return F.array_join(F.transform(headers, lambda h: F.concat(h["key"], F.lit("="), F.coalesce(F.decode(h["value"], "UTF-8"), F.lit("null")))), ";")
