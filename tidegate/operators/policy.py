"""What to do with a parsed record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.headers import with_parse
from ..functions.scalars import saturating_add
from ..model import MALFORMED_HEADER, OVER_MAX_DELAY, UNRELAYABLE, RelayOptions


def with_decision(parsed: DataFrame, options: RelayOptions) -> DataFrame:
    """`parsed` with action (RELAY_NOW, SCHEDULE, CLAMP, DLQ or FAIL), reason and clamped; dispatch_at_ms is set for SCHEDULE and CLAMP."""
    malformed = {"DLQ": "DLQ", "RELAY_IMMEDIATE": "RELAY_NOW", "FAIL": "FAIL"}[options.on_malformed]
    over_max = options.on_over_max
    outcome = F.col("outcome")
    action = F.when(outcome == "SCHEDULE", "SCHEDULE").when(outcome == "MALFORMED", malformed).when(outcome == "OVER_MAX", over_max).otherwise("RELAY_NOW")
    latest = saturating_add(F.col("now_ms"), F.lit(options.delay_max_ms).cast("bigint"))
    return bound(
        bound(parsed, {"action": action}),
        {
            "clamped": F.col("action") == "CLAMP",
            "dispatch_at_ms": F.when(F.col("action") == "CLAMP", latest).otherwise(F.col("dispatch_at_ms")),
            "reason": F.when(F.col("action") == "DLQ", F.when(outcome == "MALFORMED", MALFORMED_HEADER).otherwise(OVER_MAX_DELAY)),
        },
    )


def classified(records: DataFrame, now_ms: Column, options: RelayOptions) -> DataFrame:
    return with_decision(with_parse(records, now_ms, options), options)


def failing(decided: DataFrame) -> DataFrame:
    """Records that a FAIL policy stops at. A batch with any must write nothing."""
    return decided.filter("action = 'FAIL'")


def record_bytes(key: Column, value: Column) -> Column:
    """Bytes of key and value, null as none."""
    return (F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def header_bytes(headers: Column) -> Column:
    return F.aggregate(F.coalesce(headers, F.expr("cast(array() as array<struct<key:string,value:binary>>)")), F.lit(0).cast("bigint"), lambda n, h: n + F.octet_length(h["key"]) + F.coalesce(F.octet_length(h["value"]), F.lit(0)))


def with_size_route(decided: DataFrame, options: RelayOptions) -> DataFrame:
    """A record that the destination would refuse for its size goes where `on_unrelayable` says: DLQ, DROP or FAIL."""
    size = record_bytes(F.col("key"), F.col("value")) + header_bytes(F.col("headers"))
    refused = (F.col("action") == "RELAY_NOW") & (F.col("relay_bytes") > options.max_message_bytes)
    return bound(
        bound(decided, {"relay_bytes": size}),
        {"action": F.when(refused, options.on_unrelayable).otherwise(F.col("action")), "reason": F.when(refused & F.lit(options.on_unrelayable == "DLQ"), UNRELAYABLE).otherwise(F.col("reason"))},
    )
