"""Column expressions over ordered, repeatable headers, and the delay grammar.

The clock is always an argument: a literal captured once for a batch, or a column in replays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NO_TIMESTAMP_TYPE, HeaderNames, RelayOptions
from .binding import bound
from .scalars import ascii_bytes, bytes_to_long, decode_decimal, is_decimal, sanitized, saturating_add


def named(headers: Column, name: str) -> Column:
    """All headers of a name, in order; null for null headers."""
    return F.filter(headers, lambda h: h["key"] == name)


def occurrences(headers: Column, name: str) -> Column:
    return F.greatest(F.coalesce(F.size(named(headers, name)), F.lit(0)), F.lit(0))


def last_header(headers: Column, name: str) -> Column:
    """The last header struct of a name; null without one."""
    return F.try_element_at(named(headers, name), F.lit(-1))


def conflicted(headers: Column, names: HeaderNames) -> Column:
    """Both control headers, or one of them more than once."""
    delay, at = occurrences(headers, names.delay_ms), occurrences(headers, names.deliver_at)
    return ((delay > 0) & (at > 0)) | (delay > 1) | (at > 1)


def stripped(headers: Column, names: HeaderNames) -> Column:
    """All headers but the two control headers, in order."""
    return F.filter(F.coalesce(headers, F.expr("cast(array() as array<struct<key:string,value:binary>>)")), lambda h: ~h["key"].isin(*names.control))


def header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), ascii_bytes(value).alias("value"))


def has_timestamp(ts_ms: Column, timestamp_type: Column) -> Column:
    return F.coalesce((timestamp_type != NO_TIMESTAMP_TYPE) & (ts_ms >= 0), F.lit(False))


def with_parse(records: DataFrame, now_ms: Column, options: RelayOptions) -> DataFrame:
    """`records` with outcome, requested_at_ms, dispatch_at_ms, detail and conflicted.

    deliver-at wins over delay-ms, even malformed. A delay counts from the record's
    timestamp if it has one, else from the clock; its range is checked before the past.
    """
    names, max_ms = options.names, F.lit(options.delay_max_ms).cast("bigint")
    # Headers are searched once for each name; everything else is read from what was found.
    found = bound(records, {"_ats": named(F.col("headers"), names.deliver_at), "_delays": named(F.col("headers"), names.delay_ms), "_now": now_ms.cast("bigint")})
    n_at, n_delay = F.coalesce(F.size("_ats"), F.lit(0)), F.coalesce(F.size("_delays"), F.lit(0))
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))
    out = bound(found, {"_at": last("_ats"), "_delay": last("_delays"), "conflicted": ((n_at > 0) & (n_delay > 0)) | (n_at > 1) | (n_delay > 1)}).drop("_ats", "_delays")
    raw = F.when(F.col("_at").isNotNull(), F.col("_at.value")).otherwise(F.col("_delay.value"))
    name = F.when(F.col("_at").isNotNull(), F.lit(names.deliver_at)).otherwise(F.lit(names.delay_ms))
    out = bound(out, {"_raw": raw, "_name": name, "_latest": saturating_add(F.col("_now"), max_ms)})
    if options.binary_values:
        number = bytes_to_long(F.col("_raw"))
        error = F.concat(F.lit(": binary mode expects exactly 8 bytes, got "), F.octet_length("_raw").cast("string"))
    else:
        text = F.decode(F.col("_raw"), "UTF-8")
        number = decode_decimal(text)
        error = F.when(is_decimal(text), F.concat(F.lit(': exceeds signed 64-bit range: "'), text, F.lit('"'))).otherwise(F.concat(F.lit(': not ASCII decimal: "'), sanitized(text), F.lit('"')))
    out = bound(out, {"_number": number, "_error": F.when(F.col("_raw").isNull(), F.lit(": null value")).otherwise(error)})
    base = F.when(has_timestamp(F.col("ts_ms"), F.col("timestamp_type")), F.col("ts_ms")).otherwise(F.col("_now"))
    is_at, n, latest = F.col("_at").isNotNull(), F.col("_number"), F.col("_latest")
    out = bound(out, {"requested_at_ms": F.when(is_at, n).otherwise(saturating_add(base, n))})
    asked = F.col("requested_at_ms")
    negative = ~is_at & (n < 0)
    over = (~is_at & (n > max_ms)) | (asked > latest)
    outcome = (
        F.when(F.col("_at").isNull() & F.col("_delay").isNull(), F.lit("NO_DELAY"))
        .when(n.isNull() | negative, F.lit("MALFORMED"))
        .when(over, F.lit("OVER_MAX"))
        .when(asked <= F.col("_now"), F.lit("RELAY_IMMEDIATELY"))
        .otherwise(F.lit("SCHEDULE"))
    )
    out = bound(out, {"outcome": outcome})
    reason = (
        F.when(n.isNull(), F.col("_error"))
        .when(negative, F.concat(F.lit(": negative delay: "), n.cast("string")))
        .when(is_at | (n <= max_ms), F.concat(F.lit(": "), asked.cast("string"), F.lit(" is later than the latest allowed "), latest.cast("string")))
        .otherwise(F.concat(F.lit(": "), n.cast("string"), F.lit(" ms is more than the maximum "), max_ms.cast("string"), F.lit(" ms")))
    )
    faulty = F.col("outcome").isin("MALFORMED", "OVER_MAX")
    return bound(
        out,
        {
            "detail": F.when(faulty, F.concat(F.col("_name"), reason)),
            "dispatch_at_ms": F.when(F.col("outcome") == "SCHEDULE", asked),
            "requested_at_ms": F.when(F.col("outcome").isin("SCHEDULE", "OVER_MAX", "RELAY_IMMEDIATELY"), asked),
            "now_ms": F.col("_now"),
        },
    ).drop("_at", "_delay", "_now", "_raw", "_name", "_latest", "_number", "_error")
