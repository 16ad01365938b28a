"""Column expressions for saturating arithmetic, number grammars, byte order and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LONG_MAX, LONG_MIN


def saturating_add(a: Column, b: Column) -> Column:
    """a + b, held at the ends of the long range; null if either is."""
    held = F.when(a > 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), held))


def saturated(x: Column) -> Column:
    """A whole decimal as long, held at the ends of the long range."""
    return F.when(x > LONG_MAX, F.lit(LONG_MAX)).when(x < LONG_MIN, F.lit(LONG_MIN)).otherwise(x.cast("bigint"))


def saturating_multiply(a: Column, b: Column) -> Column:
    held = F.when((a > 0) == (b > 0), F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))
    return F.coalesce(F.try_multiply(a, b), F.when(a.isNotNull() & b.isNotNull(), held))


def is_decimal(text: Column) -> Column:
    """1 to 19 ASCII digits and nothing else, no line end either."""
    return F.coalesce(text.rlike(r"\A[0-9]{1,19}\z"), F.lit(False))


def decode_decimal(text: Column) -> Column:
    """The long of a decimal string; null for any other text, and beyond the long range."""
    return F.when(is_decimal(text), text.try_cast("bigint"))


def long_to_bytes(x: Column) -> Column:
    """8 bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def bytes_to_long(b: Column) -> Column:
    """The long of 8 big-endian bytes; null for any other length."""
    return F.when(F.octet_length(b) == 8, F.conv(F.hex(b), 16, -10).cast("bigint"))


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned LEB128 number that isn't negative."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7.0).cast("int"))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def sanitized(text: Column, limit: int = 40) -> Column:
    """Printable ASCII, `?` for the rest, cut to `limit` characters with an ellipsis."""
    clean = F.regexp_replace(F.substring(text, 1, limit), "[^ -~]", "?")
    return F.when(F.char_length(text) > limit, F.concat(clean, F.lit("…"))).otherwise(clean)


def printable(text: str, limit: int = 64) -> str:
    """Text of a finding or a reason without control characters, cut to `limit`; for records made on the driver."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", "?", text[:limit])


def ascii_bytes(x: Column) -> Column:
    return F.encode(x.cast("string"), "UTF-8")


def backoff_ms(streak: Column, initial_ms: int, max_ms: int) -> Column:
    """min(max, initial * 2^(streak - 1)); 0 for no failures. Doublings beyond the long range saturate."""
    doublings = F.least(F.greatest(streak - 1, F.lit(0)), F.lit(62)).cast("int")
    grown = saturating_multiply(F.lit(initial_ms).cast("bigint"), F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), doublings).cast("bigint"))
    return F.when(streak <= 0, F.lit(0).cast("bigint")).otherwise(F.least(F.lit(max_ms).cast("bigint"), grown))
