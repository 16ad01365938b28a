"""Committed cursors with the entries they pin, and recovery from them."""

from __future__ import annotations

import base64
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import varint_length, zigzag
from .schedule_log import folded

#: Bytes of a sidecar before its entries: version, two 16-byte ids, and the cluster id with its length.
FIXED_BYTES = 34
VERSION = 1


def raw_budget(text_budget: int) -> int:
    """Bytes that so many characters of unpadded Base64 can hold."""
    return text_budget * 3 // 4


def entry_lengths(pending: DataFrame) -> DataFrame:
    """`pending` with entry_bytes: a flag byte and varints of the steps from the entry before it in log order (zigzag where they may fall)."""
    own = Window.partitionBy("source_partition").orderBy("log_offset")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(own), F.lit(0))
    return pending.withColumn("entry_bytes", (F.lit(1) + varint_length(step("log_offset")) + varint_length(zigzag(step("source_offset"))) + varint_length(zigzag(step("dispatch_at_ms")))).cast("bigint"))


def sidecar_prefix(pending: DataFrame, text_budget: int, cluster_id_bytes: int = 0) -> DataFrame:
    """Entries with fits: whether the sidecar holds all up to this one, oldest first."""
    own = Window.partitionBy("source_partition").orderBy("log_offset").rowsBetween(Window.unboundedPreceding, 0)
    return entry_lengths(pending).withColumn("used_bytes", F.sum("entry_bytes").over(own) + FIXED_BYTES + cluster_id_bytes).withColumn("fits", F.col("used_bytes") <= raw_budget(text_budget))


def committed_cursor(pending: DataFrame, positions: DataFrame, text_budget: int, cluster_id_bytes: int = 0) -> DataFrame:
    """source_partition, cursor_offset, pinned: the live position if all entries fit, else the log offset of the first that doesn't. `positions`: (source_partition, position, last_safe); the cursor never goes back behind last_safe."""
    # An entry has four bytes at least, so the one that doesn't fit is among the first of these; no window goes further.
    most = raw_budget(text_budget) // 4 + 1
    own = Window.partitionBy("source_partition").orderBy("log_offset")
    first = pending.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= most).drop("_n")
    marked = sidecar_prefix(first, text_budget, cluster_id_bytes)
    stops = marked.groupBy("source_partition").agg(F.min(F.when(~F.col("fits"), F.col("log_offset"))).alias("stop"), F.count_if("fits").alias("pinned"))
    out = positions.join(stops, "source_partition", "left")
    wanted = F.coalesce("stop", "position")
    back = wanted < F.col("last_safe")
    return out.select("source_partition", F.when(back, F.col("last_safe")).otherwise(wanted).alias("cursor_offset"), F.coalesce("pinned", F.lit(0)).alias("pinned"), F.coalesce(back, F.lit(False)).alias("degraded"))


def unsettled(pending: DataFrame, settling: DataFrame) -> DataFrame:
    """Pending entries that this commit doesn't settle: those the cursor must still cover."""
    return pending.join(settling.select("source_partition", "source_offset"), ["source_partition", "source_offset"], "left_anti")


def oldest(pending: DataFrame, most: int) -> DataFrame:
    return pending.orderBy("log_offset", "source_partition").limit(most)


def recovered(pinned: DataFrame, log: DataFrame, cursors: DataFrame, barriers: DataFrame) -> DataFrame:
    """Pending entries from the pinned ones of a cursor and the log in [cursor, barrier).

    Pinned entries are replayed as the ADDs they were, so the fold's rules hold; the
    largest source offset before the cursor comes with the cursor (max_seen).
    """
    bounds = cursors.join(barriers, "source_partition")
    seeds = pinned.select("source_partition", "log_offset", F.lit("ADD").alias("op"), "source_offset", "dispatch_at_ms", "clamped", F.lit(None).cast("string").alias("reason"))
    tail = log.join(bounds, "source_partition").filter("log_offset >= cursor_offset AND log_offset < barrier").select(*seeds.columns)
    seen = cursors.filter("max_seen IS NOT NULL").select("source_partition", "max_seen")
    # ADDs of the tail at or below max_seen can only be updates of pinned entries.
    known = pinned.select("source_partition", "source_offset", F.lit(True).alias("is_pinned"))
    tail = tail.join(seen, "source_partition", "left").join(known, ["source_partition", "source_offset"], "left")
    keeps = (F.col("op") != "ADD") | F.col("max_seen").isNull() | (F.col("source_offset") > F.col("max_seen")) | F.coalesce("is_pinned", F.lit(False))
    return folded(seeds.unionByName(tail.filter(keeps).select(*seeds.columns)))


def replay_remaining(positions: DataFrame, barriers: DataFrame) -> DataFrame:
    return positions.join(barriers, "source_partition").select("source_partition", F.greatest(F.lit(0), F.col("barrier") - F.col("position")).alias("remaining"))


@dataclass(frozen=True)
class Pin:
    log_offset: int
    source_offset: int
    dispatch_at_ms: int
    clamped: bool


def _put(out: bytearray, x: int) -> None:
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)


def _get(data: bytes, at: int) -> tuple[int, int]:
    x = 0
    for k in range(10):
        if at >= len(data):
            raise ValueError("sidecar is cut short")
        byte = data[at]
        at += 1
        x |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            if x >= 1 << 64:
                break
            return x, at
    raise ValueError("sidecar number is beyond 64 bits")


def encode_sidecar(cluster_id: str, source_id: bytes, log_id: bytes, pins: list[Pin], text_budget: int) -> tuple[str, int]:
    """URL-safe unpadded Base64 of as many entries as fit, oldest first, and how many those are. Runs on the driver: the budget bounds it."""
    name = cluster_id.encode()
    if len(source_id) != 16 or len(log_id) != 16 or len(name) > 127:
        raise ValueError("ids must have 16 bytes, the cluster id at most 127")
    out = bytearray(struct.pack("BB", VERSION, len(name)) + name + source_id + log_id)
    before = Pin(0, 0, 0, False)
    for n, pin in enumerate(sorted(pins, key=lambda p: p.log_offset)):
        one = bytearray()
        _put(one, pin.log_offset - before.log_offset)
        for a, b in ((pin.source_offset, before.source_offset), (pin.dispatch_at_ms, before.dispatch_at_ms)):
            d = a - b
            _put(one, (d << 1) ^ (d >> 63))
        one.append(int(pin.clamped))
        if len(out) + len(one) > raw_budget(text_budget):
            return base64.urlsafe_b64encode(out).rstrip(b"=").decode(), n
        out += one
        before = pin
    return base64.urlsafe_b64encode(out).rstrip(b"=").decode(), len(pins)


def decode_sidecar(text: str) -> tuple[str, bytes, bytes, list[Pin]]:
    """cluster id, ids and entries; raises ValueError for anything else."""
    try:
        data = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except ValueError as e:
        raise ValueError("sidecar is not Base64") from e
    if len(data) < 2 or data[0] != VERSION:
        raise ValueError("unknown sidecar version")
    at = 2 + data[1]
    if len(data) < at + 32:
        raise ValueError("sidecar is cut short")
    name, source_id, log_id = data[2:at].decode(), data[at : at + 16], data[at + 16 : at + 32]
    at += 32
    pins, before = [], Pin(0, 0, 0, False)
    while at < len(data):
        step, at = _get(data, at)
        if step < 1:
            raise ValueError("log offsets must ascend")
        parts = []
        for base in (before.source_offset, before.dispatch_at_ms):
            z, at = _get(data, at)
            parts.append(base + ((z >> 1) ^ -(z & 1)))
        if at >= len(data):
            raise ValueError("sidecar is cut short")
        before = Pin(before.log_offset + step, *parts, bool(data[at] & 1))
        at += 1
        pins.append(before)
    return name, source_id, log_id, pins

