"""Pending entries as keyed state with timers, for a query that hands due ones out.

State is kept by source partition, whose log order decides what inserts. A partition is the
unit of order and of parallelism, as it is in the log itself. Timers run on processing
time, so an idle log fires too. Entries stay until their completion arrives in the log: one
that was handed out and isn't completed in `retry_ms` (carried over, or its payload could
not be had) is handed out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "source_partition int, source_offset bigint, log_offset bigint, dispatch_at_ms bigint, clamped boolean"
_VALUE = "log_offset bigint, dispatch_at_ms bigint, clamped boolean, armed_ms bigint"


def net_changes(rows: pd.DataFrame, seen: int) -> tuple[pd.DataFrame, int]:
    """One row for each source offset of a batch of log rows: where it inserts (NaN: it doesn't), its newest ADD, its last completion; and the largest offset seen."""
    rows = rows.sort_values("log_offset")
    added = rows["op"] == "ADD"
    offsets = rows["source_offset"].where(added)
    before = offsets.cummax().shift().ffill().fillna(seen).clip(lower=seen)
    inserts = rows["log_offset"].where(added & (rows["source_offset"] > before))
    frame = pd.DataFrame({"source_offset": rows["source_offset"], "inserts": inserts, "added": rows["log_offset"].where(added), "done": rows["log_offset"].where(rows["op"] == "COMPLETE"), "due": rows["dispatch_at_ms"].where(added), "clamped": rows["clamped"].where(added)})
    by = frame.groupby("source_offset")
    out = pd.DataFrame({"inserts": by["inserts"].min(), "added": by["added"].max(), "done": by["done"].max(), "due": by["due"].last(), "clamped": by["clamped"].last()}).reset_index()
    top = offsets.max()
    return out, max(seen, int(top)) if pd.notna(top) else seen


class DueEntries(StatefulProcessor):
    """Holds the pending entries of one source partition and hands each out once its due time has passed."""

    def __init__(self, retry_ms: int):
        self._retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getMapState("pending", "source_offset bigint", _VALUE)
        self._at = handle.getMapState("at", "at_ms bigint", "offsets array<bigint>")
        self._seen = handle.getValueState("seen", "source_offset bigint")

    def _arm(self, at_ms: int, offsets: list[int]) -> None:
        held = list(self._at.getValue((at_ms,))[0]) if self._at.containsKey((at_ms,)) else []
        self._at.updateValue((at_ms,), (held + offsets,))
        if not held:
            self._handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes, seen = net_changes(pd.concat(list(rows)), self._seen.get()[0] if self._seen.exists() else -1)
        armed: dict[int, list[int]] = {}
        for offset, inserts, added, done, due, clamped in changes.itertuples(index=False):
            name, is_new = (int(offset),), pd.notna(inserts)
            old = self._pending.getValue(name) if self._pending.containsKey(name) else None
            if pd.notna(done) and (old is not None or is_new and done > inserts):
                # Completed; an insert behind it can only be of an offset that was not pending before.
                if old is not None:
                    self._pending.removeKey(name)
                if not is_new or done > inserts:
                    continue
                old = None
            if pd.isna(added) or not is_new and old is None:
                continue
            self._pending.updateValue(name, (int(inserts if is_new else old[0]), int(due), bool(clamped), int(due)))
            armed.setdefault(int(due), []).append(name[0])
        for at_ms, offsets in sorted(armed.items()):
            self._arm(at_ms, offsets)
        self._seen.update((seen,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at_ms = expiredTimerInfo.getExpiryTimeInMs()
        if not self._at.containsKey((at_ms,)):
            return
        out, again = [], timerValues.getCurrentProcessingTimeInMs() + self._retry_ms
        for offset in sorted(set(self._at.getValue((at_ms,))[0])):
            # Entries that are completed, or were given another time since, have nothing to do here.
            value = self._pending.getValue((offset,)) if self._pending.containsKey((offset,)) else None
            if value is not None and value[3] == at_ms:
                out.append((int(key[0]), offset, int(value[0]), int(value[1]), bool(value[2])))
                self._pending.updateValue((offset,), (*value[:3], again))
        self._at.removeKey((at_ms,))
        if out:
            self._arm(again, [row[1] for row in out])
            yield pd.DataFrame(sorted(out, key=lambda r: (r[3], r[1])), columns=["source_partition", "source_offset", "log_offset", "dispatch_at_ms", "clamped"])

    def close(self) -> None:
        pass


def due_entries(log: DataFrame, retry_ms: int = 30_000) -> DataFrame:
    """A streaming DataFrame of due entries from a streaming log. Needs the RocksDB state store."""
    return log.groupBy("source_partition").transformWithStateInPandas(DueEntries(retry_ms), outputStructType=OUTPUT, outputMode="append", timeMode="ProcessingTime")
