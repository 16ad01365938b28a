"""What can be known before a query starts: findings over described topics, and a bounded wait for their metadata."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from .config import Report, foreign_writers, retention_findings
from .store import same_identity


@dataclass(frozen=True)
class Topic:
    """A topic as its cluster describes it. retention_ms -1: kept for ever."""

    name: str
    partitions: int
    id: str = ""
    cleanup: str = "delete"
    retention_ms: int = -1
    retention_bytes: int = -1
    tombstone_ms: int | None = None
    replication: int = 3
    min_in_sync: int = 2
    largest_record: int = 1 << 20
    writers: frozenset[str] = field(default_factory=frozenset)


#: First pause, longest pause, and the time after which a wait is worth a warning, in seconds.
FIRST_PAUSE, LONGEST_PAUSE, LONG_WAIT = 0.05, 1.0, 1.0


def described(names: list[str], describe: Callable[[list[str]], Mapping[str, Topic]], report: Report, limit: float = 10.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict[str, Topic]:
    """The topics of that name, once all are visible or `limit` seconds have passed; what is missing then is a finding."""
    began, pause = clock(), FIRST_PAUSE
    while True:
        found = dict(describe(names))
        missing = [n for n in names if n not in found]
        waited = clock() - began
        if not missing or waited >= limit:
            break
        sleep(min(pause, limit - waited))
        pause = min(2 * pause, LONGEST_PAUSE)
    for name in missing:
        report.error(name, f"is not visible after {waited:.1f} s")
    if not missing and waited > LONG_WAIT:
        report.warn("", f"topics took {waited:.1f} s to be visible")
    return found


def findings(source: Topic | None, log: Topic | None, dlq: Topic | None, delay_max_ms: int, report: Report, needs_dlq: bool = True, recorded: str | None = None, live: str = "{}", own_writers: frozenset[str] = frozenset(), transaction_timeout_ms: int = 60_000) -> Report:
    """Whether the source keeps payloads long enough and whole, the log compacts and has the source's partitions, dead letters fit, and the recorded identity is the live one."""
    if source is None:
        report.error("route.source", "does not exist")
    else:
        retention_findings(delay_max_ms, source.retention_ms, report)
        if "compact" in source.cleanup:
            report.error("route.source", "is compacted: payloads may go before they are due")
        if source.retention_bytes >= 0:
            report.warn("route.source", "is cut by size: payloads may go before they are due")
    if log is None:
        report.error("route.schedule-log", "does not exist")
    else:
        if log.cleanup != "compact":
            report.error("route.schedule-log", f"must be compacted, not {log.cleanup}")
        if source is not None and log.partitions != source.partitions:
            report.error("route.schedule-log", f"has {log.partitions} partitions, the source {source.partitions}")
        if log.tombstone_ms is not None:
            retention_findings(delay_max_ms, -1, report, log.tombstone_ms, transaction_timeout_ms)
        if log.min_in_sync < 2 or log.replication < 3:
            report.warn("route.schedule-log", "a lost broker may lose what is scheduled")
        if strangers := foreign_writers(set(log.writers), set(own_writers)):
            report.warn("route.schedule-log", f"others may write to it: {', '.join(sorted(strangers))}")
    if dlq is None:
        if needs_dlq:
            report.error("route.dlq", "does not exist")
    elif source is not None:
        if dlq.name == source.name:
            report.error("route.dlq", "is the source: dead letters would be read again")
        if dlq.largest_record < source.largest_record:
            report.warn("route.dlq", "takes smaller records than the source")
    if not same_identity(recorded, live):
        report.error("route.source", "is not the topic that the committed positions are of")
    return report
