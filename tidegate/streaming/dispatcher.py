"""The dispatch loop: what is due is fetched, settled and committed, pass by pass.

A pass folds the committed log, takes the first due entries, joins their payloads, and commits
relayed records, dead letters, completions and cursors as one batch of its ledger. What a
pass doesn't settle has no completion, so it is pending in the next. The clock, not new
input, wakes the loop: it sleeps until the next deadline. Between passes nothing is held
but counters and penalties, so a loop that starts anew goes on where the last marker is:
a pass that died before it left nothing that a reader sees, one that died behind it is done.

The log is folded from a snapshot and the batches after it; every `snapshot_every` passes a
pass writes a new one (the compacted log), so a fold's cost follows what is pending and new.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ENTRY_BYTES
from ..model import SCHEDULE_LOG, RelayOptions
from ..operators import cursor, due, schedule_log, settle
from ..plans import drain
from .ingest import FailPolicy
from .ledger import Ledger

CURSORS = T.StructType([T.StructField("source_partition", T.IntegerType()), T.StructField("cursor_offset", T.LongType()), T.StructField("pinned", T.LongType()), T.StructField("degraded", T.BooleanType())])
#: Where a pass may die: before its writes, after them, after its marker.
CRASH_POINTS = ("D-1", "D-2", "D-3")


class Truncated(RuntimeError):
    """A committed cursor is behind what the log still has, or beyond its end."""


class TooManyPending(RuntimeError):
    """What is pending exceeds the state that is allowed."""


@dataclass(frozen=True)
class Limits:
    """Sizes and times of the loop."""

    most: int = 10_000
    budget: int = 32 << 20
    sidecar: int = 3_072
    idle_ms: int = 30_000
    penalty_ms: int = 50
    longest_penalty_ms: int = 10_000
    high: int = 1_000_000
    cap: int = 4_000_000
    state_bytes: int = 0
    snapshot_every: int = 100
    degraded_after: int = 5


@dataclass
class Counters:
    """What the loop has done since it began."""

    passes: int = 0
    relayed: int = 0
    dead_letters: int = 0
    dropped: int = 0
    carried: int = 0
    failures: int = 0
    streak: int = 0
    last_pass_ms: int | None = None
    pending: dict[int, int] = field(default_factory=dict)
    paused: set[int] = field(default_factory=set)


class Dispatcher:
    """One loop over the log that `ingest` writes and the payloads of `source`."""

    def __init__(self, spark: SparkSession, ingest: Ledger, ledger: Ledger, source: Callable[[], DataFrame], topic: str, options: RelayOptions, clock: Callable[[], int], limits: Limits | None = None, crash: Callable[[str], None] = lambda _: None):
        self.spark, self.ingest, self.ledger, self.source, self.topic, self.options = spark, ingest, ledger, source, topic, options
        self.clock, self.limits, self.crash = clock, limits or Limits(), crash
        self.counters = Counters()
        self._streaks: dict[int, int] = {}
        self._not_before: dict[int, int] = {}
        self._next = 0
        self._snapshot = -1
        self._upto = self._read_upto = -1
        self._committed_ms: int | None = None
        self.recovered = False

    # -- state that lies in the ledgers

    def log(self) -> DataFrame:
        """The committed log: a snapshot, what ingest has added since, and completions since."""
        self._read_upto = max(self.ingest.committed(), default=-1)
        tail = self.ingest.read("schedule_log", SCHEDULE_LOG, after=self._upto, upto=self._read_upto).unionByName(self.ledger.read("schedule_log", SCHEDULE_LOG, after=self._snapshot))
        if self._snapshot < 0:
            return tail
        return self.ledger.read("snapshot", SCHEDULE_LOG, after=self._snapshot - 1, upto=self._snapshot).unionByName(tail)

    def cursors(self) -> DataFrame:
        """The cursors of the last committed pass that wrote any."""
        done = self.ledger.committed()
        return self.ledger.read("cursors", CURSORS, after=done[-1] - 1) if done else self.spark.createDataFrame([], CURSORS)

    def recover(self) -> dict[int, int]:
        """Find the last marker, check the cursors against the log, and give its barriers: (partition: high watermark) as of now.

        Nothing is due before: a pass reads the whole committed log, so it is behind every
        barrier by construction. With neither cursors nor completions the log is read from
        its beginning.
        """
        done = self.ledger.committed()
        self._next = done[-1] + 1 if done else 0
        self._snapshot, self._upto = -1, -1
        for n in reversed(done):
            note = self.ledger.note(n)
            if "snapshot_upto" in note:
                self._snapshot, self._upto = n, note["snapshot_upto"]
                break
        bounds = self.log().groupBy("source_partition").agg(F.min("log_offset").alias("first"), (F.max("log_offset") + 1).alias("barrier"))
        wide = bounds.join(self.cursors(), "source_partition", "full").select("source_partition", "first", "barrier", "cursor_offset").collect()  # a row for each partition
        for r in wide:
            if r.cursor_offset is not None and (r.barrier is None or r.cursor_offset > r.barrier):
                raise Truncated(f"partition {r.source_partition}: the cursor is at {r.cursor_offset}, the log ends at {r.barrier}")
        pending = schedule_log.folded(self.log()).count()
        if self.limits.state_bytes and pending * ENTRY_BYTES > self.limits.state_bytes:
            raise TooManyPending(f"{pending} entries need {pending * ENTRY_BYTES} bytes of {self.limits.state_bytes}")
        self.recovered = True
        return {r.source_partition: r.barrier for r in wide if r.barrier is not None}

    # -- one pass

    def _penalties(self) -> DataFrame | None:
        if not self._not_before:
            return None
        return self.spark.createDataFrame(sorted(self._not_before.items()), "source_partition int, not_before_ms bigint")

    def run_once(self) -> dict:
        """One pass; how many entries it settled and carried, and how long to wait for the next."""
        if not self.recovered:
            self.recover()
        now = self.clock()
        at = F.lit(now).cast("bigint")
        log = self.log().persist()
        pending = schedule_log.folded(log).persist()
        settled = None
        try:
            settled = drain.settled(pending, self.source(), at, self.options, self.limits.most, self.limits.budget, self._penalties()).persist()
            routes = {(r.source_partition, r.route, r.fetch_outcome): r["count"] for r in settled.groupBy("source_partition", "route", "fetch_outcome").count().collect()}
            if failing := [p for (p, route, _) in routes if route == "FAIL"]:
                raise FailPolicy(f"entries of partitions {sorted(set(failing))} in pass {self._next}")
            done = sum(n for (_, route, _), n in routes.items() if route != "CARRY")
            if done or self._idle_commit(now):
                self._commit(log, pending, settled, at, done)
                self._committed_ms = now
            self._note(routes, now)
            self._loads(pending, done, settled)
            left = due.next_deadline(cursor.unsettled(pending, settled.filter("reason IS NOT NULL")), self._penalties()).first()[0]
            wait = 0 if any(outcome == "CARRY_OVER" for _, _, outcome in routes) else 30_000 if left is None else max(0, min(30_000, left - now))
            self.counters.passes += 1
            self.counters.streak = 0
            self.counters.last_pass_ms = now
            return {"settled": done, "carried": sum(n for (_, route, _), n in routes.items() if route == "CARRY"), "wait_ms": wait}
        finally:
            for frame in (settled, pending, log):
                if frame is not None:
                    frame.unpersist()

    def _idle_commit(self, now: int) -> bool:
        return self._committed_ms is not None and now - self._committed_ms >= self.limits.idle_ms

    def _commit(self, log: DataFrame, pending: DataFrame, settled: DataFrame, now, done: int) -> None:
        ends = schedule_log.high_watermarks(log)
        rest = cursor.unsettled(pending, settled.filter("reason IS NOT NULL"))
        last = self.cursors().select("source_partition", F.col("cursor_offset").alias("last_safe"))
        completions = schedule_log.appended_after(settle.completions(settled), ends).select(*[f.name for f in SCHEDULE_LOG])
        added = completions.groupBy("source_partition").agg(F.count("*").alias("n"))
        positions = ends.join(added, "source_partition", "left").join(last, "source_partition", "left").select("source_partition", (F.col("high_watermark") + F.coalesce("n", F.lit(0))).alias("position"), "last_safe")
        cursors = cursor.committed_cursor(rest, positions, self.limits.sidecar)
        if not done and cursors.join(last, "source_partition", "left").filter("last_safe IS NULL OR cursor_offset > last_safe").isEmpty():
            return
        number = self._next
        self.crash("D-1")
        for name, rows in drain.settled_outputs(settled, self.topic, now, self.options).items():
            if name != "schedule_log":
                self.ledger.write(name, rows, number)
        self.ledger.write("schedule_log", completions, number)
        self.ledger.write("cursors", cursors.coalesce(1).select(*[F.col(f.name).cast(f.dataType) for f in CURSORS]), number)
        note = {}
        if self.limits.snapshot_every and number % self.limits.snapshot_every == self.limits.snapshot_every - 1:
            # Of ingest, what this pass has read: batches that came meanwhile are left to the tail.
            self.ledger.write("snapshot", schedule_log.compacted(log.unionByName(completions)), number)
            note = {"snapshot_upto": self._read_upto}
        self.crash("D-2")
        self.ledger.commit(number, note)
        self._next = number + 1
        if note:
            self._snapshot, self._upto = number, note["snapshot_upto"]
        self.crash("D-3")

    def _note(self, routes: dict, now: int) -> None:
        """Counters, and penalties: a partition with a transient failure waits, longer with each in a row; one that settles is free."""
        c = self.counters
        for (_, route, _), n in routes.items():
            c.relayed += n if route == "RELAY" else 0
            c.dead_letters += n if route.startswith("DLQ") else 0
            c.dropped += n if route == "DROP" else 0
            c.carried += n if route == "CARRY" else 0
        for p in {p for p, _, _ in routes}:
            outcomes = {outcome for q, _, outcome in routes if q == p}
            if "TRANSIENT" in outcomes:
                self._streaks[p] = self._streaks.get(p, 0) + 1
                self._not_before[p] = now + min(self.limits.longest_penalty_ms, self.limits.penalty_ms << min(self._streaks[p] - 1, 30))
            elif outcomes & {"FOUND", "GONE"}:
                self._streaks.pop(p, None)
                self._not_before.pop(p, None)

    def _loads(self, pending: DataFrame, done: int, settled: DataFrame) -> None:
        """Pending entries by partition, and which partitions ingest should pause."""
        rest = cursor.unsettled(pending, settled.filter("reason IS NOT NULL")) if done else pending
        c = self.counters
        c.pending = {r.source_partition: r.pending for r in due.counts(rest).collect()}
        total = sum(c.pending.values())
        for p, n in c.pending.items():
            if n > self.limits.high or total > self.limits.cap:
                c.paused.add(p)
            elif n <= max(1, self.limits.high // 2) and total <= self.limits.cap // 2:
                c.paused.discard(p)
        c.paused &= set(c.pending)

    # -- the loop

    def run(self, stop: Callable[[], bool], sleep: Callable[[float], None] = time.sleep, fatal: tuple[type[Exception], ...] = (FailPolicy, Truncated, TooManyPending)) -> None:
        """Passes until `stop`. A pass that fails is tried again after a growing pause and a new recovery, however often: the loop is degraded then, not gone. Fatal errors go on."""
        while not stop():
            try:
                wait = self.run_once()["wait_ms"]
            except fatal:
                raise
            except Exception:
                self.counters.failures += 1
                self.counters.streak += 1
                self.recovered = False
                wait = min(10_000, 100 << min(self.counters.streak - 1, 30))
            if wait and not stop():
                sleep(wait / 1000)

    @property
    def degraded(self) -> bool:
        return self.counters.streak >= self.limits.degraded_after

    def snapshot(self, stale_ms: int = 60_000) -> dict:
        """What the endpoints show: a loop is alive while its last pass is not too long ago (or it has just begun), and ready once it has recovered and doesn't fail."""
        c = self.counters
        alive = c.last_pass_ms is None or self.clock() - c.last_pass_ms <= max(stale_ms, 2 * self.limits.idle_ms)
        reasons = {} if alive else {"pass": f"the last pass was at {c.last_pass_ms}"}
        return {"live": alive, "ready": alive and self.recovered and not c.streak, "degraded": self.degraded, "reasons": reasons, "counters": vars(c)}
