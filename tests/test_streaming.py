"""Ingest and dispatch over ledgers, with faults at every point; due entries from keyed state."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.model import SCHEDULE_LOG, SOURCE, RelayOptions
from tidegate.operators import schedule_log
from tidegate.sources import files
from tidegate.streaming import dispatch, dispatcher, ingest, supervisor
from tidegate.streaming.ledger import Ledger

NOW = 1_700_000_000_000


def records(spark, n, first=0, delay=5000):
    heads = {0: [], 1: [("relay-delay-ms", str(delay).encode())], 2: [("relay-delay-ms", b"bad")]}
    return spark.createDataFrame([("t", i % 2, i // 2, NOW, 0, str(i).encode(), b"v", heads[i % 3]) for i in range(first, first + n)], SOURCE)


def written(spark, path, batches=3, size=30):
    """Files in order of offsets, as a log gives them."""
    for k in range(batches):
        records(spark, size, k * size).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


class Crash:
    """Dies once at a point, the n-th time it is passed."""

    def __init__(self, point, nth=1):
        self.point, self.left = point, nth

    def __call__(self, point):
        if point == self.point:
            self.left -= 1
            if self.left == 0:
                raise RuntimeError(f"killed at {point}")


@pytest.mark.parametrize("point", ingest.CRASH_POINTS)
def test_ingest_loses_and_repeats_nothing(spark, tmp_path, point):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    written(spark, src)
    ledger, crash = Ledger(spark, str(tmp_path / "out")), Crash(point, 2)

    def start():
        return ingest.start(files.stream(spark, src), mark, RelayOptions(), ledger, lambda: NOW, crash)

    assert supervisor.supervised(start, sleep=lambda _: None) == 1
    any_schema = {name: spark.read.parquet(f"{tmp_path}/out/{name}").drop("batch_id").schema for name in ("destination", "dlq")}
    assert {name: ledger.read(name, schema).count() for name, schema in any_schema.items()} == {"destination": 30, "dlq": 30}
    log = ledger.read("schedule_log", SCHEDULE_LOG)
    assert log.select("source_partition", "log_offset").distinct().count() == 30
    assert schedule_log.folded(log).count() == 30
    assert {tuple(r) for r in ingest.positions(ledger).collect()} == {(0, 45), (1, 45)}


def test_a_batch_that_goes_back_is_refused(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "out"))
    assert ingest.ingest_batch(records(spark, 10, 20), 0, NOW, RelayOptions(), ledger)
    with pytest.raises(ingest.WentBack):
        ingest.ingest_batch(records(spark, 10), 1, NOW, RelayOptions(), ledger)
    assert ledger.committed() == [0] and not ingest.ingest_batch(records(spark, 10, 20), 0, NOW, RelayOptions(), ledger)
    assert ingest.ingest_batch(records(spark, 10, 30), 1, NOW, RelayOptions(), ledger)


def test_fail_policy_stops_before_any_write(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    records(spark, 9).coalesce(1).write.parquet(src)
    with pytest.raises(Exception, match="FailPolicy"):
        supervisor.supervised(lambda: ingest.start(files.stream(spark, src), str(tmp_path / "m"), RelayOptions(on_malformed="FAIL"), Ledger(spark, out), lambda: NOW))
    assert not (tmp_path / "out").exists()


class World:
    """Ingested records, a clock that sleeping moves, and a dispatcher."""

    def __init__(self, spark, path, crash=lambda _: None, source=None, limits=None, options=None, n=30):
        self.spark, self.path, self.now = spark, path, NOW
        self.options = options or RelayOptions()
        self.ingest = Ledger(spark, f"{path}/ingest")
        self.rows = records(spark, n).cache()
        if not self.ingest.committed():
            ingest.ingest_batch(self.rows, 0, NOW, self.options, self.ingest)
        self.source = source or (lambda: self.rows)
        self.limits, self.crash = limits or dispatcher.Limits(), crash
        self.loop = self.anew()

    def anew(self):
        return dispatcher.Dispatcher(self.spark, self.ingest, Ledger(self.spark, f"{self.path}/dispatch"), lambda: self.source(), "t", self.options, lambda: self.now, self.limits, self.crash)

    def delivered(self):
        ledger = self.loop.ledger
        if not ledger.committed():
            return []
        schema = self.spark.read.parquet(f"{ledger.root}/destination").drop("batch_id").schema
        return sorted(tuple(r) for r in ledger.read("destination", schema).select("source_partition", "source_offset").collect())

    def sleep(self, seconds):
        self.now += int(seconds * 1000)


DELAYED = sorted((i % 2, i // 2) for i in range(30) if i % 3 == 1)


def test_an_idle_log_fires_on_time(spark, tmp_path):
    w = World(spark, tmp_path)
    assert w.loop.run_once() == {"settled": 0, "carried": 0, "wait_ms": 5000}
    w.now += 4_999
    assert w.loop.run_once()["settled"] == 0 and w.delivered() == []
    w.now = NOW
    passes = []
    w.loop.run(lambda: len(w.delivered()) == 10, lambda s: (passes.append(w.now), w.sleep(s)))
    assert w.delivered() == DELAYED and w.now - NOW >= 5000
    assert w.loop.run_once()["settled"] == 0 and schedule_log.folded(w.loop.log()).count() == 0
    cursors = {r.source_partition: r.cursor_offset for r in w.loop.cursors().collect()}
    ends = {r.source_partition: r.high_watermark for r in schedule_log.high_watermarks(w.loop.log()).collect()}
    assert cursors == ends


@pytest.mark.parametrize("point", dispatcher.CRASH_POINTS)
def test_a_crash_delivers_once(spark, tmp_path, point):
    w = World(spark, tmp_path, crash=Crash(point), limits=dispatcher.Limits(most=4, snapshot_every=2))
    w.now += 6_000
    with pytest.raises(RuntimeError, match="killed"):
        for _ in range(9):
            w.loop.run_once()
    w.loop = w.anew()
    for _ in range(4):
        w.loop.run_once()
    assert w.delivered() == DELAYED and w.loop.counters.paused == set()


def test_failures_are_tried_again_and_degrade(spark, tmp_path):
    w = World(spark, tmp_path)
    w.now += 6_000
    broken, real, naps = [7], w.source, []

    def source():
        if broken[0]:
            broken[0] -= 1
            raise OSError("not there")
        return real()

    w.source = source
    seen = []
    w.loop.run(lambda: seen.append(w.loop.degraded) or len(w.delivered()) == 10, naps.append)
    assert naps[:7] == [0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4] and True in seen and not w.loop.degraded and w.loop.counters.failures == 7


def test_missing_payloads_by_policy(spark, tmp_path):
    def lost(rows):
        return rows.filter("offset >= 8 AND offset <> 9")

    w = World(spark, tmp_path / "a")
    w.source = lambda: lost(w.rows)
    w.now += 6_000
    first = w.loop.run_once()
    # Below the log's start is gone; a hole above it may come back, so it waits.
    gone = [(p, o) for p, o in DELAYED if o < 8]
    hole = [(p, o) for p, o in DELAYED if o == 9]
    assert w.delivered() == [x for x in DELAYED if x not in gone + hole] and first["carried"] == len(hole)
    if hole:
        assert w.loop._not_before and w.loop.run_once()["settled"] == 0
        w.source = lambda: w.rows
        w.now += 60
        assert w.loop.run_once()["settled"] == len(hole) and not w.loop._not_before
    assert w.loop.counters.dead_letters == len(gone)
    w = World(spark, tmp_path / "b", options=RelayOptions(on_unfetchable="FAIL"))
    w.source, w.now = (lambda: lost(w.rows)), NOW + 6_000
    with pytest.raises(ingest.FailPolicy):
        w.loop.run(lambda: False, lambda _: None)
    assert w.delivered() == []


def test_budget_carries_over(spark, tmp_path):
    w = World(spark, tmp_path, limits=dispatcher.Limits(budget=6))
    w.now += 6_000
    out = w.loop.run_once()
    assert 0 < out["settled"] < 10 and out["carried"] == 10 - out["settled"] and out["wait_ms"] == 0
    w.loop.run(lambda: len(w.delivered()) == 10, w.sleep)
    assert w.delivered() == DELAYED


def test_recovery_refuses_what_can_t_be(spark, tmp_path):
    w = World(spark, tmp_path, limits=dispatcher.Limits(state_bytes=64))
    with pytest.raises(dispatcher.TooManyPending):
        w.loop.recover()
    w.limits = dispatcher.Limits()
    w.loop = w.anew()
    w.now += 6_000
    assert set(w.loop.recover()) == {0, 1} and w.loop.run_once()["settled"] == 10
    cut = w.anew()
    cut.ingest = Ledger(spark, f"{tmp_path}/nothing")
    cut.ledger.read = lambda name, schema, after=-1, upto=None: Ledger.read(cut.ledger, name, schema, after, upto).filter(F.lit(name != "schedule_log"))
    with pytest.raises(dispatcher.Truncated):
        cut.recover()


def test_idle_cursor_moves_alone(spark, tmp_path):
    w = World(spark, tmp_path, limits=dispatcher.Limits(idle_ms=1_000))
    w.now += 6_000
    w.loop.run_once()
    ingest.ingest_batch(records(w.spark, 12, 30, delay=900_000), 1, w.now, w.options, w.ingest)
    assert len(w.loop.ledger.committed()) == 1 and w.loop.run_once()["settled"] == 0 and len(w.loop.ledger.committed()) == 1
    w.now += 1_500
    w.loop.run_once()
    assert len(w.loop.ledger.committed()) == 2
    w.now += 1_500
    w.loop.run_once()
    assert len(w.loop.ledger.committed()) == 2


def test_net_changes():
    rows = pd.DataFrame([(1, "ADD", 5, 10.0, False), (2, "ADD", 9, 20.0, True), (3, "ADD", 7, 30.0, False), (4, "ADD", 5, 40.0, True), (5, "COMPLETE", 9, None, None)], columns=["log_offset", "op", "source_offset", "dispatch_at_ms", "clamped"])
    out, seen = dispatch.net_changes(rows.sample(frac=1, random_state=3), 4)
    by = out.set_index("source_offset")
    assert seen == 9 and by.loc[5, "inserts"] == 1 and by.loc[5, "due"] == 40 and bool(by.loc[5, "clamped"]) and pd.isna(by.loc[7, "inserts"]) and by.loc[9, "done"] == 5


def test_state_fires_in_an_idle_log_and_again_until_done(spark, tmp_path):
    src = f"{tmp_path}/log"
    now = int(time.time() * 1000)
    rows = [(0, 1, "ADD", 1, now - 1000, False, None), (0, 2, "ADD", 2, now + 900_000, False, None), (1, 1, "ADD", 7, now + 4_000, True, None), (1, 2, "ADD", 8, now - 1500, False, None), (1, 3, "COMPLETE", 8, None, None, "DROPPED")]
    spark.createDataFrame(rows, SCHEDULE_LOG).coalesce(1).write.parquet(src)
    query = dispatch.due_entries(files.stream(spark, src, SCHEDULE_LOG), retry_ms=6_000).writeStream.format("memory").queryName("due_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("due_rows").filter("source_offset = 1").count() < 2:
            time.sleep(0.5)
        got = {(r.source_partition, r.source_offset, r.clamped) for r in spark.table("due_rows").collect()}
        assert {(0, 1, False), (1, 7, True)} == got
        spark.createDataFrame([(0, 3, "COMPLETE", 1, None, None, "DISPATCHED"), (1, 4, "COMPLETE", 7, None, None, "DISPATCHED")], SCHEDULE_LOG).coalesce(1).write.mode("append").parquet(src)
        time.sleep(4)
        n = spark.table("due_rows").count()
        time.sleep(8)
        assert spark.table("due_rows").count() <= n + 1
    finally:
        query.stop()


def test_supervisor_gives_up():
    class Broken:
        def awaitTermination(self, _):  # noqa: N802
            raise RuntimeError("no")

    naps = []
    with pytest.raises(RuntimeError):
        supervisor.supervised(Broken, attempts=4, sleep=naps.append)
    assert naps == [0.1, 0.2, 0.4]
    assert supervisor.health(None, 100, None)["ready"] is False
