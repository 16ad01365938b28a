"""Startup findings, the wait for metadata, observers, and column expressions that no query has."""

import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidegate import config, observability, startup
from tidegate.functions import scalars
from tidegate.model import COMPLETION_REASONS
from tidegate.operators import schedule_log
from tidegate.startup import Topic
from tidegate.store import identity_blob

DAY = 86_400_000


def found(**kwargs):
    base = {"source": Topic("src", 4, retention_ms=3 * DAY), "log": Topic("log", 4, cleanup="compact"), "dlq": Topic("dlq", 1), "delay_max_ms": DAY}
    report = startup.findings(**(base | kwargs), report=config.Report())
    return {(f.severity, f.path) for f in report.findings}


def test_startup_findings():
    assert found() == set()
    assert found(source=None) == {("ERROR", "route.source")}
    assert found(source=Topic("src", 4, retention_ms=DAY)) == {("ERROR", "route.source")}
    assert found(source=Topic("src", 4, retention_ms=DAY + 4_000_000)) == {("WARNING", "route.source")}
    assert found(source=Topic("src", 4, cleanup="compact,delete")) == {("ERROR", "route.source")}
    assert found(source=Topic("src", 4, retention_bytes=1 << 30)) == {("WARNING", "route.source")}
    assert found(log=None) == found(log=Topic("log", 3, cleanup="compact")) == found(log=Topic("log", 4)) == {("ERROR", "route.schedule-log")}
    assert found(log=Topic("log", 4, cleanup="compact", tombstone_ms=60_000)) == {("ERROR", "route.schedule-log")}
    assert found(log=Topic("log", 4, cleanup="compact", replication=1)) == {("WARNING", "route.schedule-log")}
    assert found(log=Topic("log", 4, cleanup="compact", writers=frozenset({"me", "other"})), own_writers=frozenset({"me"})) == {("WARNING", "route.schedule-log")}
    assert found(dlq=None) == {("ERROR", "route.dlq")} and found(dlq=None, needs_dlq=False) == set()
    assert found(dlq=Topic("src", 4)) == {("ERROR", "route.dlq")} and found(dlq=Topic("dlq", 1, largest_record=10)) == {("WARNING", "route.dlq")}
    live = identity_blob("c", "t")
    assert found(recorded=live, live=live) == set() and found(recorded=identity_blob("c", "u"), live=live) == {("ERROR", "route.source")}


def test_metadata_wait():
    now, naps, report = [0.0], [], config.Report()

    def sleep(s):
        naps.append(s)
        now[0] += s

    ready = lambda names: {n: Topic(n, 1) for n in names if n == "a" or now[0] > 2}
    assert set(startup.described(["a", "b"], ready, report, clock=lambda: now[0], sleep=sleep)) == {"a", "b"}
    assert naps[:6] == [0.05, 0.1, 0.2, 0.4, 0.8, 1.0] and [f.severity for f in report.findings] == ["WARNING"]
    now[0], report = 0.0, config.Report()
    assert startup.described(["a", "c"], lambda names: {"a": Topic("a", 1)}, report, limit=3, clock=lambda: now[0], sleep=sleep).keys() == {"a"}
    assert [(f.severity, f.path) for f in report.findings] == [("ERROR", "c")] and now[0] == pytest.approx(3)


def test_observers():
    state = {"live": True, "ready": False, "degraded": True, "reasons": {"log": "bad\x07 " + "x" * 99}, "counters": {"passes": 3, "pending": {1: 5, 0: 2}, "paused": {1}, "last_pass_ms": None}}
    ends = observability.Endpoints(lambda: state, {"version": "1", "application": "app"})
    shown = observability.observer("http", ends)
    try:
        base = f"http://127.0.0.1:{shown.port}"
        assert urllib.request.urlopen(f"{base}/metrics").read().decode() == 'tidegate_passes 3\ntidegate_pending{partition="0"} 2\ntidegate_pending{partition="1"} 5\n'
        live = json.loads(urllib.request.urlopen(f"{base}/health/live").read())
        assert live["status"] == "UP" and live["degraded"] and live["reasons"]["log"].startswith("bad? x") and len(live["reasons"]["log"]) == 64
        assert json.loads(urllib.request.urlopen(f"{base}/info").read()) == {"version": "1"}
        with pytest.raises(urllib.error.HTTPError, match="503"):
            urllib.request.urlopen(f"{base}/health/ready")
        with pytest.raises(urllib.error.HTTPError, match="404"):
            urllib.request.urlopen(f"{base}/other")
    finally:
        shown.close()
    assert observability.Endpoints(lambda: state, {"application": "app"}, detailed=True).answer("/info")[2] == '{"application":"app"}'
    observability.observer("none", ends).close()
    with pytest.raises(ValueError):
        observability.observer("other", ends)


def test_expressions_that_no_query_has(spark):
    top, low = 2**63 - 1, -(2**63)
    cases = [(3, 4, 12), (top, 2, top), (low, 2, low), (low, -1, top), (-5, 7, -35), (0, low, 0), (2**32, 2**32, top), (-(2**32), 2**32, low)]
    rows = spark.createDataFrame(cases, "a bigint, b bigint, c bigint").select(scalars.saturating_multiply(F.col("a"), F.col("b")).alias("x"), "c").collect()
    assert [r.x for r in rows] == [r.c for r in rows]
    reasons = spark.createDataFrame([(r,) for r in (*COMPLETION_REASONS, "OTHER")], "r string").select(schedule_log.known_reason(F.col("r")).alias("k")).collect()
    assert [r.k for r in reasons] == [True] * len(COMPLETION_REASONS) + [False]
    assert scalars.printable("a\x00b\x9fc" + "d" * 99) == "a?b?c" + "d" * 59 and config.ENTRY_BYTES == 64


def test_other_log_entries_change_nothing(spark):
    schema = "source_partition int, log_offset bigint, op string, source_offset bigint, dispatch_at_ms bigint, clamped boolean, reason string"
    rows = [(0, 1, "ADD", 5, 100, False, None), (0, 2, "CANCEL", 5, None, None, None), (0, 3, "INVALID", None, None, None, None), (0, 4, "ADD", 9, 70, False, None), (0, 5, "INVALID", 99, None, None, None), (0, 6, "ADD", 10, 70, False, None)]
    log = spark.createDataFrame(rows, schema)
    for span in (1 << 20, 2):
        assert sorted(r.source_offset for r in schedule_log.folded(log, span).collect()) == [5, 9, 10]
        assert sorted(r.source_offset for r in schedule_log.compacted(log, span).collect() if r.op == "ADD") == [5, 9, 10]
