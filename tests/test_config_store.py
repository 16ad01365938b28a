"""Configuration findings and the stores."""

import pytest
from pyspark.sql import functions as F

from tidegate import config, store
from tidegate.model import SCHEDULE_LOG


def test_layers_and_findings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("route:\n  source: a  # the topic\n  destination: ${env:DEST}\n  dlq: 'd'\ndelay:\n  max: PT1H\n  onOverMax: CLAMP\nsource:\n  options:\n    failOnDataLoss: false\n")
    got, report = config.load(path, {"DEST": "b", "TIDEGATE_DELAY__MAX": "PT2H", "TIDEGATE_INGEST__MAX_BATCH": "7"}, {"dispatch.max-batch": 5})
    assert (got["route.destination"], got["delay.max"], got["ingest.max-batch"], got["dispatch.max-batch"]) == ("b", "PT2H", 7, 5)
    assert {f.path for f in report.findings if f.severity == "ERROR"} == {"delay.onOverMax", "source.options.failOnDataLoss"}
    assert any("delay.on-over-max" in f.message for f in report.findings)
    assert config.relay_options(got).delay_max_ms == 7_200_000


def test_validation():
    _, report = config.load({"route": {"source": "a", "destination": "b"}, "delay": {"on-malformed": "FAIL"}, "dispatch": {"time-slice": "PT5M", "penalty": {"max": "PT0.01S"}, "cursor": {"sidecar-max-bytes": 1}}})
    assert {f.path for f in report.findings if f.severity == "ERROR"} == {"route.dlq", "dispatch.time-slice", "dispatch.penalty.max", "dispatch.cursor.sidecar-max-bytes"}
    assert not report.ok and any(f.severity == "WARNING" for f in report.findings)


@pytest.mark.parametrize(("text", "ms"), [("P1D", 86_400_000), ("PT0.05S", 50), ("-PT1M", -60_000), ("P9999999999999D", 2**63 - 1)])
def test_durations(text, ms):
    assert config.duration_ms(text) == ms


@pytest.mark.parametrize("text", ["", "P", "PT", "1D", "P1Y"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        config.duration_ms(text)


def test_retention_and_identity():
    report = config.Report()
    config.retention_findings(86_400_000, 86_400_000, report, tombstone_ms=1)
    assert [f.severity for f in report.findings] == ["ERROR", "ERROR"]
    blob = store.identity_blob("c", "t")
    assert store.same_identity(None, blob) and store.same_identity(blob, blob)
    assert not store.same_identity(store.identity_blob("c", "other"), blob) and not store.same_identity("{", blob)
    assert config.config_argument(["--config=x"], {}) == "x" and config.config_argument([], {"TIDEGATE_CONFIG": "y"}) == "y"


def test_log_store(spark):
    rows = [(0, 1, "ADD", 5, 100, False, None), (0, 2, "ADD", 6, 50, True, None), (1, 1, "ADD", 1, 10, False, None)]

    def log():
        return spark.createDataFrame(rows, SCHEDULE_LOG)

    def append(done):
        rows.extend((r.source_partition, 10 + len(rows), r.op, r.source_offset, None, None, r.reason) for r in done.collect())

    s = store.create("log", spark, log, append)
    s.assign({0})
    s.assign({1}, recovering=True)
    assert [(r.source_partition, r.source_offset) for r in s.poll_due(60, 10).collect()] == [(0, 6)]
    assert s.pending_count(1) == 1 and s.next_deadline_ms() == 50
    s.recovered({1})
    s.penalize(0, 1_000)
    assert [(r.source_partition, r.source_offset) for r in s.poll_due(200, 10).collect()] == [(1, 1)]
    s.commit(s.poll_due(200, 10).selectExpr("*", "'DISPATCHED' AS reason"))
    assert s.poll_due(200, 10).count() == 0 and s.next_deadline_ms() == 1_000
    s.revoke({0})
    assert s.pending_count(0) == 0


def test_table_store(spark):
    rows = []
    schema = "source_partition int, source_offset bigint, dispatch_at_ms bigint, clamped boolean, dispatched boolean, version bigint"
    s = store.create("table", spark, lambda: spark.createDataFrame(rows, schema), lambda df: rows.extend(tuple(r) for r in df.collect()))
    refs = lambda *x: spark.createDataFrame(list(x), "source_partition int, source_offset bigint, dispatch_at_ms bigint, clamped boolean")
    s.upsert(refs((0, 1, 10, False), (0, 2, 20, False)), 1)
    s.upsert(refs((0, 2, 25, True)), 2)
    s.mark_dispatched(refs((0, 1, 10, False)), 3)
    s.upsert(refs((0, 1, 99, False)), 4)
    assert [tuple(r) for r in s.scan_pending(0).collect()] == [(0, 2, 25, True)]
    assert s.cursor(0) == (25, 2) and s.cursor(1) is None
    with pytest.raises(ValueError):
        store.create("other")


def test_views_ids_and_memory():
    view = config.ConfigView({"store.max-pending": "1_000", "store.wait": "PT5S", "store.fast": "true", "other.x": 1, "store.none": None}, "store.")
    assert view.keys() == {"max-pending", "wait", "fast"}
    assert (view.integer("max-pending"), view.duration_ms("wait"), view.flag("fast"), view.text("name", "n"), view.integer("x", 7)) == (1000, 5000, True, "n", 7)
    for read in (lambda: view.text("name"), lambda: view.integer("wait"), lambda: view.flag("wait"), lambda: view.duration_ms("fast")):
        with pytest.raises(ValueError, match="store."):
            read()
    assert config.writer_id("app", "ingest", "blue-1", 0) == "tidegate.app.ingest.blue-1.0"
    assert config.member_id("app", "dispatch", "blue-1") == "tidegate.app.dispatch.blue-1" and config.member_id("app", "dispatch", "random") is None
    for bad in (("a b", "ingest"), ("app", "other")):
        with pytest.raises(ValueError):
            config.group_id(*bad)
    base = {"route": {"source": "a", "destination": "b", "dlq": "c"}, "dispatch": {"pending": {"max-per-partition": 1000}}}
    findings = lambda memory: [f.severity for f in config.load(base, memory_bytes=memory, partitions=2)[1].findings if f.path == "dispatch.pending.max-per-partition"]
    assert [findings(m) for m in (0, 2000 * config.ENTRY_BYTES - 1, 2000 * config.ENTRY_BYTES, 1 << 30)] == [[], ["ERROR"], ["WARNING"], ["INFO"]]
    _, report = config.load({**base, "route": {**base["route"], "dead-letter": "x"}, "observability": {"port": 70_000, "bind-address": "0.0.0.0"}})
    found = {(f.severity, f.path) for f in report.findings}
    assert {("ERROR", "route.dead-letter"), ("ERROR", "observability.port"), ("WARNING", "observability.bind-address")} <= found
    assert any("route.dlq here" in f.message for f in report.findings)


def test_store_life(spark):
    rows = [(0, 1, "ADD", 5, 100, False, None), (0, 2, "COMPLETE", 5, None, None, "DROPPED"), (0, 3, "ADD", 6, 50, True, None), (1, 1, "ADD", 1, 10, False, None)]
    held = {"log": spark.createDataFrame(rows, SCHEDULE_LOG)}
    s = store.create("log", spark, lambda: held["log"], lambda _: None, lambda log: held.update(log=spark.createDataFrame(log.collect(), SCHEDULE_LOG)))
    assert (s.capabilities.kind, s.capabilities.exactly_once, s.capabilities.replays) == ("log", True, True)
    report = config.Report()
    s.configure(config.ConfigView({"store.max-pending": -1}, "store."))
    s.validate(report)
    assert not report.ok
    s.start()
    with pytest.raises(RuntimeError):
        s.start()
    pins = spark.createDataFrame([], "source_partition int, log_offset bigint, source_offset bigint, dispatch_at_ms bigint, clamped boolean")
    cursors = "source_partition int, cursor_offset bigint, max_seen bigint"
    got = s.recover(pins, spark.createDataFrame([(0, 1, None), (1, 1, None)], cursors))
    assert {(r.source_partition, r.source_offset) for r in got.collect()} == {(0, 6), (1, 1)}
    with pytest.raises(ValueError, match="beyond"):
        s.recover(pins, spark.createDataFrame([(0, 99, None)], cursors))
    batch = s.poll_due(60, 10)
    assert batch.count() == 2
    s.abort(batch, 60)
    s.abort(batch.filter(F.col("source_partition") == 0), 60)
    assert s._not_before == {0: 160, 1: 110} and s.poll_due(60, 10).count() == 0
    s.committed({0})
    assert [r.source_partition for r in s.poll_due(60, 10).collect()] == [0]
    s.maintenance()
    assert sorted((r.source_partition, r.source_offset) for r in held["log"].collect()) == [(0, 6), (1, 1)]
    s.close()
    assert s.pending_count(0) == 0
    t = store.create("table", spark, lambda: spark.createDataFrame([(0, 3, 30, False, False, 1), (0, 1, 90, False, False, 1), (1, 1, 5, False, True, 2)], "source_partition int, source_offset bigint, dispatch_at_ms bigint, clamped boolean, dispatched boolean, version bigint"), lambda _: None)
    assert t.capabilities.kind == "table" and [tuple(r) for r in t.coordinates().collect()] == [(0, 30, 3)]
