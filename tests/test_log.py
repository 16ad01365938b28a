"""The fold against a small model, on random logs; compaction, recovery and cursors."""

import random

import pytest
from pyspark.sql import functions as F

from tidegate.model import SCHEDULE_LOG
from tidegate.operators import cursor, due, fetch, schedule_log


def random_log(seed, partitions=6, n=150):
    rng, rows = random.Random(seed), []
    for p in range(partitions):
        at, top = 0, 0
        for _ in range(n):
            at += rng.randint(1, 3)
            op = rng.choices(["new", "again", "low", "done"], [50, 12, 8, 30])[0]
            if op == "new":
                top += rng.randint(1, 50)
            offset = top if op == "new" else rng.randint(0, top) if op == "low" else rng.choice([r[3] for r in rows if r[0] == p] or [1])
            rows.append((p, at, "COMPLETE", offset, None, None, "DISPATCHED") if op == "done" else (p, at, "ADD", offset, rng.randint(0, 10**6), rng.random() < 0.2, None))
    return rows


def model(rows):
    pending, seen = {}, {}
    for p, at, op, offset, due_ms, clamped, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if op == "ADD":
            if offset > seen.get(p, -1):
                seen[p] = offset
                pending[p, offset] = (at, due_ms, clamped)
            elif (p, offset) in pending:
                pending[p, offset] = (pending[p, offset][0], due_ms, clamped)
        else:
            pending.pop((p, offset), None)
    return {(p, o, *v) for (p, o), v in pending.items()}


def rows_of(df):
    return {(r.source_partition, r.source_offset, r.log_offset, r.dispatch_at_ms, r.clamped) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_compaction_and_recovery(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEDULE_LOG).cache()
    expected = model(rows)
    for span in (schedule_log.RANGE, 7):
        assert rows_of(schedule_log.folded(log, span)) == expected
        assert rows_of(schedule_log.folded(schedule_log.compacted(log, span), span)) == expected
    at = 120
    before = log.filter(F.col("log_offset") < at)
    cursors = before.filter("op = 'ADD'").groupBy("source_partition").agg(F.lit(at).cast("bigint").alias("cursor_offset"), F.max("source_offset").alias("max_seen"))
    barriers = schedule_log.high_watermarks(log).withColumnRenamed("high_watermark", "barrier")
    assert rows_of(cursor.recovered(schedule_log.folded(before), log, cursors, barriers)) == expected


def test_cursor_covers_every_entry(spark):
    pending = schedule_log.folded(spark.createDataFrame(random_log(9), SCHEDULE_LOG)).cache()
    positions = pending.groupBy("source_partition").agg((F.max("log_offset") + 1).alias("position"), F.lit(0).cast("bigint").alias("last_safe"))
    cut = {r.source_partition: r for r in cursor.committed_cursor(pending, positions, 128).collect()}
    for r in cursor.sidecar_prefix(pending, 128).collect():
        assert r.fits or r.log_offset >= cut[r.source_partition].cursor_offset
    held = cursor.committed_cursor(pending, positions.withColumn("last_safe", F.lit(10**9)), 128)
    assert {(r.cursor_offset, r.degraded) for r in held.collect()} == {(10**9, True)}


def test_sidecar_round_trip_and_strictness():
    rng = random.Random(1)
    pins, at = [], 0
    for _ in range(300):
        at += rng.randint(1, 400)
        pins.append(cursor.Pin(at, rng.randint(0, 2**40), rng.randint(0, 2**41), rng.random() < 0.5))
    text, n = cursor.encode_sidecar("cluster", b"s" * 16, b"l" * 16, pins, 3072)
    assert 0 < n < 300 and len(text) <= 3072
    assert cursor.decode_sidecar(text) == ("cluster", b"s" * 16, b"l" * 16, pins[:n])
    text, n = cursor.encode_sidecar("", b"s" * 16, b"l" * 16, pins, 1 << 20)
    assert n == 300 and cursor.decode_sidecar(text)[3] == pins
    for bad in ("", "!!", text[:-3], "AQ"):
        with pytest.raises(ValueError):
            cursor.decode_sidecar(bad)


def test_wire_bytes(spark):
    log = spark.createDataFrame([(0, 1, "ADD", 258, 1_700_000_000_000, True, None), (0, 2, "COMPLETE", 258, None, None, "REJECTED")], SCHEDULE_LOG)
    rows = schedule_log.encoded(log, "reason").orderBy("log_offset").collect()
    assert bytes(rows[0].key) == bytes.fromhex("0000000000000102")
    assert bytes(rows[0].value) == bytes.fromhex("C5010101") + (1_700_000_000_000).to_bytes(8, "big")
    assert rows[1].value is None and [(h.key, bytes(h.value)) for h in rows[1].headers] == [("reason", b"REJECTED")]


def test_budget_takes_the_crossing_record(spark):
    rows = [(0, 1, 1, "FOUND", 60), (0, 2, 1, "GONE", 0), (0, 3, 1, "FOUND", 60), (1, 1, 2, "GONE", 0), (1, 2, 2, "FOUND", 5)]
    df = spark.createDataFrame(rows, "source_partition int, source_offset bigint, run_no int, fetch_outcome string, bytes bigint")
    out = {(r.source_partition, r.source_offset): r.fetch_outcome for r in fetch.within_budget(df, 100).collect()}
    assert out == {(0, 1): "FOUND", (0, 2): "GONE", (0, 3): "FOUND", (1, 1): "CARRY_OVER", (1, 2): "CARRY_OVER"}


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEDULE_LOG)
    assert schedule_log.folded(log).count() == 0
    assert due.next_deadline(schedule_log.folded(log)).first()[0] is None


def test_budget_cuts_and_pointers_beyond_a_broadcast(spark, monkeypatch):
    batch = fetch.runs(fetch.positioned(spark.createDataFrame([(p, o, o) for p in range(3) for o in range(6)], "source_partition int, source_offset bigint, dispatch_at_ms bigint"), "dispatch_at_ms", "source_partition"))
    source = spark.createDataFrame([(p, o, bytes(o), bytes(10)) for p in range(2) for o in range(2, 6)], "partition int, offset bigint, key binary, value binary")
    rows = []
    for limit in (100_000, 5):
        monkeypatch.setattr(fetch, "BROADCAST_POINTERS", limit)
        out = fetch.within_budget(fetch.with_outcome(fetch.refetched(batch, source, 18), fetch.log_starts(source)), 40)
        rows.append(sorted((r.source_partition, r.source_offset, r.fetch_outcome) for r in out.collect()))
    assert rows[0] == rows[1]
    assert [r[2] for r in rows[0]] == ["GONE", "GONE", "FOUND", "FOUND", "FOUND", "FOUND"] + ["CARRY_OVER"] * 12


def test_a_scan_that_went_past_proves_loss(spark):
    batch = spark.createDataFrame([(0, 5, False), (0, 9, False), (1, 5, False)], "source_partition int, source_offset bigint, found boolean").withColumns({"key": F.lit(None).cast("binary"), "value": F.lit(None).cast("binary"), "scanned": F.when(F.col("source_partition") == 0, 8)})
    starts = spark.createDataFrame([(0, 1), (1, 1)], "source_partition int, log_start bigint")
    out = fetch.with_outcome(batch, starts, F.col("scanned"))
    assert sorted((r.source_partition, r.source_offset, r.fetch_outcome) for r in out.collect()) == [(0, 5, "GONE"), (0, 9, "TRANSIENT"), (1, 5, "TRANSIENT")]
