"""The header grammar: vectors and boundaries."""

import pytest
from pyspark.sql import functions as F

from tidegate.functions.headers import with_parse
from tidegate.model import SOURCE, HeaderNames, RelayOptions
from tidegate.operators import policy, relay

NOW, DAY = 1_700_000_000_000, 86_400_000
TS = NOW - 5_000
DELAY, AT = HeaderNames().control


def parse(spark, cases, **options):
    """(headers, ts, type) cases to rows, in order."""
    rows = [("t", 0, i, ts, kind, b"k", b"v", [(k, v if v is None or isinstance(v, bytes) else v.encode()) for k, v in headers]) for i, (headers, ts, kind) in enumerate(cases)]
    out = with_parse(spark.createDataFrame(rows, SOURCE), F.lit(NOW), RelayOptions(delay_max_ms=DAY, **options))
    return sorted(out.collect(), key=lambda r: r.offset)


def plain(spark, *headers, **options):
    return parse(spark, [(h, TS, 0) for h in headers], **options)


MALFORMED = ["", "abc", "-1", "+1", " 1", "1 ", "1\n", "1.5", "0x10", "60_000", "1" * 20, "9999999999999999999", "9223372036854775808", "٣٤", None]


def test_malformed_values(spark):
    rows = plain(spark, *[[(name, v)] for name in (DELAY, AT) for v in MALFORMED])
    assert {r.outcome for r in rows} == {"MALFORMED"}
    assert all(r.detail and r.dispatch_at_ms is None for r in rows)


def test_delay_boundaries(spark):
    rows = parse(
        spark,
        [([(DELAY, str(d))], ts, kind) for d, ts, kind in [(0, TS, 0), (5_000, TS, 0), (5_001, TS, 0), (DAY, TS, 0), (DAY + 1, TS, 0), (DAY, NOW + 1, 0), (7, -1, 0), (7, TS, -1), (2**63 - 1, TS, 0)]],
    )
    assert [r.outcome for r in rows] == ["RELAY_IMMEDIATELY", "RELAY_IMMEDIATELY", "SCHEDULE", "SCHEDULE", "OVER_MAX", "OVER_MAX", "SCHEDULE", "SCHEDULE", "OVER_MAX"]
    assert [rows[i].dispatch_at_ms for i in (2, 3, 6, 7)] == [NOW + 1, TS + DAY, NOW + 7, NOW + 7]


def test_deliver_at_boundaries(spark):
    rows = plain(spark, *[[(AT, str(v))] for v in (NOW, NOW - 1, 0, NOW + 1, NOW + DAY, NOW + DAY + 1)])
    assert [r.outcome for r in rows] == ["RELAY_IMMEDIATELY"] * 3 + ["SCHEDULE", "SCHEDULE", "OVER_MAX"]


def test_precedence_and_conflicts(spark):
    rows = plain(spark, [], [(DELAY, "9999"), (AT, "bad")], [(AT, str(NOW + 5)), (DELAY, "bad")], [(DELAY, "bad"), (DELAY, "9999")], [("other", "x"), (DELAY, "9999")])
    assert [(r.outcome, r.conflicted) for r in rows] == [("NO_DELAY", False), ("MALFORMED", True), ("SCHEDULE", True), ("SCHEDULE", True), ("SCHEDULE", False)]


def test_binary_values(spark):
    be = lambda x: x.to_bytes(8, "big", signed=True)
    rows = plain(spark, [(DELAY, be(6_000))], [(DELAY, be(-1))], [(AT, be(-5))], [(DELAY, b"12345")], [(AT, be(NOW + 9))], binary_values=True)
    assert [r.outcome for r in rows] == ["SCHEDULE", "MALFORMED", "RELAY_IMMEDIATELY", "MALFORMED", "SCHEDULE"]


def test_clamp_saturates_and_survives_without_provenance(spark):
    options = RelayOptions(delay_max_ms=DAY, on_over_max="CLAMP", provenance=False)
    df = spark.createDataFrame([("t", 0, 0, TS, 0, None, b"v", [("a", b"1"), (DELAY, str(2**63 - 1).encode())])], SOURCE)
    row = policy.classified(df, F.lit(NOW), options)
    assert row.first().dispatch_at_ms == NOW + DAY
    out = relay.relayed(row, F.lit(NOW), options, scheduled=True).first()
    assert [(h.key, bytes(h.value)) for h in out.headers] == [("a", b"1"), ("relay-clamped", b"true")]


def test_null_headers(spark):
    df = spark.createDataFrame([("t", 0, 0, TS, 0, None, None, None)], SOURCE)
    row = policy.classified(df, F.lit(NOW), RelayOptions())
    assert row.first().action == "RELAY_NOW"
    assert relay.relayed(row, F.lit(NOW), RelayOptions()).first().headers[0].key == "relay-relayed-at"


def test_unknown_policy_is_refused():
    with pytest.raises(ValueError):
        RelayOptions(on_over_max="SOMETIMES")
