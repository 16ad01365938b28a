"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL.

The SQL is written from the rules, not from the plans: where the DataFrame code works on
header arrays, bytes and folds, the SQL works on the columns that the fixture derives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import scalars as S
from ..model import HeaderNames, RelayOptions
from ..operators import cursor, due, fetch, policy, relay, schedule_log, settle
from ..sources import events
from . import drain

#: The longest delay of the queries and the clock of dispatch (half of the events are before it); sizes of a batch, as in production.
DELAY_MAX = 300_000
NOW = 1_705_363_200_000
MOST = 10_000
BUDGET = 32 << 20
SIDECAR = 3_072
HIGH, CAP = 100, 2_000
LOST_BELOW = 100

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NAMES = HeaderNames()
DLQ, CLAMP = RelayOptions(delay_max_ms=DELAY_MAX), RelayOptions(delay_max_ms=DELAY_MAX, on_over_max="CLAMP")
RELAY = RelayOptions(delay_max_ms=DELAY_MAX, on_malformed="RELAY_IMMEDIATE")


def _source(s: SparkSession, d: str) -> DataFrame:
    return events.source_records(s, d, NAMES)


def _decided(s: SparkSession, d: str, options: RelayOptions = DLQ) -> DataFrame:
    return policy.classified(_source(s, d), F.col("ts_ms"), options)


def _log(s: SparkSession, d: str) -> DataFrame:
    return events.schedule_log(_decided(s, d, CLAMP))


def _pending(s: SparkSession, d: str) -> DataFrame:
    return schedule_log.folded(_log(s, d))


def _penalties(s: SparkSession, d: str) -> DataFrame:
    return s.range(events.PARTITIONS).select(F.col("id").cast("int").alias("source_partition"), (F.lit(NOW) + (F.col("id") - 2) * 1000).alias("not_before_ms"))


def _kept_source(s: SparkSession, d: str) -> DataFrame:
    """The source after its retention: the first offsets are gone."""
    return _source(s, d).filter(F.col("offset") >= LOST_BELOW)


def _batch(s: SparkSession, d: str) -> DataFrame:
    return fetch.runs(fetch.positioned(due.top_due(_pending(s, d), F.lit(NOW), MOST), *due.ORDER))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    source = _kept_source(s, d)
    return fetch.with_outcome(fetch.refetched(_batch(s, d), source, MOST), fetch.log_starts(source))


def _settled(s: SparkSession, d: str, options: RelayOptions = DLQ, refused: DataFrame | None = None) -> DataFrame:
    return drain.dispatch(_log(s, d), _kept_source(s, d), F.lit(NOW), options, MOST, BUDGET, refused=refused)


def _refused(s: SparkSession, d: str) -> DataFrame:
    """Positions that the destination is known to refuse."""
    return _source(s, d).filter("offset % 7 = 3").select(F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    return schedule_log.high_watermarks(_log(s, d)).select("source_partition", F.col("high_watermark").alias("position"), F.lit(1).cast("bigint").alias("last_safe"))



_SRC = f"""e AS (
  SELECT event_id, user_id, event_type, props, epoch_us(ts) // 1000 AS ts_ms, CAST(floor(value * 1000) AS BIGINT) AS delay, CAST(user_id % 4 AS INTEGER) AS p FROM events),
src AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY p ORDER BY event_id) - 1 AS BIGINT) AS o,
    CASE event_type WHEN 'click' THEN CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END WHEN 'error' THEN 1 WHEN 'view' THEN 1 ELSE 0 END AS n_delay,
    CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS n_at,
    strlen(CAST(user_id AS VARCHAR)) + strlen(props) AS bytes
  FROM e),
parsed AS (
  SELECT *, (n_delay > 0 AND n_at > 0) OR n_delay > 1 OR n_at > 1 AS conflicted,
    CASE WHEN event_type = 'signup' THEN 'NO_DELAY' WHEN event_type = 'error' THEN 'MALFORMED' WHEN event_type = 'view' THEN 'RELAY_IMMEDIATELY'
      WHEN delay > {DELAY_MAX} THEN 'OVER_MAX' WHEN delay <= 0 THEN 'RELAY_IMMEDIATELY' ELSE 'SCHEDULE' END AS outcome
  FROM src)"""


def _decided_sql(malformed: str = "DLQ", over_max: str = "DLQ") -> str:
    return (
        _SRC
        + f""",
decided AS (
  SELECT *, CASE WHEN outcome = 'SCHEDULE' THEN 'SCHEDULE' WHEN outcome = 'MALFORMED' THEN '{malformed}' WHEN outcome = 'OVER_MAX' THEN '{over_max}' ELSE 'RELAY_NOW' END AS action,
    CASE WHEN outcome = 'SCHEDULE' THEN ts_ms + delay WHEN outcome = 'OVER_MAX' AND '{over_max}' = 'CLAMP' THEN ts_ms + {DELAY_MAX} END AS due,
    outcome = 'OVER_MAX' AND '{over_max}' = 'CLAMP' AS clamped,
    CASE WHEN outcome = 'MALFORMED' AND '{malformed}' = 'DLQ' THEN 'malformed-header' WHEN outcome = 'OVER_MAX' AND '{over_max}' = 'DLQ' THEN 'over-max-delay' END AS reason,
    CASE WHEN outcome = 'MALFORMED' THEN 'relay-delay-ms: not ASCII decimal: "abc"'
      WHEN outcome = 'OVER_MAX' AND event_type = 'purchase' THEN 'relay-deliver-at: ' || (ts_ms + delay) || ' is later than the latest allowed ' || (ts_ms + {DELAY_MAX})
      WHEN outcome = 'OVER_MAX' THEN 'relay-delay-ms: ' || delay || ' ms is more than the maximum {DELAY_MAX} ms' END AS detail
  FROM parsed)"""
    )


_LOG = (
    _decided_sql(over_max="CLAMP")
    + """,
base AS (SELECT p, o, due, clamped, row_number() OVER (PARTITION BY p ORDER BY o) AS n FROM decided WHERE action IN ('SCHEDULE', 'CLAMP')),
log AS (
  SELECT p, 3 * n AS lo, 'ADD' AS op, o, due, clamped, NULL AS reason FROM base WHERE o % 17 <> 2
  UNION ALL SELECT p, 3 * n + 3000000000000, 'ADD', o, due, clamped, NULL FROM base WHERE o % 17 = 2
  UNION ALL SELECT p, 3 * n + 1000000000000, 'ADD', o, due + 5000, clamped, NULL FROM base WHERE o % 11 = 0
  UNION ALL SELECT p, 3 * n + 2000000000000, 'COMPLETE', o, NULL, NULL, CASE WHEN o % 6 = 0 THEN 'DROPPED' ELSE 'DISPATCHED' END FROM base WHERE o % 3 = 0
  UNION ALL SELECT p, 3 * n - 2, 'COMPLETE', o, NULL, NULL, 'REJECTED' FROM base WHERE o % 13 = 1)"""
)
_FOLD = (
    _LOG
    + """,
adds AS (SELECT *, max(o) OVER (PARTITION BY p ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM log WHERE op = 'ADD'),
ins AS (SELECT p, o, lo FROM adds WHERE seen IS NULL OR o > seen),
live AS (SELECT i.* FROM ins i WHERE NOT EXISTS (SELECT 1 FROM log c WHERE c.op = 'COMPLETE' AND c.p = i.p AND c.o = i.o AND c.lo > i.lo)),
newest AS (SELECT *, row_number() OVER (PARTITION BY p, o ORDER BY lo DESC) AS rn FROM adds),
pending AS (SELECT l.p, l.o, l.lo, a.due, a.clamped FROM live l JOIN newest a ON a.p = l.p AND a.o = l.o AND a.rn = 1)"""
)
_BATCH = (
    _FOLD
    + f""",
polled AS (SELECT * FROM pending WHERE due <= {NOW} ORDER BY due, p, o LIMIT {MOST}),
posed AS (SELECT *, row_number() OVER (ORDER BY due, p, o) - 1 AS pos FROM polled),
batch AS (SELECT *, dense_rank() OVER (ORDER BY first_pos) AS run_no FROM (SELECT *, min(pos) OVER (PARTITION BY p) AS first_pos FROM posed))"""
)
_FETCH = (
    _BATCH
    + f""",
starts AS (SELECT p, min(o) AS log_start FROM src WHERE o >= {LOST_BELOW} GROUP BY p),
fetched AS (
  SELECT b.*, CASE WHEN s.o IS NOT NULL THEN 'FOUND' WHEN b.o < t.log_start THEN 'GONE' ELSE 'TRANSIENT' END AS outcome, CASE WHEN s.o IS NOT NULL THEN s.bytes ELSE 0 END AS n_bytes
  FROM batch b LEFT JOIN (SELECT * FROM src WHERE o >= {LOST_BELOW}) s ON s.p = b.p AND s.o = b.o LEFT JOIN starts t ON t.p = b.p)"""
)
_CUT = (
    _FETCH
    + f""",
budgeted AS (SELECT *, coalesce(sum(n_bytes) OVER (ORDER BY run_no, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {BUDGET} AS taken FROM fetched),
cut AS (SELECT p, o, lo, due, clamped, pos, run_no, CASE WHEN taken THEN outcome ELSE 'CARRY_OVER' END AS outcome, CASE WHEN taken THEN n_bytes ELSE 0 END AS n_bytes FROM budgeted),
settled AS (SELECT *, CASE outcome WHEN 'FOUND' THEN 'RELAY' WHEN 'GONE' THEN 'DLQ_EXPIRED' ELSE 'CARRY' END AS route,
  CASE outcome WHEN 'FOUND' THEN 'DISPATCHED' WHEN 'GONE' THEN 'PAYLOAD_MISSING_DLQ' END AS reason FROM cut)"""
)


def query(name: str, base: str, select: str) -> Callable[[Query], Query]:
    """Register a query with its SQL: common table expressions and the final SELECT (none: rows only)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if select:
            ORACLE_SQL[name] = (f"WITH {base}\n" if base else "") + select
        return f

    return add


# --------------------------------------------------------------------------
# Sources, headers, decisions
# --------------------------------------------------------------------------


@query("source_scan", _SRC, 'SELECT p AS "partition", o AS "offset", ts_ms, CAST(user_id AS VARCHAR) AS key, props AS value FROM src')
def source_scan(s, d):
    return _source(s, d).select("partition", "offset", "ts_ms", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("header_conflicts", _SRC, 'SELECT p AS "partition", o AS "offset", conflicted FROM parsed')
def header_conflicts(s, d):
    return _source(s, d).select("partition", "offset", H.conflicted(F.col("headers"), NAMES).alias("conflicted"))


@query("headers_stripped", _SRC, "SELECT p AS \"partition\", o AS \"offset\", CASE WHEN event_type = 'signup' THEN '' ELSE 'trace=' || event_id END AS headers FROM src")
def headers_stripped(s, d):
    return _source(s, d).select("partition", "offset", relay.headers_text(H.stripped(F.col("headers"), NAMES)).alias("headers"))


_TEXTS = """texts AS (SELECT event_id, CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '-1' WHEN 3 THEN ' 12' WHEN 4 THEN '12' || chr(10) WHEN 5 THEN '1.5' WHEN 6 THEN '9223372036854775807'
  WHEN 7 THEN '9223372036854775808' WHEN 8 THEN '00000000000000000000' WHEN 9 THEN '0' WHEN 10 THEN '٣' ELSE CAST(event_id * 7919 AS VARCHAR) END AS x FROM events)"""


@query("decode_decimal", _TEXTS, "SELECT event_id, CASE WHEN regexp_full_match(x, '[0-9]{1,19}') AND strpos(x, chr(10)) = 0 THEN TRY_CAST(x AS BIGINT) END AS decoded FROM texts")
def decode_decimal(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    k = F.col("event_id") % 12
    x = F.when(k == 0, "")
    for i, v in enumerate(["abc", "-1", " 12", "12\n", "1.5", "9223372036854775807", "9223372036854775808", "0" * 20, "0", "٣"], 1):
        x = x.when(k == i, v)
    return e.select("event_id", S.decode_decimal(x.otherwise((F.col("event_id") * 7919).cast("string"))).alias("decoded"))


@query("saturating_add", "", "SELECT event_id, CAST(least(9223372036854775807::HUGEINT, greatest(-9223372036854775808::HUGEINT, a::HUGEINT + b::HUGEINT)) AS BIGINT) AS total FROM (SELECT event_id, (event_id - 5000) * 1844674407370955 AS a, (event_id % 7 - 3) * 2305843009213693951 AS b FROM events)")
def saturating_add(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    # From event 10,001 on (and for ids below 0) an operand is beyond the long range: there the sum is that of whole numbers.
    n = F.col("event_id").cast("decimal(19,0)")
    a, b = (n - 5000) * 1844674407370955, (n % 7 - 3) * 2305843009213693951
    near_a, near_b = S.saturated(a), S.saturated(b)
    total = F.when((a == near_a) & (b == near_b), S.saturating_add(near_a, near_b)).otherwise(S.saturated(a + b))
    return e.select("event_id", total.alias("total"))


@query("classify_headers", _decided_sql(), 'SELECT p AS "partition", o AS "offset", outcome, CASE WHEN outcome = \'SCHEDULE\' THEN due END AS dispatch_at_ms, conflicted, detail FROM decided')
def classify_headers(s, d):
    return H.with_parse(_source(s, d), F.col("ts_ms"), DLQ).select("partition", "offset", "outcome", "dispatch_at_ms", "conflicted", "detail")


_DECISION = 'SELECT p AS "partition", o AS "offset", action, due AS dispatch_at_ms, clamped, reason FROM decided'


def _decision(options: RelayOptions) -> Query:
    return lambda s, d: _decided(s, d, options).select("partition", "offset", "action", "dispatch_at_ms", "clamped", "reason")


query("ingest_decision_dlq", _decided_sql(), _DECISION)(_decision(DLQ))
query("ingest_decision_relay_immediate", _decided_sql(malformed="RELAY_NOW"), _DECISION)(_decision(RELAY))
query("ingest_decision_clamp", _decided_sql(over_max="CLAMP"), _DECISION)(_decision(CLAMP))


@query("ingest_outcomes", _decided_sql(), "SELECT outcome, action, count(*) AS n FROM decided GROUP BY ALL")
def ingest_outcomes(s, d):
    return settle.ingest_outcomes(_decided(s, d))


@query("ingest_rollup", _decided_sql(), "SELECT outcome, action, count(*) AS n FROM decided GROUP BY ROLLUP (outcome, action)")
def ingest_rollup(s, d):
    return settle.ingest_rollup(_decided(s, d))


@query("header_errors", _decided_sql(), "SELECT count(*) FILTER (outcome = 'MALFORMED') AS malformed, count(*) FILTER (outcome = 'OVER_MAX') AS over_max, count(*) FILTER (conflicted) AS conflicts FROM decided")
def header_errors(s, d):
    return settle.header_errors(_decided(s, d))


@query("dlq_by_reason", _decided_sql(), "SELECT reason, count(*) AS n FROM decided WHERE action = 'DLQ' GROUP BY reason")
def dlq_by_reason(s, d):
    return settle.dlq_by_reason(_decided(s, d))


# --------------------------------------------------------------------------
# Relayed records and dead letters
# --------------------------------------------------------------------------

_TRACE = "CASE WHEN event_type = 'signup' THEN '' ELSE 'trace=' || event_id || ';' END"
_PROV = "'relay-relayed-at=' || {now} || ';relay-source-topic=events;relay-source-partition=' || p || ';relay-source-offset=' || o || ';relay-source-timestamp=' || ts_ms"


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("source_partition", "source_offset", "out_partition", "out_ts_ms", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), relay.headers_text(F.col("headers")).alias("headers"))


_OUT = "SELECT p AS source_partition, o AS source_offset, CAST(NULL AS INTEGER) AS out_partition, {now} AS out_ts_ms, CAST(user_id AS VARCHAR) AS key, props AS value, {headers} AS headers FROM decided"


@query("relay_immediate", _decided_sql(), _OUT.format(now="ts_ms", headers=_TRACE + " || " + _PROV.format(now="ts_ms")) + " WHERE action = 'RELAY_NOW'")
def relay_immediate(s, d):
    return _flat(relay.relayed(_decided(s, d).filter("action = 'RELAY_NOW'"), F.col("ts_ms"), DLQ))


@query(
    "relay_scheduled",
    _decided_sql(over_max="CLAMP"),
    _OUT.format(now="due", headers=_TRACE + " || CASE WHEN clamped THEN 'relay-clamped=true;' ELSE '' END || " + _PROV.format(now="due") + " || ';relay-scheduled-for=' || due").replace("CAST(NULL AS INTEGER)", "p") + " WHERE action IN ('SCHEDULE', 'CLAMP')",
)
def relay_scheduled(s, d):
    options = RelayOptions(delay_max_ms=DELAY_MAX, on_over_max="CLAMP", partitioning="SOURCE_PARTITION")
    return _flat(relay.relayed(_decided(s, d, options).filter("action IN ('SCHEDULE', 'CLAMP')"), F.col("dispatch_at_ms"), options, scheduled=True))


@query("relay_without_provenance", _decided_sql(over_max="CLAMP"), "SELECT p AS source_partition, o AS source_offset, ts_ms AS out_ts_ms, 'trace=' || event_id || CASE WHEN clamped THEN ';relay-clamped=true' ELSE '' END AS headers FROM decided WHERE action IN ('SCHEDULE', 'CLAMP')")
def relay_without_provenance(s, d):
    options = RelayOptions(delay_max_ms=DELAY_MAX, on_over_max="CLAMP", provenance=False, timestamps="SOURCE")
    return _flat(relay.relayed(_decided(s, d, options).filter("action IN ('SCHEDULE', 'CLAMP')"), F.lit(NOW), options, scheduled=True)).select("source_partition", "source_offset", "out_ts_ms", "headers")


@query("provenance_headers", _SRC, 'SELECT p AS "partition", o AS "offset", ' + _PROV.format(now=NOW) + " AS headers FROM src")
def provenance_headers(s, d):
    return _source(s, d).select("partition", "offset", relay.headers_text(relay.provenance(F.lit(NOW), DLQ)).alias("headers"))


_ALL = "CASE event_type WHEN 'error' THEN 'relay-delay-ms=abc;trace=' || event_id WHEN 'purchase' THEN 'trace=' || event_id || ';relay-deliver-at=' || (ts_ms + delay) ELSE CASE WHEN event_id % 10 = 0 THEN 'relay-delay-ms=zzz;' ELSE '' END || 'trace=' || event_id || ';relay-delay-ms=' || delay END"


@query("dlq_header_error", _decided_sql(), _OUT.format(now="ts_ms", headers=_ALL + " || ';relay-error-reason=' || reason || ';relay-error-detail=' || detail || ';' || " + _PROV.format(now="ts_ms")) + " WHERE action = 'DLQ'")
def dlq_header_error(s, d):
    return _flat(relay.header_error_dlq(_decided(s, d).filter("action = 'DLQ'"), F.col("ts_ms"), DLQ))


_NOTICE = f"""'{{"v":1,"sourceTopic":"events","sourcePartition":' || p || ',"sourceOffset":' || o || ',"scheduledFor":' || due || ',"detectedAt":{NOW},"reason":"payload-expired"}}'"""


@query("loss_notice_json", _FOLD, f"SELECT p AS source_partition, o AS source_offset, {_NOTICE} AS notice FROM pending")
def loss_notice_json(s, d):
    return _pending(s, d).select("source_partition", "source_offset", relay.loss_notice(F.lit(events.TOPIC), F.lit(NOW)).alias("notice"))


@query("dlq_payload_expired", _CUT, f"SELECT p AS source_partition, o AS source_offset, CAST({NOW} AS BIGINT) AS out_ts_ms, {_NOTICE} AS value, 'relay-error-reason=payload-expired' AS headers FROM settled WHERE route = 'DLQ_EXPIRED'")
def dlq_payload_expired(s, d):
    gone = _settled(s, d).filter("route = 'DLQ_EXPIRED'")
    return _flat(relay.payload_expired_dlq(gone, events.TOPIC, F.lit(NOW), DLQ)).select("source_partition", "source_offset", "out_ts_ms", "value", "headers")


@query(
    "dlq_unrelayable",
    _CUT,
    f"SELECT c.p AS source_partition, c.o AS source_offset, CAST({NOW} AS BIGINT) AS out_ts_ms, CAST(s.user_id AS VARCHAR) AS key, s.props AS value, "
    + _ALL.replace("event_", "s.event_").replace("ts_ms", "s.ts_ms").replace("delay)", "s.delay)").replace("|| delay", "|| s.delay")
    + " || ';relay-error-reason=unrelayable;relay-error-detail=the destination refuses the record;' || "
    + _PROV.format(now=NOW).replace("|| p ||", "|| s.p ||").replace("|| o ||", "|| s.o ||").replace("ts_ms", "s.ts_ms")
    + " AS headers FROM cut c JOIN src s ON s.p = c.p AND s.o = c.o WHERE outcome = 'FOUND' AND c.o % 7 = 3",
)
def dlq_unrelayable(s, d):
    out = drain.settled_outputs(_settled(s, d, DLQ, _refused(s, d)).filter("route = 'DLQ_UNRELAYABLE'"), events.TOPIC, F.lit(NOW), DLQ)
    return _flat(out["dlq"]).select("source_partition", "source_offset", "out_ts_ms", "key", "value", "headers")


@query("record_bytes", _SRC, 'SELECT p AS "partition", o AS "offset", bytes FROM src')
def record_bytes(s, d):
    return _source(s, d).select("partition", "offset", policy.record_bytes(F.col("key"), F.col("value")).alias("bytes"))


_LARGE = 10
_HEADER_BYTES = "CASE event_type WHEN 'view' THEN strlen('relay-delay-ms') + strlen(CAST(delay AS VARCHAR)) + strlen('trace') + strlen(CAST(event_id AS VARCHAR)) + strlen('relay-deliver-at') + strlen(CAST(ts_ms - 1 AS VARCHAR)) WHEN 'click' THEN strlen('trace') + strlen(CAST(event_id AS VARCHAR)) + strlen('relay-delay-ms') + strlen(CAST(delay AS VARCHAR)) + CASE WHEN event_id % 10 = 0 THEN strlen('relay-delay-ms') + 3 ELSE 0 END WHEN 'purchase' THEN strlen('trace') + strlen(CAST(event_id AS VARCHAR)) + strlen('relay-deliver-at') + strlen(CAST(ts_ms + delay AS VARCHAR)) ELSE 0 END"


@query("unrelayable_routing", _decided_sql(), f"SELECT p AS \"partition\", o AS \"offset\", CASE WHEN bytes + {_HEADER_BYTES} > {_LARGE} THEN 'DLQ' ELSE action END AS route, CASE WHEN bytes + {_HEADER_BYTES} > {_LARGE} THEN 'unrelayable' ELSE reason END AS reason FROM decided WHERE action = 'RELAY_NOW'")
def unrelayable_routing(s, d):
    options = RelayOptions(delay_max_ms=DELAY_MAX, max_message_bytes=_LARGE)
    return policy.with_size_route(_decided(s, d, options).filter("action = 'RELAY_NOW'"), options).select("partition", "offset", F.col("action").alias("route"), "reason")


@query("outputs_union", _decided_sql(), "SELECT p AS source_partition, o AS source_offset, CASE action WHEN 'RELAY_NOW' THEN 'destination' WHEN 'DLQ' THEN 'dlq' ELSE 'schedule_log' END AS output FROM decided")
def outputs_union(s, d):
    parts = [rows.select("source_partition", "source_offset", F.lit(name).alias("output")) for name, rows in drain.outputs(_decided(s, d), F.lit(NOW), DLQ).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("next_offsets", _SRC, 'SELECT p AS "partition", max(o) + 1 AS next_offset FROM src GROUP BY p')
def next_offsets(s, d):
    return settle.offsets(_source(s, d)).select("partition", "next_offset")


@query("first_offsets", _SRC, f'SELECT p AS "partition", min(o) AS first_offset FROM src WHERE o >= {LOST_BELOW} GROUP BY p')
def first_offsets(s, d):
    return settle.offsets(_kept_source(s, d)).select("partition", "first_offset")


@query("orphan_partitions", _LOG, 'SELECT DISTINCT p AS "partition" FROM src WHERE p NOT IN (SELECT p FROM log WHERE p < 2)')
def orphan_partitions(s, d):
    return settle.orphan_partitions(_source(s, d), _log(s, d).filter("source_partition < 2"))


# --------------------------------------------------------------------------
# Schedule log
# --------------------------------------------------------------------------

_LOG_COLUMNS = "p AS source_partition, lo AS log_offset, op, o AS source_offset, due AS dispatch_at_ms, clamped, reason"


@query("schedule_log_adds", _decided_sql(over_max="CLAMP"), "SELECT p AS source_partition, o AS source_offset, due AS dispatch_at_ms, clamped FROM decided WHERE action IN ('SCHEDULE', 'CLAMP')")
def schedule_log_adds(s, d):
    return schedule_log.adds(_decided(s, d, CLAMP)).select("source_partition", "source_offset", "dispatch_at_ms", "clamped")


@query(
    "ingest_batches_fold",
    _decided_sql(over_max="CLAMP"),
    "SELECT p AS source_partition, o AS source_offset, least(o // 800, 2) * 1099511627776 + row_number() OVER (PARTITION BY p, least(o // 800, 2) ORDER BY o) AS log_offset, due AS dispatch_at_ms, clamped FROM decided WHERE action IN ('SCHEDULE', 'CLAMP')",
)
def ingest_batches_fold(s, d):
    """Three batches as ingest appends them: all that they schedule is pending."""
    decided = _decided(s, d, CLAMP)
    number = F.least(F.expr("offset div 800"), F.lit(2))
    parts = [schedule_log.appended(schedule_log.adds(decided.filter(number == k)), k) for k in range(3)]
    return schedule_log.folded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("log_codec_roundtrip", _LOG, f"SELECT {_LOG_COLUMNS} FROM log")
def log_codec_roundtrip(s, d):
    return schedule_log.decoded(schedule_log.encoded(_log(s, d), "reason"), "reason").drop("detail")


@query(
    "log_wire_bytes",
    _LOG,
    "SELECT p AS source_partition, lo AS log_offset, lpad(to_hex(o), 16, '0') AS key_hex, CASE WHEN op = 'ADD' THEN 'C50101' || CASE WHEN clamped THEN '01' ELSE '00' END || lpad(to_hex(due), 16, '0') END AS value_hex FROM log",
)
def log_wire_bytes(s, d):
    return schedule_log.encoded(_log(s, d), "reason").select("source_partition", "log_offset", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@query(
    "log_decode",
    _LOG,
    """SELECT p AS source_partition, lo AS log_offset,
  CASE WHEN lo % 10 = 0 THEN 'INVALID' WHEN op = 'COMPLETE' THEN CASE WHEN lo % 10 = 1 THEN 'INVALID' ELSE 'COMPLETE' END WHEN lo % 10 IN (2, 3, 4, 5, 7) THEN 'INVALID' WHEN lo % 10 = 6 THEN 'CANCEL' ELSE 'ADD' END AS op,
  CASE WHEN lo % 10 = 0 THEN 'key is not 8 bytes' WHEN op = 'COMPLETE' THEN CASE WHEN lo % 10 = 1 THEN 'tombstone without a reason' END
    WHEN lo % 10 = 2 THEN 'value is too short' WHEN lo % 10 = 3 THEN 'wrong magic' WHEN lo % 10 = 4 THEN 'unknown version' WHEN lo % 10 = 5 THEN 'value is not 12 bytes' WHEN lo % 10 = 7 THEN 'unknown type' END AS detail FROM log""",
)
def log_decode(s, d):
    wire = schedule_log.encoded(_log(s, d), "reason")
    k, v = F.col("log_offset") % 10, F.hex("value")
    cut = lambda a, b: F.concat(F.substring(v, 1, a), F.lit(b), F.substring(v, a + len(b) + 1, 24))
    spoilt = F.when(k == 2, F.lit("C5")).when(k == 3, cut(0, "C6")).when(k == 4, cut(2, "02")).when(k == 5, F.concat(v, F.lit("00"))).when(k == 6, cut(4, "02")).when(k == 7, cut(4, "09")).when(k == 8, F.concat(F.substring(v, 1, 6), F.lit("FE"), F.substring(v, 9, 16))).otherwise(v)
    none = F.expr("cast(array() as array<struct<key:string,value:binary>>)")
    wire = wire.withColumns({"value": F.when(F.col("value").isNotNull(), F.unhex(spoilt)), "key": F.when(k == 0, F.substring("key", 1, 7)).otherwise(F.col("key")), "headers": F.when((k == 1) & F.col("value").isNull(), none).otherwise(F.col("headers"))})
    return schedule_log.decoded(wire, "reason").select("source_partition", "log_offset", "op", "detail")


_PENDING = "p AS source_partition, o AS source_offset, lo AS log_offset, due AS dispatch_at_ms, clamped"


@query("log_fold", _FOLD, f"SELECT {_PENDING} FROM pending")
def log_fold(s, d):
    return _pending(s, d)


@query("pending_entries", _FOLD, "SELECT p AS source_partition, o AS source_offset FROM pending")
def pending_entries(s, d):
    return _pending(s, d).select("source_partition", "source_offset")


@query("log_compaction", _FOLD, f"SELECT {_PENDING} FROM pending")
def log_compaction(s, d):
    return schedule_log.folded(schedule_log.compacted(_log(s, d)))


@query("log_anomalies", _FOLD, "SELECT p AS source_partition, count(*) FILTER (o <= seen) AS anomalies FROM adds GROUP BY p")
def log_anomalies(s, d):
    return schedule_log.anomalies(_log(s, d))


@query("log_high_watermark", _LOG, "SELECT p AS source_partition, max(lo) + 1 AS high_watermark FROM log GROUP BY p")
def log_high_watermark(s, d):
    return schedule_log.high_watermarks(_log(s, d))


@query("pending_by_partition", _FOLD, "SELECT q.p AS source_partition, count(x.p) AS pending FROM (SELECT unnest(range(5))::INTEGER AS p) q LEFT JOIN pending x ON x.p = q.p GROUP BY q.p")
def pending_by_partition(s, d):
    return due.counts(_pending(s, d), s.range(5).select(F.col("id").cast("int").alias("source_partition")))


@query("max_seen", _LOG, "SELECT p AS source_partition, max(o) AS max_seen FROM log WHERE op = 'ADD' GROUP BY p")
def max_seen(s, d):
    return _log(s, d).filter("op = 'ADD'").groupBy("source_partition").agg(F.max("source_offset").alias("max_seen"))


# --------------------------------------------------------------------------
# Due entries
# --------------------------------------------------------------------------

_PENALIZED = _FOLD + f", eff AS (SELECT *, greatest(due, {NOW} + (p - 2) * 1000) AS effective FROM pending)"


@query("due_now", _FOLD, f"SELECT {_PENDING} FROM pending WHERE due <= {NOW}")
def due_now(s, d):
    return due.due(_pending(s, d), F.lit(NOW)).drop("effective_at_ms")


@query("due_active", _FOLD, f"SELECT {_PENDING} FROM pending WHERE due <= {NOW} AND p IN (0, 2)")
def due_active(s, d):
    live = s.range(0, 4, 2).select(F.col("id").cast("int").alias("source_partition"))
    return due.due(due.active(_pending(s, d), live), F.lit(NOW)).drop("effective_at_ms")


@query("due_with_penalty", _PENALIZED, f"SELECT {_PENDING}, effective AS effective_at_ms FROM eff WHERE effective <= {NOW}")
def due_with_penalty(s, d):
    return due.due(_pending(s, d), F.lit(NOW), _penalties(s, d)).select("source_partition", "source_offset", "log_offset", "dispatch_at_ms", "clamped", "effective_at_ms")


@query("due_rank", _FOLD, f"SELECT {_PENDING}, row_number() OVER (PARTITION BY p ORDER BY due, o) AS due_rank FROM pending")
def due_rank(s, d):
    return due.ranked(_pending(s, d)).withColumn("due_rank", F.col("due_rank").cast("bigint"))


@query("poll_due_topk", _BATCH, "SELECT pos, p AS source_partition, o AS source_offset, due AS dispatch_at_ms FROM posed")
def poll_due_topk(s, d):
    return fetch.positioned(due.top_due(_pending(s, d), F.lit(NOW), MOST), *due.ORDER).select(F.col("pos").cast("bigint").alias("pos"), "source_partition", "source_offset", "dispatch_at_ms")


@query("next_deadline", _PENALIZED, "SELECT min(effective) AS next_deadline_ms FROM eff")
def next_deadline(s, d):
    return due.next_deadline(_pending(s, d), _penalties(s, d))


@query("poll_timeout", _FOLD, "SELECT p AS source_partition, CASE WHEN p = 3 THEN least(w, 10) ELSE w END AS timeout_ms FROM (SELECT p, greatest(0, least(30000, min(due) - 1704070000000)) AS w FROM pending GROUP BY p)")
def poll_timeout(s, d):
    first = _pending(s, d).groupBy("source_partition").agg(F.min("dispatch_at_ms").alias("at"))
    return first.select("source_partition", due.poll_timeout(F.col("at"), F.lit(1704070000000), F.col("source_partition") == 3).alias("timeout_ms"))


@query("backoff_schedule", "", "SELECT k AS streak, CASE WHEN k = 0 THEN 0 ELSE least(10000, 100 * pow(2, least(k, 30) - 1))::BIGINT END AS backoff_ms FROM range(70) t(k)")
def backoff_schedule(s, d):
    return s.range(70).select(F.col("id").alias("streak"), S.backoff_ms(F.col("id"), 100, 10_000).alias("backoff_ms"))


_ATTEMPTS = _SRC + ", att AS (SELECT p, o, event_type = 'error' AS failed FROM src), isl AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY p ORDER BY o) AS g FROM att), stk AS (SELECT *, CAST(sum(failed::INT) OVER (PARTITION BY p, g ORDER BY o) AS BIGINT) AS streak FROM isl)"


def _attempts(s, d):
    return due.streaks(_decided(s, d).select(F.col("partition").alias("source_partition"), F.col("offset").alias("attempt"), (F.col("outcome") == "MALFORMED").alias("failed")))


@query("failure_streaks", _ATTEMPTS, "SELECT p AS source_partition, o AS attempt, streak FROM stk")
def failure_streaks(s, d):
    return _attempts(s, d).select("source_partition", "attempt", "streak")


@query("penalty_stamps", _ATTEMPTS, f"SELECT p AS source_partition, streak, CASE WHEN streak = 0 THEN 0 ELSE {NOW} + least(10000, 50 * pow(2, streak - 1))::BIGINT END AS not_before_ms FROM stk")
def penalty_stamps(s, d):
    return due.penalty_stamps(_attempts(s, d), F.lit(NOW))


@query("backpressure", _FOLD, f"SELECT p AS source_partition, CASE WHEN p = 3 THEN FALSE WHEN n > {HIGH} OR total > {CAP} THEN TRUE WHEN n <= {HIGH // 2} AND total <= {CAP // 2} THEN FALSE ELSE p % 2 = 0 END AS pauses FROM (SELECT p, count(*) AS n, sum(count(*)) OVER () AS total FROM pending GROUP BY p)")
def backpressure(s, d):
    loads = due.counts(_pending(s, d)).withColumns({"paused": F.col("source_partition") % 2 == 0, "recovering": F.col("source_partition") == 3})
    return due.backpressure(loads, HIGH, CAP).select("source_partition", "pauses")


# --------------------------------------------------------------------------
# Fetch and settle
# --------------------------------------------------------------------------


@query("fetch_runs", _BATCH, "SELECT pos, p AS source_partition, o AS source_offset, run_no FROM batch")
def fetch_runs(s, d):
    return _batch(s, d).select(F.col("pos").cast("bigint").alias("pos"), "source_partition", "source_offset", F.col("run_no").cast("bigint").alias("run_no"))


@query("payload_refetch", _BATCH, f"SELECT b.p AS source_partition, b.o AS source_offset, s.o IS NOT NULL AS found, CAST(s.user_id AS VARCHAR) AS key, s.props AS value FROM batch b LEFT JOIN (SELECT * FROM src WHERE o >= {LOST_BELOW}) s ON s.p = b.p AND s.o = b.o")
def payload_refetch(s, d):
    return fetch.refetched(_batch(s, d), _kept_source(s, d), MOST).select("source_partition", "source_offset", "found", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("fetch_outcomes", _FETCH, "SELECT p AS source_partition, o AS source_offset, outcome AS fetch_outcome, n_bytes AS bytes FROM fetched")
def fetch_outcomes(s, d):
    return _outcomes(s, d).select("source_partition", "source_offset", "fetch_outcome", "bytes")


@query("byte_budget_cut", _CUT, "SELECT p AS source_partition, o AS source_offset, outcome AS fetch_outcome, n_bytes AS bytes FROM cut")
def byte_budget_cut(s, d):
    return fetch.within_budget(_outcomes(s, d), BUDGET).select("source_partition", "source_offset", "fetch_outcome", "bytes")


@query("fetch_summary", _CUT, "SELECT p AS source_partition, count(*) FILTER (outcome = 'FOUND') AS found, count(*) FILTER (outcome = 'GONE') AS gone, count(*) FILTER (outcome = 'TRANSIENT') AS transient, count(*) FILTER (outcome = 'CARRY_OVER') AS carried_over, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM cut GROUP BY p")
def fetch_summary(s, d):
    return fetch.summary(fetch.within_budget(_outcomes(s, d), BUDGET))


@query("settlements", _CUT, "SELECT p AS source_partition, o AS source_offset, route, reason FROM settled")
def settlements(s, d):
    return _settled(s, d).select("source_partition", "source_offset", "route", "reason")


def _routes(gone: str, refused: str) -> str:
    bad = "outcome = 'FOUND' AND o % 7 = 3"
    route = f"CASE WHEN {bad} THEN '{refused}' WHEN outcome = 'FOUND' THEN 'RELAY' WHEN outcome = 'GONE' THEN '{gone}' ELSE 'CARRY' END"
    reason = {"DLQ_EXPIRED": "'PAYLOAD_MISSING_DLQ'", "DROP": "'DROPPED'", "FAIL": "NULL"}[gone]
    refusal = "NULL" if refused == "FAIL" else "'REJECTED'"
    return f"SELECT p AS source_partition, o AS source_offset, {route} AS route, CASE WHEN {bad} THEN {refusal} WHEN outcome = 'FOUND' THEN 'DISPATCHED' WHEN outcome = 'GONE' THEN {reason} END AS reason FROM cut"


@query("settlements_drop", _CUT, _routes("DROP", "DROP"))
def settlements_drop(s, d):
    options = RelayOptions(delay_max_ms=DELAY_MAX, on_unfetchable="DROP", on_unrelayable="DROP")
    return _settled(s, d, options, _refused(s, d)).select("source_partition", "source_offset", "route", "reason")


@query("settlements_fail", _CUT, _routes("FAIL", "FAIL"))
def settlements_fail(s, d):
    options = RelayOptions(delay_max_ms=DELAY_MAX, on_unfetchable="FAIL", on_unrelayable="FAIL")
    return _settled(s, d, options, _refused(s, d)).select("source_partition", "source_offset", "route", "reason")


_DLQ_LARGEST = 48


@query(
    "settlements_escalated",
    _CUT,
    f"SELECT c.p AS source_partition, c.o AS source_offset, CASE WHEN outcome = 'FOUND' AND c.o % 7 = 3 THEN CASE WHEN size > {_DLQ_LARGEST} THEN 'FAIL' ELSE 'DLQ_UNRELAYABLE' END WHEN outcome = 'FOUND' THEN 'RELAY' WHEN outcome = 'GONE' THEN 'DLQ_EXPIRED' ELSE 'CARRY' END AS route "
    f"FROM cut c LEFT JOIN (SELECT p AS sp, o AS so, bytes + {_HEADER_BYTES} AS size FROM src) s ON s.sp = c.p AND s.so = c.o",
)
def settlements_escalated(s, d):
    options = RelayOptions(delay_max_ms=DELAY_MAX, max_dlq_bytes=_DLQ_LARGEST)
    return _settled(s, d, options, _refused(s, d)).select("source_partition", "source_offset", "route")


@query("rejected_keys", _CUT, "SELECT p AS source_partition, o AS source_offset, outcome = 'FOUND' AND o % 7 = 3 AS rejected FROM cut")
def rejected_keys(s, d):
    return _settled(s, d, DLQ, _refused(s, d)).select("source_partition", "source_offset", (F.col("route") == "DLQ_UNRELAYABLE").alias("rejected"))


@query("settled_vs_carry", _CUT, "SELECT reason IS NOT NULL AS settled, count(*) AS n FROM settled GROUP BY 1")
def settled_vs_carry(s, d):
    return _settled(s, d).groupBy(F.col("reason").isNotNull().alias("settled")).agg(F.count("*").alias("n"))


@query("completions", _CUT, "SELECT p AS source_partition, 'COMPLETE' AS op, o AS source_offset, reason FROM settled WHERE reason IS NOT NULL")
def completions(s, d):
    return settle.completions(_settled(s, d)).select("source_partition", "op", "source_offset", "reason")


@query("touched_partitions", _CUT, "SELECT DISTINCT p AS source_partition FROM settled WHERE reason IS NOT NULL")
def touched_partitions(s, d):
    return settle.touched_partitions(_settled(s, d))


_LAG = f"SELECT route, count(*) AS n, CAST(sum(greatest(0, {NOW} - due)) AS BIGINT) AS lag_sum_ms, max(greatest(0, {NOW} - due)) AS lag_max_ms, quantile_cont(greatest(0, {NOW} - due), 0.5) AS lag_p50_ms, quantile_cont(greatest(0, {NOW} - due), 0.99) AS lag_p99_ms FROM settled GROUP BY route"


@query("dispatch_lag", _CUT, _LAG)
def dispatch_lag(s, d):
    return settle.dispatch_counters(_settled(s, d), F.lit(NOW))


@query("end_to_end_drain", _CUT, "SELECT p AS source_partition, route, reason, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes, min(due) AS first_due_ms, max(due) AS last_due_ms FROM settled GROUP BY p, route, reason")
def end_to_end_drain(s, d):
    return _settled(s, d).groupBy("source_partition", "route", "reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("dispatch_at_ms").alias("first_due_ms"), F.max("dispatch_at_ms").alias("last_due_ms"))


# --------------------------------------------------------------------------
# Cursor and recovery
# --------------------------------------------------------------------------

_VAR = "greatest(1, CAST(ceil(strlen(bin({x})) / 7.0) AS BIGINT))"
_ZIG = "CASE WHEN ({x}) >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END"
_SIDE = f""", steps AS (SELECT *, lo - coalesce(lag(lo) OVER w, 0) AS dl, o - coalesce(lag(o) OVER w, 0) AS d_o, due - coalesce(lag(due) OVER w, 0) AS dd FROM {{pending}} WINDOW w AS (PARTITION BY p ORDER BY lo)),
lens AS (SELECT *, 1 + {_VAR.format(x="dl")} + {_VAR.format(x=_ZIG.format(x="d_o"))} + {_VAR.format(x=_ZIG.format(x="dd"))} AS entry_bytes FROM steps),
side AS (SELECT *, CAST(sum(entry_bytes) OVER (PARTITION BY p ORDER BY lo) AS BIGINT) + 34 AS used_bytes FROM lens),
hw AS (SELECT p, max(lo) + 1 AS position FROM log GROUP BY p),
cur AS (SELECT h.p AS source_partition, coalesce(min(s.lo) FILTER (s.used_bytes > {SIDECAR * 3 // 4}), h.position) AS cursor_offset, count(s.p) FILTER (s.used_bytes <= {SIDECAR * 3 // 4}) AS pinned FROM hw h LEFT JOIN side s ON s.p = h.p GROUP BY h.p, h.position)"""


@query("oldest_pending", _FOLD, "SELECT p AS source_partition, lo AS log_offset FROM pending ORDER BY lo, p LIMIT 50")
def oldest_pending(s, d):
    return cursor.oldest(_pending(s, d), 50).select("source_partition", "log_offset")


@query("sidecar_prefix", _FOLD + _SIDE.format(pending="pending"), f"SELECT p AS source_partition, lo AS log_offset, entry_bytes, used_bytes, used_bytes <= {SIDECAR * 3 // 4} AS fits FROM side")
def sidecar_prefix(s, d):
    return cursor.sidecar_prefix(_pending(s, d), SIDECAR).select("source_partition", "log_offset", "entry_bytes", "used_bytes", "fits")


@query("committed_cursor", _FOLD + _SIDE.format(pending="pending"), "SELECT * FROM cur")
def committed_cursor(s, d):
    return cursor.committed_cursor(_pending(s, d), _positions(s, d), SIDECAR).select("source_partition", "cursor_offset", "pinned")


@query("cursor_after_commit", _CUT + ", rest AS (SELECT * FROM pending x WHERE NOT EXISTS (SELECT 1 FROM settled y WHERE y.reason IS NOT NULL AND y.p = x.p AND y.o = x.o))" + _SIDE.format(pending="rest"), "SELECT * FROM cur")
def cursor_after_commit(s, d):
    rest = cursor.unsettled(_pending(s, d), _settled(s, d).filter("reason IS NOT NULL"))
    return cursor.committed_cursor(rest, _positions(s, d), SIDECAR).select("source_partition", "cursor_offset", "pinned")


@query("recovered_pending", _FOLD, f"SELECT {_PENDING} FROM pending")
def recovered_pending(s, d):
    log = _log(s, d)
    at = 1_000_000_000_000  # after the first ADDs, before updates and completions
    before = log.filter(F.col("log_offset") < at)
    pinned = schedule_log.folded(before)
    cursors = before.filter("op = 'ADD'").groupBy("source_partition").agg(F.lit(at).cast("bigint").alias("cursor_offset"), F.max("source_offset").alias("max_seen"))
    return cursor.recovered(pinned, log, cursors, schedule_log.high_watermarks(log).withColumnRenamed("high_watermark", "barrier"))


@query("replay_remaining", _LOG, "SELECT p AS source_partition, greatest(0, max(lo) + 1 - 1000000000000) AS remaining FROM log GROUP BY p")
def replay_remaining(s, d):
    barriers = schedule_log.high_watermarks(_log(s, d)).withColumnRenamed("high_watermark", "barrier")
    return cursor.replay_remaining(barriers.select("source_partition", F.lit(1_000_000_000_000).alias("position")), barriers)
