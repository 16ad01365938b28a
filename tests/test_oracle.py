"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from tidegate.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, db, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = db.sql(registry.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    place = [theirs.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in theirs.fetchall())


def test_saturating_add_of_many_events(spark, tmp_path):
    """From event 10,001 on the SQL's product is beyond DuckDB's BIGINT: the same SQL runs on wider ids."""
    ids = [*range(0, 10), *range(9_990, 10_030), *range(14_990, 15_010), 99_999, 5_999_999, 10**12, 2**63 - 1, -1, -20, -10_000, -(2**62)]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT event_id::HUGEINT AS event_id FROM '{tmp_path}/events.parquet/*.parquet'")
    ours = registry.QUERIES["saturating_add"](spark, str(tmp_path))
    assert ours.dtypes == [("event_id", "bigint"), ("total", "bigint")]
    assert sorted(tuple(r) for r in ours.collect()) == sorted(con.sql(registry.ORACLE_SQL["saturating_add"]).fetchall())
