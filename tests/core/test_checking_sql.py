"""The checking SQL holds on more than small tables."""

import datetime

import duckdb

from ledgerline.plans import flow_queries, registry


def test_numbers_that_read_as_days_are_dates(spark, tmp_path):
    """Eight digits of two layouts that read as a day are no numbers, so later ones move up a slot."""
    keys = [(487808, 1), (689659, 69730), (8, 2), (7, 3), (16, 4)]
    rows = [(k, c, "O", 1.0, datetime.datetime(1996, 1, 1), "1-URGENT") for k, c in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in flow_queries.narrative_roles(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["narrative_roles"]).fetchall())
    assert [r for r in got if r[0] == 487808] == [(487808, 1, "AMOUNT", "1.500.000")]


def test_equal_intervals_do_not_part_an_island(spark):
    """Rows that repeat an interval are ordered by their key, so both windows see them in one order."""
    con = duckdb.connect()
    con.execute("SET threads = 8")
    con.execute("CREATE TABLE events AS SELECT i AS event_id, i % 1500 AS user_id, (hash(i) % 56000) / 100.0 AS value FROM range(600000) t(i)")
    sql = registry.oracle_sql()["interval_union"]
    assert "ORDER BY a, b, event_id" in sql
    touching = f"SELECT count(*) FROM (SELECT b, lead(a) OVER (PARTITION BY user_id ORDER BY a, b) AS next FROM ({sql})) WHERE next <= b"
    assert con.execute(touching).fetchone()[0] == 0
