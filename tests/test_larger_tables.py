"""What larger tables bring: equal times, equal keys, long logs; queries against their SQL in DuckDB."""

import re

import duckdb
import pytest

from opsweave.plans import catalog, fixtures, logs, measured, rendered, served, stored  # noqa: F401


def tables(spark, folder, events=None, lineitem=None):
    """A folder of tables; events are rows (event_id, us after 2024-01-01, user_id, event_type, value, k)."""
    if events is not None:
        kinds = "event_id long, us long, user_id long, event_type string, value double, k long"
        e = spark.createDataFrame(events, kinds) if isinstance(events, list) else events
        e.selectExpr("event_id", f"timestamp_micros({catalog.FIRST} + us) as ts", "user_id", "event_type", "value", "concat('{\"k\": ', k, '}') as props").write.parquet(f"{folder}/events.parquet")
    if lineitem is not None:
        kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate string"
        spark.createDataFrame(lineitem, kinds).withColumn("l_shipdate", catalog.F.col("l_shipdate").cast("timestamp")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def answers(spark, folder, name, given):
    """Rows of a query and of its SQL, in order."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for table in given:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = [tuple(r) for r in catalog.QUERIES[name](spark, folder).select(*columns).collect()]
    return sorted(rows, key=repr), sorted(want.fetchall(), key=repr)


def test_journal_lines_of_one_time(spark, tmp_path):
    """Two lines of one time, of two sources."""
    folder = tables(spark, tmp_path, [(i, 5_000_000, i, "click", 1.5, 1 + i) for i in range(4)])
    got, want = answers(spark, folder, "s1_journal", ["events"])
    assert got == want and len(got) == 4


def test_a_log_of_many_days_under_one_banner(spark, tmp_path):
    """Seconds since the banner pass 2**31."""
    n = 307_000
    folder = tables(spark, tmp_path, spark.range(n).selectExpr("id as event_id", "id * 1000000 as us", "cast(4 as bigint) as user_id", "'click' as event_type", "cast(1 as double) as value", "id % 100 as k"))
    assert catalog.QUERIES["t5_banner_clock"](spark, folder).where(f"ts_us = {catalog.FIRST} + (cast(seq as bigint) - 1)*7000000000").count() == n


def test_readings_of_one_time_and_one_order(spark, tmp_path):
    """The latest of equal readings is the hottest, in whatever order they come."""
    rows = [(7, 1, float(q), 10.0 * q, 0.01, "A", "1996-01-05") for q in (3, 9, 4)]
    for i, order in enumerate((rows, rows[::-1])):
        folder = tables(spark, tmp_path / str(i), lineitem=order)
        got, want = answers(spark, folder, "w11_host_devices", ["lineitem"])
        assert got == want and 39.0 in [r[-1] for r in got]


@pytest.mark.parametrize("name", ["scrapes", "n_log"])
def test_views_order_hours_of_a_source_apart(spark, tmp_path, name, monkeypatch):
    """No window of a view runs over all rows of a source, and its rows are those of the plain form; times are equal in places and hours empty."""
    events = [(i, i // 2 * 7_000_000 + i // 90 * 9_000_000_000, i, ("click", "view", "signup", "error", "purchase")[i % 5], i % 37 * 9.5, i * 7 % 100) for i in range(400)]
    folder = tables(spark, tmp_path, events)
    got = fixtures.view(spark, folder, name)
    assert not re.search(r"windowspecdefinition\(source#\d+L?, (ts_us|t)#", got._jdf.queryExecution().optimizedPlan().toString())
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(fixtures, "PARTED", {})
    assert rows == sorted(map(tuple, fixtures.view(spark, folder, name).collect())) and len(rows) >= 400
