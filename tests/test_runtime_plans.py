"""States carried from part to part, where a join becomes a broadcast at run time."""

from pyspark.sql import functions as F

from opsweave.operators import correlate, ordered


def _at_run_time(spark, run):
    """Joins are planned as sort-merge, and become broadcasts when their sides turn out small."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16KB"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        return run()
    finally:
        for name in names:
            spark.conf.unset(name)


def test_a_part_stays_in_one_task(spark):
    """Rows come from four tasks out of order; each step adds nothing but the bound of its row."""
    rows = spark.range(0, 8000, 1, 4).selectExpr("if(id < 0, 'b', 'a') as source", "(id * 37) % 8000 as seq").selectExpr("*", "if(seq % 50 = 0, seq, -1000) as low", "sha2(string(seq), 512) as text")
    got = _at_run_time(spark, lambda: ordered.scan(rows, ordered.CLAMPED, [F.col("low"), F.lit(1 << 61)], "x", start=-5, part=100).collect())
    assert sorted((r.seq, r.x) for r in got) == [(s, s // 50 * 50) for s in range(8000)]


def test_queues_in_parts(spark):
    rows = [(s, 1000 * s, s % 7 < 3 if s // 300 % 2 else s % 5 == 0) for s in range(8000)]
    fifo = correlate.Fifo(wait_us=50_000)
    want = fifo.feed(rows) + [(s, s, "orphan") for s, _ in fifo.queue]
    events = spark.createDataFrame([("a", *r) for r in rows], "source string, seq long, ts_us long, arrives boolean").repartition(4, "seq")
    got = _at_run_time(spark, lambda: correlate.fifo_with_expiry(events, part=100, wait_us=50_000).collect())
    assert sorted(((r.seq, r.task_seq, r.match) for r in got), key=str) == sorted(want, key=str)


def test_the_exchange_before_a_walk_is_its_own(spark):
    """One that a join below shares would be read by mapper if that join became a broadcast: then a part is in several tasks."""
    rows = spark.range(0, 400, 1, 4).selectExpr("if(id < 0, 'b', 'a') as source", "id as seq")
    plan = _at_run_time(spark, lambda: ordered.scan(rows, ordered.CLAMPED, [F.col("seq"), F.lit(1 << 61)], "x", part=100)._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == 3
