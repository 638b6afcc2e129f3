"""Files read in blocks and by name, statistics from footers."""

from pyspark.sql import functions as F

from opsweave.operators import summary
from opsweave.sources import readers


def test_a_file_of_many_blocks_keeps_its_order(spark, tmp_path):
    """Ten blocks and more, each read by a task of its own."""
    text = [f"{i} {'x' * (i % 50)}" if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(text) + "\n")
    (tmp_path / "b.log").write_text("\n".join(["last", "", "end"]) + "\n")
    (tmp_path / "c.txt").write_text("no log\n")
    size = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(size), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(size, "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scan = readers.log_scan(spark, str(tmp_path / "a.log"))
        got = {r.seq: r.message for r in scan.collect()}
        blocks = spark.read.text(str(tmp_path / "a.log")).select(F.spark_partition_id().alias("p")).distinct().count()
        runs = [(r.seq, r.message) for r in readers.startup_scan(spark, str(tmp_path)).orderBy("seq").collect()]
        newest = [(r.seq, r.message) for r in readers.startup_scan(spark, str(tmp_path), newest=True).orderBy("seq").collect()]
    finally:
        spark.conf.set(size, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    want = {i + 1: m for i, m in enumerate(text) if m}
    assert blocks >= 10 and got == want
    assert runs == [*want.items(), (4001, "last"), (4003, "end")] and newest == [(1, "last"), (3, "end")]


def test_answers_are_chosen_by_name(spark, tmp_path):
    for ts in (5, 70, 900):
        (tmp_path / "s1").mkdir(exist_ok=True)
        (tmp_path / "s1" / f"{ts:020d}.json").write_text(f"body {ts}")
    (tmp_path / "s1" / "notes.json").write_text("no time")
    assert sorted(map(tuple, readers.scrape_scan(spark, str(tmp_path), 6, 900).collect())) == [("s1", 70, "body 70")]
    assert {r.ts_us for r in readers.scrape_scan(spark, str(tmp_path)).collect()} == {5, 70, 900}


def test_footers_answer_statistics(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5, 105).write.parquet(path)
    assert [tuple(r) for r in summary.footer_statistics(spark, {"t": ([path], "id")}).collect()] == [("t", 100, 5, 104)]
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    try:
        spark.conf.set("spark.sql.sources.useV1SourceList", "")
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        plan = spark.read.parquet(path).agg(F.count("*"), F.min("id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")
    assert "PushedAggregation: [COUNT(*), MIN(id)]" in plan
