"""Tables by day: files follow the days, not the tasks that held the rows."""

import glob

from opsweave.operators import tables

DAY = 86_400_000_000


def test_a_day_is_a_file(spark, tmp_path):
    rows = spark.range(2000).selectExpr(f"id * {DAY // 50} as ts_us", "id as key", "1 as v").repartition(4)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")  # as with more rows, which Spark leaves in several tasks
    try:
        assert tables.append_first_wins(rows, f"{tmp_path}/a", ("ts_us", "key"), "ts_us") == 2000
        tables.upsert_last_wins(rows, f"{tmp_path}/u", ("key",), "ts_us")
    finally:
        spark.conf.set(merged, before)
    for name in ("a", "u"):
        assert len(glob.glob(f"{tmp_path}/{name}/dt=*/*.parquet")) == len(glob.glob(f"{tmp_path}/{name}/dt=*")) == 40
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 2000
