"""Rules of tables on Parquet: first wins, last wins, keep if null, retention, purge, widening."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys by which tables take each row once; the first wins, or the last.
KEYS = {
    "requests": ("ts_us", "endpoint", "method", "client_ip", "status", "latency_ms", "task_id"),
    "events": ("ts_us", "kind", "model", "msg", "duration_ms"),
    "image_events": ("ts_us", "source", "kind", "backend_index", "msg", "route"),
    "proxy_requests": ("ts_us", "source", "client", "endpoint", "model", "messages", "prompt_tokens"),
    "engine_requests": ("ts_us", "source", "req_id", "finish", "prompt_tokens", "output_tokens", "ttft_ms", "latency_ms"),
    "ring_requests": ("source", "started_us", "prompt_tokens_total"),
    "image_generations": ("source", "prompt_id"),
}
LAST_WINS = ("image_generations",)
# Days that kinds of tables are kept; 0 is for ever.
RETENTION_DAYS = {"requests": 7, "samples": 30, "rollup_1m": 90, "rollup_1h": 0}


def same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equal keys, nulls being equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def first_wins(new: DataFrame, target: DataFrame | None, keys: tuple[str, ...], order: str) -> DataFrame:
    """Rows of new to append: one for each key, the first by order, and none whose key the target has."""
    n = first_rows(new, keys, order)
    return n if target is None else n.join(target.select(*keys).alias("t"), same(n, target, keys), "left_anti")


def first_rows(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__k = 1").drop("__k")


def last_wins(target: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The newest row of each key, of both."""
    both = target.unionByName(new, allowMissingColumns=True)
    return latest(both, keys, order)


def latest(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The newest row of each key: one shuffle of partial maxima, no join."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.col(order)).alias("r")).select(*keys, "r.*")


def registry(polls: DataFrame, key: str, order: str, replace: tuple[str, ...] = (), keep: tuple[str, ...] = (), known: dict[str, str] | None = None) -> DataFrame:
    """State of each source after its polls: columns replaced by the newest poll, kept where it is null, or cleared only by a poll that looked.

    known: column -> flag column that says whether the poll looked.
    """
    o = F.col(order)
    out = [F.max(order).alias(order)] + [F.max_by(c, o).alias(c) for c in replace]
    out += [F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in keep]
    out += [F.max_by(c, F.when(F.col(flag) | F.col(c).isNotNull(), o)).alias(c) for c, flag in (known or {}).items()]
    return polls.groupBy(key).agg(*out)


def configured(rows: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose source is configured; a disabled one counts."""
    return rows.join(sources.select(key).distinct(), key, "left_semi")


def registry_list(rows: DataFrame, sources: DataFrame, now_us: int) -> DataFrame:
    """Registry rows (source, last_us, started_us, reachable, devices, devices_us) of configured sources as they are shown, at now_us.

    stale_s is the time since the last poll, uptime_s that since the start, devices_age_s that since devices were attributed; each is null
    where its time is. devices is a list: null if unknown, empty if the source holds none. reachable is false where no poll says so.
    """
    since = lambda c: (F.lit(now_us) - F.col(c)) / 1e6
    shown = configured(rows, sources)
    return shown.select(
        *[c for c in shown.columns if c not in ("reachable", "devices")],
        F.coalesce("reachable", F.lit(False)).alias("reachable"),
        F.from_json(F.nullif(F.trim("devices"), F.lit("")), "array<int>").alias("devices"),
        since("last_us").alias("stale_s"),
        since("started_us").alias("uptime_s"),
        since("devices_us").alias("devices_age_s"),
    )


def purge(table: DataFrame, source: str) -> DataFrame:
    """The table without one source."""
    return table.where(~F.col("source").eqNullSafe(F.lit(source)))


def prune(table: DataFrame, now_us: int, days: int, ts: str = "ts_us") -> DataFrame:
    """Rows that retention keeps; 0 days are for ever."""
    return table if days == 0 else table.where(F.col(ts) >= now_us - days * 86_400_000_000)


def pruned_counts(tables: dict[str, tuple[DataFrame, int]], now_us: int, ts: str = "ts_us") -> DataFrame:
    """How many rows retention drops from each table."""
    parts = []
    for name, (t, days) in tables.items():
        dropped = F.lit(0).cast("long") if days == 0 else F.count_if(F.col(ts) < now_us - days * 86_400_000_000)
        parts.append(t.agg(dropped.alias("dropped")).select(F.lit(name).alias("table"), "dropped"))
    return reduce(DataFrame.unionByName, parts)


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables; old rows have null in new columns."""
    return old.unionByName(new, allowMissingColumns=True)


def with_day(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    """df with dt, the day that tables are partitioned by."""
    return df.withColumn("dt", F.to_date(F.timestamp_micros(F.col(ts))))


def _by_day(df: DataFrame) -> DataFrame:
    """df as it is written: the rows of a day lie together, so that there is a file for a day, not one for each task and day; a day that is large is parted again."""
    return df.hint("rebalance", "dt")


def append_first_wins(new: DataFrame, path: str, keys: tuple[str, ...], order: str) -> int:
    """Append what a table on Parquet doesn't have yet; running it again adds nothing. Returns the rows added."""
    spark, n = new.sparkSession, with_day(new, "ts_us")
    target = table_at(spark, path)
    if target is not None:
        days = [r[0] for r in n.select("dt").distinct().collect()]
        target = target.where(F.col("dt").isin(days))
    rows = first_wins(n, target, keys, order).persist()
    count = rows.count()
    if count:
        _by_day(rows).write.mode("append").partitionBy("dt").parquet(path)
    rows.unpersist()
    return count


def upsert_last_wins(new: DataFrame, path: str, keys: tuple[str, ...], order: str) -> None:
    """Rewrite the day partitions that new rows touch or that hold their keys, the newest row of a key winning, on whatever day it is."""
    spark, n = new.sparkSession, with_day(new, "ts_us")
    target = table_at(spark, path)
    days, left, beside = set(), set(), None
    if target is not None:
        known = n.select(*keys).distinct()
        held = target.select(*keys, "dt").join(known, same(target, known, keys), "left_semi")
        days = {r[0] for r in n.select("dt").union(held.select("dt")).distinct().collect()}
        inside = F.col("dt").isin([d for d in days if d is not None])
        n = last_wins(target.where(inside | F.col("dt").isNull() if None in days else inside), n, keys, order)
        beside = f"{path.rstrip('/')}__new_{uuid.uuid4().hex}"
        n = _detached(n, beside)
        left = {r[0] for r in n.select("dt").distinct().collect()}
    _by_day(n).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    if beside is not None:
        _drop_partition(spark, beside)
    # A day that has lost its last row isn't written; a run that stops before this is made good by the next upsert of the key.
    for day in days - left:
        _drop_partition(spark, f"{path.rstrip('/')}/dt={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")


def _drop_partition(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _detached(df: DataFrame, beside: str) -> DataFrame:
    """df written beside the table, so that the table can be overwritten from it."""
    df.write.parquet(beside)
    return df.sparkSession.read.parquet(beside)


def table_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None before its first write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and any(s.isDirectory() for s in fs.listStatus(p)) else None
