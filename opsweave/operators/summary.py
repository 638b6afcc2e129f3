"""One-row summaries of a window; each says whether it is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import SECOND, WORK, hist_percentile, hist_sum, pick_grain, ratio
from .percentiles import exact_percentiles
from .rollups import build_rollup

QS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def in_window(df: DataFrame, start: int, end: int, ts: str = "ts_us") -> DataFrame:
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def _with_percentiles(row: DataFrame, values: DataFrame, column: str, prefix: str, qs: dict[str, float]) -> DataFrame:
    p = exact_percentiles(values, [], column, {f"{prefix}_{k}": q for k, q in qs.items()}).drop("n")
    return row.join(p, F.lit(True), "left")  # both sides are one row


def request_summary(requests: DataFrame, start: int, end: int, model: str | None = None, grain: str | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Requests, errors, tokens, rates and latencies of a window. Short windows read raw rows and are exact; longer ones read rollups.

    rollup: the stored rollup of that grain. Without one it is made of the rows of the buckets that start in the window.
    """
    grain = grain or pick_grain(end - start)
    span = (end - start) / SECOND
    r = requests if model is None else requests.where(F.col("model") == model)
    work = F.col("class").isin(*WORK)
    if grain == "raw":
        r = in_window(r, start, end)
        tokens = lambda c: F.coalesce(F.sum(F.when(work, F.col(c))), F.lit(0)).cast("long")
        row = r.agg(
            F.count_if(work).alias("requests"),
            F.count("*").alias("requests_all"),
            F.count_if(work & (F.col("status") >= 400)).alias("errors"),
            tokens("prompt_tokens").alias("input_tokens"),
            tokens("output_tokens").alias("output_tokens"),
            tokens("cached_tokens").alias("cached_tokens"),
            F.max(F.when(work, F.col("ttft_ms"))).alias("ttft_max_ms"),
            F.count_if(work & F.col("attribution").isin("ambiguous", "orphan", "none")).alias("ambiguous_rows"),
        )
        own = r.where(work)
        row = _with_percentiles(_with_percentiles(row, own, "ttft_ms", "ttft", QS), own, "latency_ms", "latency", QS)
    else:
        if rollup is None:
            step = (60 if grain == "1m" else 3600) * SECOND
            rollup = build_rollup(in_window(r, -(-start // step) * step, -(-end // step) * step), step // SECOND)
        elif model is not None:
            rollup = rollup.where(F.col("model") == model)
        roll = in_window(rollup, start, end, "bucket")
        total = lambda c: F.coalesce(F.sum(F.when(work, F.col(c))), F.lit(0)).cast("long")
        row = roll.agg(
            total("req_count").alias("requests"),
            F.coalesce(F.sum("req_count"), F.lit(0)).cast("long").alias("requests_all"),
            total("err_count").alias("errors"),
            total("in_tokens").alias("input_tokens"),
            total("out_tokens").alias("output_tokens"),
            total("cached_tokens").alias("cached_tokens"),
            F.max(F.when(work, F.col("ttft_max"))).alias("ttft_max_ms"),
            F.lit(None).cast("long").alias("ambiguous_rows"),
            hist_sum(F.when(work, F.col("ttft_hist"))).alias("th"),
            hist_sum(F.when(work, F.col("lat_hist"))).alias("lh"),
        )
        row = row.select("*", *[hist_percentile(F.col(h), q).alias(f"{n}_{k}") for h, n in (("th", "ttft"), ("lh", "latency")) for k, q in QS.items()]).drop("th", "lh")
    return row.select(
        F.lit(grain == "raw").alias("exact"),
        "*",
        (F.col("requests") / span).alias("req_per_s"),
        F.coalesce(ratio(F.col("errors"), F.col("requests")), F.lit(0.0)).alias("error_rate"),
        ratio(F.col("cached_tokens"), F.col("cached_tokens") + F.col("input_tokens")).alias("cache_hit_rate"),
        (F.col("output_tokens") / span).alias("out_tok_per_s"),
        (F.col("input_tokens") / span).alias("in_tok_per_s"),
    )


def context_usage(requests: DataFrame, start: int, end: int) -> DataFrame:
    """Mean and largest share of a slot's context that requests of the window filled, where both numbers are known."""
    r = in_window(requests, start, end).where(F.col("class").isin(*WORK))
    used = F.when((F.col("prompt_tokens") > 0) & (F.col("n_ctx_slot") > 0), (F.col("prompt_tokens") + F.col("output_tokens")) / F.col("n_ctx_slot"))
    return r.agg(F.avg(used).alias("mean"), F.max(used).alias("max"), F.count(used).alias("n"))


def engine_summary(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Summary of an engine's request rows (finish, prompt_tokens, cached_tokens, prompt_tokens_total, output_tokens, ttft_ms, latency_ms, decode_tps, paired); rule B percentiles."""
    r = in_window(rows, start, end)
    row = r.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("finish") == "error").alias("errors"),
        F.count_if(~F.col("paired")).alias("unpaired"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(ratio(F.sum("cached_tokens"), F.sum("prompt_tokens_total")), F.lit(0.0)).alias("cache_hit_rate"),
        F.avg("decode_tps").alias("decode_tps_mean"),
        F.avg("prefill_tps").alias("prefill_tps_mean"),
    )
    p = exact_percentiles(r, [], "ttft_ms", {"ttft_p50": 0.5, "ttft_p90": 0.9}, "linear").drop("n")
    return row.join(p, F.lit(True), "left")


def image_summary(generations: DataFrame, start: int, end: int) -> DataFrame:
    """Finished and running generations apart, error rate, models used, exact durations, share of the window that was busy."""
    g = in_window(generations, start, end)
    done = F.col("status") != "running"
    span_ms = (end - start) / 1000
    row = g.agg(
        F.count_if(done).alias("done"),
        F.count_if(~done).alias("running"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(ratio(F.count_if(F.col("status") == "error"), F.count_if(done)), F.lit(0.0)).alias("error_rate"),
        F.count_distinct("model").alias("models"),
        F.avg("total_ms").alias("mean_ms"),
        F.max("total_ms").alias("max_ms"),
        (F.coalesce(F.sum("total_ms"), F.lit(0.0)) / span_ms).alias("busy"),
    )
    return _with_percentiles(row, g, "total_ms", "ms", {"p50": 0.5, "p90": 0.9})


def gauge_statistics(samples: DataFrame, value: str, keys: list[str], ts: str = "ts_us") -> DataFrame:
    """Mean, smallest, largest and newest value and number of samples, nulls left out."""
    v = F.col(value)
    return samples.where(v.isNotNull()).groupBy(*keys).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.max_by(v, F.col(ts)).alias("last"), F.count(v).alias("n"))


def cache_summary(samples: DataFrame, start: int, end: int, pressure: float = 0.9) -> DataFrame:
    """Cache gauge: mean, largest, newest; null without samples; pressure where the largest reaches the mark."""
    s = in_window(samples, start, end)
    return s.agg(
        F.avg("usage").alias("mean"),
        F.max("usage").alias("max"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("ts_us"))).alias("last"),
        F.count("*").alias("samples"),
        F.coalesce(F.max("usage") >= pressure, F.lit(False)).alias("pressure"),
    )


def cache_usage(samples: DataFrame, start: int, end: int, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Share of a cache in use (used_tokens / max_tokens): mean, largest and number over samples that tell it; share, jobs and hit rate of the newest sample, null where it doesn't tell them."""
    s = in_window(samples, start, end).withColumn("share", F.when(F.col("max_tokens") > 0, F.col("used_tokens") / F.col("max_tokens")))
    newest = F.max_by(F.struct("share", "active_jobs", "pending_jobs", "hit_rate"), "ts_us").alias("l")
    row = s.groupBy(*keys).agg(F.avg("share").alias("mean"), F.max("share").alias("max"), F.count("share").alias("n"), newest)
    return row.select(*keys, "mean", "max", F.col("l.share").alias("last"), "l.active_jobs", "l.pending_jobs", "l.hit_rate", "n")


def coverage(table: DataFrame, start: int, ts: str = "ts_us") -> DataFrame:
    """Oldest row, and whether the table reaches back to start; an empty one never does."""
    return table.agg(F.min(ts).alias("oldest"), F.coalesce(F.min(ts) <= start, F.lit(False)).alias("complete"))


def table_statistics(tables: dict[str, DataFrame], source: str | None = None, ts: str = "ts_us") -> DataFrame:
    """Rows and time span of each table, of one source where the table has sources."""
    out = None
    for name, t in tables.items():
        split = "source" in t.columns
        own = t.where(F.col("source") == source) if source is not None and split else t
        row = own.agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(F.lit(name).alias("table"), F.lit(split).alias("by_source"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of value weighted by weight, over rows with a value and a positive weight; null without any."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    return rows.groupBy(*keys).agg(ratio(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight)))).alias("mean"))


def footer_statistics(spark: SparkSession, stored: dict[str, tuple[list[str], str]]) -> DataFrame:
    """table, n, first, last of tables on Parquet: name -> (paths, a whole-number column). Answered from the files' footers, no row is read."""
    wanted = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = []
        for name, (paths, column) in stored.items():
            told = spark.read.parquet(*paths).agg(F.count("*"), F.min(column), F.max(column))
            rows.append((name, *told.first()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.createDataFrame(rows, "table string, n long, first long, last long")
