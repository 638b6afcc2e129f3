"""Time series that keep their gaps: every bucket of the window is there, null where nothing was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SECOND, WORK, bucket_us, hist_percentile, hist_sum, ratio
from .percentiles import exact_percentiles
from .summary import in_window


def scaffold(df: DataFrame, start: int, end: int, step_s: int, clamped: bool = False) -> DataFrame:
    """bucket: starts of all buckets. Rule A has floor(span / step) + 1 of them; rule B (clamped) reaches to the end."""
    step = step_s * SECOND
    base = start // step * step
    n = (end - base) // step + 1 if clamped else (end - start) // step + 1
    return df.sparkSession.range(n).select((F.col("id") * step + base).alias("bucket"))


def filled(series: DataFrame, start: int, end: int, step_s: int, zero: tuple[str, ...] = (), groups: DataFrame | None = None, clamped: bool = False) -> DataFrame:
    """series (by bucket and the columns of groups) with a row for each bucket; columns in zero count nothing as 0."""
    frame = scaffold(series, start, end, step_s, clamped)
    keys = ["bucket"]
    if groups is not None:
        frame = groups.crossJoin(F.broadcast(frame))  # buckets are about 240
        keys += groups.columns
    out = frame.join(series, keys, "left")
    return out.fillna(0, list(zero)) if zero else out


def request_series(requests: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """Per bucket: requests, errors, tokens per second, cache hit rate, exact percentiles of the time to the first token."""
    r = in_window(requests, start, end).where(F.col("class").isin(*WORK)).withColumn("bucket", bucket_us(F.col("ts_us"), step_s))
    tokens = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    s = r.groupBy("bucket").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        (tokens("output_tokens") / step_s).alias("out_tok_per_s"),
        (tokens("prompt_tokens") / step_s).alias("in_tok_per_s"),
        ratio(tokens("cached_tokens"), tokens("cached_tokens") + tokens("prompt_tokens")).alias("cache_hit_rate"),
    )
    p = exact_percentiles(r, ["bucket"], "ttft_ms", {"ttft_p50": 0.5, "ttft_p90": 0.9, "ttft_p99": 0.99}).drop("n")
    return filled(s.join(p, "bucket", "left"), start, end, step_s, ("requests", "errors", "out_tok_per_s", "in_tok_per_s"))


def rollup_series(rollup: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """The same from rollups: percentiles are bucket bounds."""
    r = in_window(rollup, start, end, "bucket").where(F.col("class").isin(*WORK)).withColumn("bucket", bucket_us(F.col("bucket"), step_s))
    s = r.groupBy("bucket").agg(F.sum("req_count").alias("requests"), F.sum("err_count").alias("errors"), hist_sum(F.col("ttft_hist")).alias("h"))
    s = s.select("bucket", "requests", "errors", hist_percentile(F.col("h"), 0.5).alias("ttft_p50"), hist_percentile(F.col("h"), 0.99).alias("ttft_p99"))
    return filled(s, start, end, step_s, ("requests", "errors"))


def engine_series(rows: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """Engine requests per bucket: counts and rates are 0 in an empty bucket, means are null; late times fall into the last bucket."""
    step = step_s * SECOND
    last = (end // step) * step
    r = in_window(rows, start, end).withColumn("bucket", F.least(bucket_us(F.col("ts_us"), step_s), F.lit(last)))
    s = r.groupBy("bucket").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("finish") == "error").alias("errors"),
        (F.coalesce(F.sum("output_tokens"), F.lit(0)) / step_s).alias("out_tok_per_s"),
        F.avg("decode_tps").alias("decode_tps"),
        F.avg("ttft_ms").alias("ttft_mean"),
    )
    return filled(s, start, end, step_s, ("requests", "errors", "out_tok_per_s"), clamped=True)


def sample_series(samples: DataFrame, start: int, end: int, step_s: int, means: dict[str, Column], peaks: dict[str, Column], keys: tuple[str, ...] = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """Gauges per bucket: means, peaks and sums of expressions; empty buckets stay null. keys: a series for each."""
    s = in_window(samples, start, end).withColumn("bucket", bucket_us(F.col("ts_us"), step_s))
    aggregates = [F.avg(c).alias(n) for n, c in means.items()] + [F.max(c).alias(n) for n, c in peaks.items()] + [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    out = s.groupBy("bucket", *keys).agg(*aggregates)
    return filled(out, start, end, step_s, groups=s.select(*keys).distinct() if keys else None)


def device_series(samples: DataFrame, start: int, end: int, step_s: int, gauges: tuple[str, ...] = ("util_pct", "mem_used", "temp_c", "power_w")) -> DataFrame:
    """Mean gauges of each device per bucket, nulls left out of the means; gauges may name others, such as readings of the bus."""
    return sample_series(samples, start, end, step_s, {c: F.col(c) for c in gauges}, {}, ("gpu_index",))


def host_devices(samples: DataFrame, owned: list[int], start: int, end: int, step_s: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Owned devices of a host taken together: mean utilisation, sums of memory and power, the hottest latest reading; null if there is none.

    ties: columns that tell which of several readings of one time is the latest.
    """
    s = in_window(samples, start, end).where(F.col("gpu_index").isin(*owned)).withColumn("bucket", bucket_us(F.col("ts_us"), step_s))
    per = s.groupBy("bucket", "gpu_index").agg(
        F.avg("util_pct").alias("util_pct"),
        F.avg("mem_used").alias("mem_used"),
        F.avg("power_w").alias("power_w"),
        F.max_by("temp_c", F.when(F.col("temp_c").isNotNull(), F.struct("ts_us", *ties))).alias("temp_c"),
    )
    out = per.groupBy("bucket").agg(F.avg("util_pct").alias("util_pct"), F.sum("mem_used").alias("mem_used"), F.sum("power_w").alias("power_w"), F.max("temp_c").alias("temp_c"))
    return filled(out, start, end, step_s)


def image_series(generations: DataFrame, samples: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """Generations and errors per hour, exact durations; queue length and free memory, summed over backends at each time, then averaged."""
    g = in_window(generations, start, end).withColumn("bucket", bucket_us(F.col("ts_us"), step_s))
    hours = step_s / 3600
    a = g.groupBy("bucket").agg((F.count_if(F.col("status") != "running") / hours).alias("per_hour"), (F.count_if(F.col("status") == "error") / hours).alias("errors_per_hour"))
    p = exact_percentiles(g, ["bucket"], "total_ms", {"ms_p50": 0.5, "ms_p90": 0.9}).drop("n")
    q = in_window(samples, start, end).where("backend != ''").groupBy("ts_us").agg(F.sum("queue_pending").alias("queue"), F.sum("vram_free").alias("vram_free"))
    q = q.groupBy(bucket_us(F.col("ts_us"), step_s).alias("bucket")).agg(F.avg("queue").alias("queue"), F.avg("vram_free").alias("vram_free"))
    return filled(a.join(p, "bucket", "left").join(q, "bucket", "full"), start, end, step_s, ("per_hour", "errors_per_hour"))
