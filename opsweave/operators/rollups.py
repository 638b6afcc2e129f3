"""Rollups of requests with histograms that add, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket_us, hist_counts, hist_sum

_SUMS = ("req_count", "err_count", "in_tokens", "out_tokens", "cached_tokens", "ttft_n", "lat_n")


def build_rollup(requests: DataFrame, step_s: int) -> DataFrame:
    """A row for each (bucket, model or '', class): counts, token sums, duration sums and histograms; of decoding and queueing where requests tell them."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return requests.groupBy(bucket_us(F.col("ts_us"), step_s).alias("bucket"), F.coalesce("model", F.lit("")).alias("model"), "class").agg(
        F.count("*").alias("req_count"),
        F.count_if(F.col("status") >= 400).alias("err_count"),
        whole("prompt_tokens").alias("in_tokens"),
        whole("output_tokens").alias("out_tokens"),
        whole("cached_tokens").alias("cached_tokens"),
        F.coalesce(F.sum("ttft_ms"), F.lit(0.0)).alias("ttft_sum"),
        F.count("ttft_ms").alias("ttft_n"),
        F.max("ttft_ms").alias("ttft_max"),
        hist_counts(F.col("ttft_ms")).alias("ttft_hist"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("lat_sum"),
        F.count("latency_ms").alias("lat_n"),
        hist_counts(F.col("latency_ms")).alias("lat_hist"),
        *_further(requests),
    )


def _further(requests: DataFrame) -> list[Column]:
    out = [F.coalesce(F.sum("decode_ms"), F.lit(0.0)).alias("decode_ms_sum")] if "decode_ms" in requests.columns else []
    if "queue_ms" in requests.columns:
        out += [F.coalesce(F.sum("queue_ms"), F.lit(0.0)).alias("queue_sum"), F.count("queue_ms").alias("queue_n"), F.max("latency_ms").alias("lat_max")]
    return out


def coarsen(rollup: DataFrame, step_s: int) -> DataFrame:
    """A coarser rollup from a finer one: everything in it adds."""
    return rollup.groupBy(bucket_us(F.col("bucket"), step_s).alias("bucket"), "model", "class").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.sum("ttft_sum").alias("ttft_sum"),
        F.max("ttft_max").alias("ttft_max"),
        hist_sum(F.col("ttft_hist")).alias("ttft_hist"),
        F.sum("lat_sum").alias("lat_sum"),
        hist_sum(F.col("lat_hist")).alias("lat_hist"),
        *[F.sum(c).alias(c) for c in ("decode_ms_sum", "queue_sum", "queue_n") if c in rollup.columns],
        *[F.max(c).alias(c) for c in ("lat_max",) if c in rollup.columns],
    )


def merge_histograms(rollup: DataFrame, keys: list[str], hist: str = "ttft_hist") -> DataFrame:
    """keys and the element-wise sum of a histogram."""
    return rollup.groupBy(*keys).agg(hist_sum(F.col(hist)).alias(hist))


def touched_buckets(requests: DataFrame, since_us: int, until_us: int, step_s: int) -> DataFrame:
    """Rows of all whole buckets that [since, until] touches: what a refresh recomputes, so that late rows count."""
    low, high = since_us // (step_s * 1_000_000), until_us // (step_s * 1_000_000) + 1
    return requests.where((F.col("ts_us") >= low * step_s * 1_000_000) & (F.col("ts_us") < high * step_s * 1_000_000))
