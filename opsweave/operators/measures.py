"""Further measures of a window: decode rates, queueing, context use, drafts, timing of images, pressure of caches, slots beside concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SECOND, WORK, bucket_us, hist_percentile, ratio
from . import deltas
from .intervals import concurrency_series
from .percentiles import exact_percentiles
from .series import filled
from .summary import in_window


def _tokens(column: str):
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def _rate(tokens, ms):
    """Tokens a second of the time spent; null where none was."""
    return F.when(ms > 0, tokens / (ms / 1000))


def request_measures(requests: DataFrame, start: int, end: int) -> DataFrame:
    """decode_tps_mean (tokens over time decoding), queue_ms_mean, queue_ms_p90, latency_max_ms and how full contexts were at release; from raw rows, exact."""
    own = in_window(requests, start, end).where(F.col("class").isin(*WORK))
    full = F.when((F.col("context_tokens") > 0) & (F.col("n_ctx_slot") > 0), F.col("context_tokens") / F.col("n_ctx_slot"))
    row = own.agg(
        _rate(_tokens("output_tokens"), F.coalesce(F.sum("decode_ms"), F.lit(0.0))).alias("decode_tps_mean"),
        F.avg("queue_ms").alias("queue_ms_mean"),
        F.max("latency_ms").alias("latency_max_ms"),
        F.avg(full).alias("ctx_mean"),
        F.max(full).alias("ctx_max"),
        F.count(full).alias("ctx_n"),
    )
    p = exact_percentiles(own, [], "queue_ms", {"queue_ms_p90": 0.9}).drop("n")
    return row.join(p, F.lit(True), "left")  # both sides are one row


def rollup_measures(rollup: DataFrame, start: int, end: int) -> DataFrame:
    """The same as far as rollups tell: percentiles of queueing and contexts are not in them."""
    r = in_window(rollup, start, end, "bucket").where(F.col("class").isin(*WORK))
    return r.agg(
        _rate(_tokens("out_tokens"), F.coalesce(F.sum("decode_ms_sum"), F.lit(0.0))).alias("decode_tps_mean"),
        ratio(F.sum("queue_sum"), F.sum("queue_n")).alias("queue_ms_mean"),
        F.max("lat_max").alias("latency_max_ms"),
    )


def request_measure_series(requests: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """Decode rate and mean queueing per bucket; null where nothing was measured."""
    r = in_window(requests, start, end).where(F.col("class").isin(*WORK)).withColumn("bucket", bucket_us(F.col("ts_us"), step_s))
    s = r.groupBy("bucket").agg(_rate(_tokens("output_tokens"), F.coalesce(F.sum("decode_ms"), F.lit(0.0))).alias("decode_tps"), F.avg("queue_ms").alias("queue_ms"))
    return filled(s, start, end, step_s)


def rollup_by_model(rollup: DataFrame, start: int, end: int) -> DataFrame:
    """by_model() from rollups, with decode rates; a model of '' is one that was not named."""
    r = in_window(rollup, start, end, "bucket").where(F.col("class").isin(*WORK))
    return r.groupBy(F.when(F.col("model") == "", "(unattributed)").otherwise(F.col("model")).alias("model")).agg(
        F.sum("req_count").alias("requests"),
        F.sum("err_count").alias("errors"),
        _tokens("in_tokens").alias("prompt_tokens"),
        _tokens("out_tokens").alias("output_tokens"),
        _tokens("cached_tokens").alias("cached_tokens"),
        ratio(F.sum("ttft_sum"), F.sum("ttft_n")).alias("ttft_mean_ms"),
        ratio(F.sum("lat_sum"), F.sum("lat_n")).alias("latency_mean_ms"),
        _rate(_tokens("out_tokens"), F.coalesce(F.sum("decode_ms_sum"), F.lit(0.0))).alias("decode_tps"),
        F.max("bucket").alias("last_bucket"),
    )


def engine_measures(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Of an engine's requests: mean acceptance of drafts, those whose client went away, slowest first token, latencies by rule B."""
    r = in_window(rows, start, end)
    row = r.agg(F.avg("draft_accept").alias("draft_accept_mean"), F.count_if(F.col("kind") == "disconnect").alias("disconnected"), F.max("ttft_ms").alias("ttft_max_ms"))
    p = exact_percentiles(r, [], "latency_ms", {"latency_p50": 0.5, "latency_p90": 0.9, "latency_p99": 0.99}, "linear").drop("n")
    return row.join(p, F.lit(True), "left")


def image_measures(generations: DataFrame, events: DataFrame, start: int, end: int) -> DataFrame:
    """Generations an hour, preparation and generation apart, and how often interfaces failed, back ends complained and came up. Requests of several images make several events, so events are not joined to generations."""
    done = in_window(generations, start, end).agg((F.count_if(F.col("status").isin("success", "error")) / ((end - start) / SECOND / 3600)).alias("gen_per_hour"))
    kind = F.col("kind")
    finished = kind == "generation_finished"
    said = in_window(events, start, end).agg(
        F.count_if(finished).alias("timed"),
        F.avg(F.when(finished, F.col("prep_ms"))).alias("prep_ms_mean"),
        F.max(F.when(finished, F.col("prep_ms"))).alias("prep_ms_max"),
        F.avg(F.when(finished, F.col("gen_ms"))).alias("gen_ms_mean"),
        F.count_if(kind == "webapi_error").alias("webapi_errors"),
        F.count_if(kind == "backend_stderr").alias("backend_stderr"),
        F.count_if(kind == "backend_up").alias("backend_restarts"),
    )
    return done.join(said, F.lit(True))


def cache_measures(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Limits of a prompt cache and what happened to it: sums of its samples' counters, cost of updates, most checkpoints in use."""
    s = in_window(samples, start, end)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts_us"))).alias(c)
    sums = ("evictions", "evict_crowded", "evict_invalidated", "restores", "ckpt_created", "saves")
    return s.agg(newest("limit_mib"), newest("token_limit"), newest("ckpt_total"), F.max("ckpt_used").alias("ckpt_peak"), *[_tokens(c).alias(c) for c in sums], F.avg("update_ms").alias("update_ms_mean"), F.max("update_ms").alias("update_ms_max"))


def concurrency_and_slots(requests: DataFrame, samples: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """concurrency_series() with the slots that the last sample of each bucket tells."""
    s = in_window(samples, start, end).where("slots is not null").groupBy(bucket_us(F.col("ts_us"), step_s).alias("bucket")).agg(F.max_by("slots", "ts_us").alias("slots"))
    return concurrency_series(requests, start, end, step_s).join(s, "bucket", "left")


def metric_summary(differences: DataFrame, histograms: DataFrame, counter: str, gauge: str, start: int, end: int) -> DataFrame:
    """One metric family of an engine over a window: total and rate of a counter's differences (d_<counter>), mean and greatest of a gauge, observations, mean and percentiles of histogram rows as histogram_range() takes them."""
    d = in_window(differences, start, end)
    value = F.col(gauge).cast("double")
    row = d.agg(F.coalesce(F.sum(f"d_{counter}"), F.lit(0)).cast("long").alias("total"), F.avg(value).alias("gauge_mean"), F.max(value).alias("gauge_max"))
    told = deltas.histogram_range(histograms, start, end).select("observations", "mean", "p50", "p90", "p99", "rows_skipped")
    return row.withColumn("per_s", F.col("total") / ((end - start) / SECOND)).join(told, F.lit(True), "left")  # both sides are one row


def metric_series(differences: DataFrame, histograms: DataFrame, counter: str, gauge: str, bounds: list[float], start: int, end: int, step_s: int, qs: dict[str, float]) -> DataFrame:
    """Per bucket: rate of a counter, newest value of a gauge, percentiles of summed histogram counts (ts_us, counts, one for each of bounds and one beyond); null where there is none."""
    bucket = bucket_us(F.col("ts_us"), step_s).alias("bucket")
    d = in_window(differences, start, end).groupBy(bucket).agg((F.coalesce(F.sum(f"d_{counter}"), F.lit(0)).cast("long") / step_s).alias("rate"), F.max_by(F.col(gauge).cast("double"), "ts_us").alias("gauge"))
    size = len(bounds) + 1
    sums = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(size)])
    h = in_window(histograms, start, end).where(F.size("counts") == size).groupBy(bucket).agg(sums.alias("counts"))
    h = h.select("bucket", *[hist_percentile(F.col("counts"), q, F.array(*[F.lit(float(b)) for b in bounds])).alias(n) for n, q in qs.items()])
    return filled(d.join(h, "bucket", "left"), start, end, step_s)
