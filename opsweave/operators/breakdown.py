"""Breakdowns and top rows of a window. Ties are ordered by key columns, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import WORK, named, ratio
from .percentiles import exact_percentiles
from .summary import in_window

_TOKENS = ("prompt_tokens", "output_tokens", "cached_tokens")


def by_model(requests: DataFrame, start: int, end: int) -> DataFrame:
    """Requests, errors, tokens and mean times of each model; a null model is a row of its own."""
    r = in_window(requests, start, end).where(F.col("class").isin(*WORK))
    return r.groupBy(F.coalesce("model", F.lit("(unattributed)")).alias("model")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _TOKENS],
        F.avg("ttft_ms").alias("ttft_mean_ms"),
        F.avg("latency_ms").alias("latency_mean_ms"),
        F.max("ts_us").alias("last_us"),
    )


def engine_by_model(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Engine requests of each model, unknown where it is null."""
    r = in_window(rows, start, end)
    return r.groupBy(named("model").alias("model")).agg(F.count("*").alias("requests"), F.avg("ttft_ms").alias("ttft_ms"), F.avg("decode_tps").alias("decode_tps"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"), F.max("ts_us").alias("last_us"))


def images_by_model(generations: DataFrame, start: int, end: int) -> DataFrame:
    """Finished generations of each model: durations and share of errors."""
    g = in_window(generations, start, end).where("status != 'running'")
    return g.groupBy(named("model").alias("model")).agg(F.count("*").alias("generations"), F.avg("total_ms").alias("mean_ms"), F.min("total_ms").alias("min_ms"), F.max("total_ms").alias("max_ms"), ratio(F.count_if(F.col("status") == "error"), F.count("*")).alias("error_rate"))


def by_endpoint(requests: DataFrame, start: int, end: int, k: int = 50) -> DataFrame:
    """Counts of endpoints and classes, the k most frequent."""
    r = in_window(requests, start, end).groupBy("endpoint", "class").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
    return r.orderBy(F.desc("requests"), "endpoint", "class").limit(k)


def by_client(requests: DataFrame, start: int, end: int, k: int = 50) -> DataFrame:
    """The k busiest clients: counts, tokens, largest share of a context in any one request, times, models by frequency."""
    r = in_window(requests, start, end).where(F.col("class").isin(*WORK))
    mix = r.where(F.col("model").isNotNull()).groupBy("client_ip", "model").agg(F.count("*").alias("n"))
    mix = mix.groupBy("client_ip").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "model"))).alias("m")).select("client_ip", F.array_join(F.transform("m", lambda x: x["model"]), ",").alias("models"))
    c = r.groupBy("client_ip").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.count_if(F.col("model").isNull()).alias("unattributed"),
        F.count_distinct("model").alias("distinct_models"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _TOKENS],
        F.max(ratio(F.col("prompt_tokens"), F.col("n_ctx_slot"))).alias("peak_context"),
        F.avg("ttft_ms").alias("ttft_ms"),
        F.avg("latency_ms").alias("latency_ms"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    return c.orderBy(F.desc("requests"), "client_ip").limit(k).join(mix, "client_ip", "left")


def top_model_by_client(requests: DataFrame, start: int, end: int) -> DataFrame:
    """The most frequent known model of each client; ties to the smaller name."""
    n = in_window(requests, start, end).where(F.col("model").isNotNull()).groupBy("client_ip", "model").agg(F.count("*").alias("n"))
    first = n.groupBy("client_ip").agg(F.min(F.struct((-F.col("n")).alias("n"), "model")).alias("x"))
    return first.select("client_ip", F.col("x.model").alias("top_model"), (-F.col("x.n")).alias("requests"))


def by_proxy_client(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Proxy clients: prompts, messages, streamed and unsized requests, largest share of the context limit."""
    r = in_window(rows, start, end)
    return r.groupBy("client").agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.avg("prompt_tokens").alias("prompt_mean"),
        F.max("prompt_tokens").alias("prompt_max"),
        F.avg("messages").alias("messages_mean"),
        F.count_if(F.col("stream")).alias("streamed"),
        F.count_if(F.col("prompt_tokens").isNull()).alias("unsized"),
        F.max(ratio(F.col("prompt_tokens"), F.col("context_limit"))).alias("peak_share"),
        F.max("ts_us").alias("last_us"),
    )


def counts_by(rows: DataFrame, start: int, end: int, *keys: str) -> DataFrame:
    """Counts by columns, unknown where one is null: status by class, finish reasons, kinds of events."""
    return in_window(rows, start, end).groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def failure_report(generations: DataFrame, start: int, end: int, k: int = 10) -> dict[str, DataFrame]:
    """Failed generations by type (the k most frequent), and the failures themselves, newest first."""
    failed = in_window(generations, start, end).where("status = 'error'")
    kinds = failed.groupBy(named("error_type").alias("error_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(k)
    return {"kinds": kinds, "recent": top_rows(failed, "ts_us", k, "prompt_id")}


def by_concurrency(samples: DataFrame, level: str, value: str) -> DataFrame:
    """Samples by level: number, mean and largest value, and mean per running unit."""
    s = samples.where(F.col(level) > 0)
    return s.groupBy(level).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"), (F.avg(value) / F.col(level)).alias("per_unit"))


def top_rows(rows: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the largest non-null value: slowest requests, recent rows, recent errors."""
    return rows.where(F.col(by).isNotNull()).orderBy(F.desc(by), *ties).limit(k)


def clients_with_percentiles(requests: DataFrame, start: int, end: int) -> DataFrame:
    """Median time to the first token of each client, exact (rule B)."""
    return exact_percentiles(in_window(requests, start, end), ["client_ip"], "ttft_ms", {"ttft_p50": 0.5, "ttft_p90": 0.9}, "linear")


def model_names(rollup: DataFrame, since: int) -> DataFrame:
    """Names of models with rows since a time, without the empty one."""
    return rollup.where((F.col("bucket") >= since) & (F.col("model") != "")).select("model").distinct()
