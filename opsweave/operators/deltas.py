"""Differences of cumulative scrapes: counters and histograms that restart.

Scrapes are long rows (source, ts_us, scrape, metric, labels, kind, value) with kind counter, gauge or bucket (label le split off as a
bound, null for infinity). Any counter of a scrape that falls, or a new start time, drops all differences of that interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SECOND, bucket_us, hist_percentile
from . import ordered


def counter_deltas(scrapes: DataFrame, counters: list[str], started: str | None = None, part: int = ordered.PART) -> DataFrame:
    """Wide scrapes (source, ts_us, n, ...) with d_<counter> and seconds since the scrape before; null at restarts and at the first.

    A restart of any counter clears the differences of all; so does another value in started, a column of start times or run numbers,
    than the last one known. n is a whole number, unique in a source; rows are read in parts of n, each with the scrape before it.
    """
    prior = {"__prior": ("max", F.struct("n", "ts_us", *[F.col(c).alias(f"c{i}") for i, c in enumerate(counters)]), False)}
    if started is not None:
        prior["__known"] = ("max", F.when(F.col(started).isNotNull(), F.struct("n", F.col(started).alias("of"))), False)
    before = {c: F.col(f"__prior.c{i}") for i, c in enumerate(counters)}
    fell = F.lit(False)
    for c in counters:
        fell = fell | F.coalesce(F.col(c) < before[c], F.lit(False))
    if started is not None:
        fell = fell | F.coalesce(F.col(started) != F.col("__known.of"), F.lit(False))
    d = ordered.running(scrapes, prior, order="n", part=part)
    d = d.withColumn("restart", fell).withColumn("seconds", (F.col("ts_us") - F.col("__prior.ts_us")) / SECOND)
    return d.select(*scrapes.columns, "restart", "seconds", *[F.when(~F.col("restart"), F.col(c) - before[c]).alias(f"d_{c}") for c in counters])


def histogram_deltas(scrapes: DataFrame, cumulative: list[str], started: str | None = None) -> DataFrame:
    """Wide scrapes with counts: what each bucket gained since the scrape before, from cumulative buckets; null at restarts."""
    d = counter_deltas(scrapes, cumulative, started)
    gained = [F.col(f"d_{c}") for c in cumulative]
    own = F.array(*[g - (gained[i - 1] if i else F.lit(0)) for i, g in enumerate(gained)])
    return d.withColumn("counts", F.when(gained[0].isNotNull() & ~F.exists(own, lambda x: x < 0), own))


def minute_counters(deltas: DataFrame, counter: str, step_s: int = 60) -> DataFrame:
    """Sum and rate of a counter's differences per source and minute; a difference belongs to the minute of the later scrape."""
    d = deltas.where(F.col(f"d_{counter}").isNotNull())
    return d.groupBy("source", bucket_us(F.col("ts_us"), step_s).alias("bucket")).agg(F.sum(f"d_{counter}").alias("total"), (F.sum(f"d_{counter}") / step_s).alias("rate"))


def minute_gauges(scrapes: DataFrame, gauge: str, step_s: int = 60) -> DataFrame:
    """Mean of a gauge per source and minute, and a row named max where the largest value differs from the smallest."""
    g = scrapes.groupBy("source", bucket_us(F.col("ts_us"), step_s).alias("bucket")).agg(F.avg(gauge).alias("mean"), F.min(gauge).alias("low"), F.max(gauge).alias("high"))
    both = F.array(F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value")), F.struct(F.lit("max").alias("metric"), F.when(F.col("high") != F.col("low"), F.col("high")).alias("value")))
    return g.select("source", "bucket", F.inline(both)).where(F.col("value").isNotNull())


def minute_histograms(deltas: DataFrame, step_s: int = 60, layout: str | None = None) -> DataFrame:
    """Element-wise sums of histogram differences per source and minute.

    layout: a column that names the bounds. Where it changes within a minute, only the run of equal layouts seen last counts.
    """
    d = deltas.where(F.col("counts").isNotNull()).withColumn("bucket", bucket_us(F.col("ts_us"), step_s))
    keys = ["source", "bucket"]
    if layout:
        w = Window.partitionBy("source", "bucket").orderBy("ts_us", "n")
        new = F.coalesce(F.lag(layout).over(w) != F.col(layout), F.lit(False)).cast("int")
        d = d.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.withColumn("last", F.max("run").over(Window.partitionBy("source", "bucket"))).where("run = last")
        keys.append(layout)
    each = d.select(*keys, F.posexplode("counts").alias("i", "c")).groupBy(*keys, "i").agg(F.sum("c").alias("c"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("counts"))


def histogram_range(rows: DataFrame, start: int, end: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum over a window of histograms with bounds of their own (ts_us, bounds, counts, observations, sum_value).

    The layout of the first valid row counts; rows with another, or with counts that don't fit their bounds, are counted in
    rows_skipped. The mean is exact, percentiles are upper bounds.
    """
    r = rows.where((F.col("ts_us") >= start) & (F.col("ts_us") < end)).withColumn("valid", F.coalesce(F.size("bounds") == F.size("counts"), F.lit(False)) & (F.size("bounds") > 0))
    first = r.groupBy(*keys).agg(F.min_by(F.when(F.col("valid"), F.col("bounds")), F.when(F.col("valid"), F.col("ts_us"))).alias("canonical"))
    j = r.join(first, [*keys]) if keys else r.crossJoin(F.broadcast(first))
    j = j.withColumn("ok", F.col("valid") & F.coalesce(F.to_json("bounds") == F.to_json("canonical"), F.lit(False)))
    totals = j.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("rows_skipped"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("observations"))), F.lit(0)).alias("observations"), F.sum(F.when(F.col("ok"), F.col("sum_value"))).alias("sum_value"), F.any_value("canonical").alias("bounds"))
    each = j.where("ok").select(*keys, F.posexplode("counts").alias("i", "c")).groupBy(*keys, "i").agg(F.sum("c").alias("c"))
    counts = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("counts"))
    out = totals.join(counts, [*keys], "left") if keys else totals.join(counts, F.lit(True), "left")
    mean = F.col("sum_value") / F.nullif(F.col("observations").cast("double"), F.lit(0.0))
    return out.withColumn("mean", mean).select("*", *[hist_percentile(F.col("counts"), q, F.col("bounds")).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


def counter_total(minutes: DataFrame, start: int, end: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of a counter in a window; 0 if there is nothing."""
    m = minutes.where((F.col("bucket") >= start) & (F.col("bucket") < end))
    return m.groupBy(*keys).agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))


def first_with_data(histograms: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Of several names for one metric, the first with observations."""
    order = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    h = histograms.where(F.col("observations") > 0).withColumn("p", order[F.col("metric")]).where("p is not null")
    return h.groupBy().agg(F.min_by("metric", "p").alias("metric")).where("metric is not null")
