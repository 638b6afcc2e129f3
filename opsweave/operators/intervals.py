"""Concurrency from request intervals, by sweeps that no task does alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SECOND, WORK, bucket_us, ratio
from . import ordered, shared


def overlap_segments(intervals: DataFrame, start: int, end: int, edge_s: int = 3600) -> DataFrame:
    """t0, t1, level: how many intervals (started_us, ts_us) are open, in disjoint segments over the window.

    Changes are netted per time, so an end and a start at one time cancel. Two levels: net changes per coarse bucket are summed
    over buckets (few rows), and each bucket is swept from the level it starts with; every bucket's edge has a row, so that no time is lost.
    """
    i = intervals.where("started_us is not null and ts_us is not null")
    a, b = F.greatest(F.col("started_us"), F.lit(start)), F.least(F.col("ts_us"), F.lit(end))
    i = i.select(a.cast("long").alias("a"), b.cast("long").alias("b")).where("a < b")
    change = i.select(F.inline(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d"))))).groupBy("t").agg(F.sum("d").alias("d"))
    change = change.withColumn("bucket", bucket_us(F.col("t"), edge_s))
    step = edge_s * SECOND
    edges = intervals.sparkSession.range(start // step, end // step + 1).select((F.col("id") * step).alias("bucket"))
    nets = edges.join(change.groupBy("bucket").agg(F.sum("d").alias("net")), "bucket", "left").fillna(0, ["net"])
    carried = nets.select("bucket", F.coalesce(F.sum("net").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    rows = change.select("bucket", "t", "d").unionByName(carried.select("bucket", F.greatest(F.col("bucket"), F.lit(start)).alias("t"), F.lit(0).cast("long").alias("d")))
    rows = rows.groupBy("bucket", "t").agg(F.sum("d").alias("d")).join(carried, "bucket")
    inside = Window.partitionBy("bucket").orderBy("t")
    level = F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("carry")
    stop = F.coalesce(F.lead("t").over(inside), F.least(F.col("bucket") + step, F.lit(end)))
    return rows.select(F.col("t").alias("t0"), stop.alias("t1"), level.cast("long").alias("level")).where("t0 < t1")


def worked(requests: DataFrame, start: int, end: int) -> DataFrame:
    """Requests that were open in the window, with a known start."""
    return requests.where(F.col("class").isin(*WORK) & (F.col("ts_us") >= start) & (F.col("started_us") < end))


def concurrency(requests: DataFrame, start: int, end: int, slots: int | None = None) -> DataFrame:
    """Peak, time-weighted mean over the whole window, busy seconds; utilisation and saturation where slots are known."""
    span = (end - start) / SECOND
    s = overlap_segments(worked(requests, start, end), start, end)
    seconds = (F.col("t1") - F.col("t0")) / SECOND
    row = s.agg(
        F.coalesce(F.max("level"), F.lit(0)).alias("peak"),
        (F.coalesce(F.sum(seconds * F.col("level")), F.lit(0.0)) / span).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("level") > 0, seconds)), F.lit(0.0)).alias("busy_s"),
        F.coalesce(F.sum(F.when(F.col("level") >= (slots or 0), seconds)), F.lit(0.0)).alias("full_s"),
    )
    known = slots is not None and slots > 0
    return row.select(
        "peak",
        "mean",
        "busy_s",
        F.lit(slots).cast("long").alias("slots"),
        (F.col("mean") / F.lit(slots) if known else F.lit(None).cast("double")).alias("utilisation"),
        (F.col("full_s") if known else F.lit(None).cast("double")).alias("saturated_s"),
        (F.col("full_s") / span if known else F.lit(None).cast("double")).alias("saturated"),
    )


def capacity(samples: DataFrame, start: int, end: int) -> DataFrame:
    """slots, sampled_peak: the newest number of slots that a sample in the window tells, and its most requests in flight; one row."""
    s = samples.where((F.col("ts_us") >= start) & (F.col("ts_us") < end))
    return s.agg(F.max_by("slots", F.when(F.col("slots").isNotNull(), F.col("ts_us"))).alias("slots"), F.max("inflight").alias("sampled_peak"))


def concurrency_of_capacity(requests: DataFrame, samples: DataFrame, start: int, end: int) -> DataFrame:
    """As concurrency(), with the slots that samples (ts_us, slots, inflight) tell, and their peak."""
    span = (end - start) / SECOND
    known = capacity(samples, start, end)
    seconds = seconds_at_level(requests, start, end).join(F.broadcast(known.select("slots")), F.lit(True))  # one row
    row = seconds.agg(
        F.coalesce(F.max("level"), F.lit(0)).alias("peak"),
        (F.coalesce(F.sum(F.col("seconds") * F.col("level")), F.lit(0.0)) / span).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("level") >= F.col("slots"), F.col("seconds"))), F.lit(0.0)).alias("full_s"),
    )
    some = F.col("slots") > 0
    return row.join(F.broadcast(known), F.lit(True)).select(
        "peak", "mean", "slots", F.when(some, F.col("mean") / F.col("slots")).alias("utilisation"), F.when(some, F.col("full_s")).alias("saturated_s"), F.when(some, F.col("full_s") / span).alias("saturated"), "sampled_peak"
    )


def seconds_at_level(requests: DataFrame, start: int, end: int) -> DataFrame:
    """Seconds of the window at each level above 0."""
    s = overlap_segments(worked(requests, start, end), start, end)
    return s.where("level > 0").groupBy("level").agg((F.sum(F.col("t1") - F.col("t0")) / SECOND).alias("seconds"))


def concurrency_series(requests: DataFrame, start: int, end: int, step_s: int) -> DataFrame:
    """Mean and peak level per bucket; segments are split at bucket edges; buckets without any request stay null."""
    step = step_s * SECOND
    s = overlap_segments(worked(requests, start, end), start, end).where("level > 0")
    s = s.withColumn("bucket", F.explode(F.sequence(bucket_us(F.col("t0"), step_s), bucket_us(F.col("t1") - 1, step_s), F.lit(step).cast("long"))))
    part = (F.least(F.col("t1"), F.col("bucket") + step) - F.greatest(F.col("t0"), F.col("bucket"))) / SECOND
    from .series import filled

    return filled(s.groupBy("bucket").agg((F.sum(part * F.col("level")) / step_s).alias("mean"), F.max("level").alias("peak")), start, end, step_s)


def sole_clients(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """id, client: requests during which every sample time showed exactly one client, always the same; and samples, how many times: at least one.

    Sample times are numbered, and each knows since when its client was the only one. The last time up to a request's end then tells whether
    another client was there since its start, and only for those where none was, the last time before their start tells how many there were: no
    request meets each sample within it.
    """
    us, hour = F.col("ts_us"), 3600 * SECOND
    at = shared.written(samples.where("ts_us is not null").groupBy("source", "ts_us").agg(F.min("client").alias("lo"), F.max("client").alias("hi")))
    some = F.struct("ts_us", "lo", "hi")
    at = shared.written(ordered.running(at, {"n": ("sum", F.lit(1), True), "prev": ("max", F.when(F.col("lo").isNotNull(), some), False)}, order="ts_us", part=hour))
    kept = (F.col("lo") == F.col("hi")) & (F.col("prev.lo") == F.col("prev.hi")) & (F.col("lo") == F.col("prev.lo"))
    begins = F.col("lo").isNotNull() & ~F.coalesce(kept, F.lit(False))
    at = ordered.running(at, {"since": ("max", F.when(begins, F.struct("ts_us", F.col("prev.ts_us").alias("other_us"))), True)}, order="ts_us", part=hour)
    last = F.when(F.col("lo").isNotNull(), some).otherwise(F.col("prev"))
    at = shared.written(at.select("source", us.alias("at"), "n", last.alias("last"), F.col("since.other_us").alias("other_us")))
    r = shared.written(requests.where("started_us <= ts_us").select("id", "source", F.col("started_us").alias("a"), us.alias("at")))
    r = ordered.asof(r, at, F.struct("n", "last", "other_us"), "told", by="at", part=hour, levels=1)
    alone = r.where("told.last.lo = told.last.hi and told.last.ts_us >= a and (told.other_us is null or told.other_us < a)")
    alone = alone.select("id", "source", F.col("told.last.lo").alias("client"), F.col("told.n").alias("upto"), (F.col("a") - 1).alias("at"))
    alone = ordered.asof(alone, at, F.col("n"), "before", by="at", part=hour, levels=1)
    return alone.select("id", "client", (F.col("upto") - F.coalesce("before", F.lit(0))).alias("samples"))


def by_connected_client(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Presence of each client: share of the sample times of its source, most connections, first and last seen."""
    s = samples.where((F.col("ts_us") >= start) & (F.col("ts_us") < end))
    times = s.groupBy("source").agg(F.count_distinct("ts_us").alias("times"))
    c = s.groupBy("source", "client").agg(F.count_distinct("ts_us").alias("seen"), F.max("conns").alias("peak"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return c.join(times, "source").select("source", "client", "seen", "peak", "first_us", "last_us", ratio(F.col("seen"), F.col("times")).alias("presence"))
