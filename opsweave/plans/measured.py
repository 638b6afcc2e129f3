"""Queries of further measures, over all days of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deltas, intervals, measures, rollups, series
from .catalog import ALL, FELL, HISTS, LAGS, QS3, _counts, _round, grid, query, rank_sql
from .fixtures import VIEWS
from .logs import engine_rows

#: January 2024, in which all events lie, and forty years, in which all orders lie.
START, END, FIRST, LAST = 1_704_067_200_000_000, 1_706_745_600_000_000, 631_152_000_000_000, 1_893_456_000_000_000
VIEWS["measured"] = "select *, ttft_ms / 3 as decode_ms, cast(case when k % 4 > 0 then k * 1.5 end as double) as queue_ms, prompt_tokens + output_tokens as context_tokens from {requests}"
VIEWS["slot_samples"] = "select ts_us, source, case when k % 3 > 0 then 1 + k % 4 end as slots, k % 9 as inflight from {requests}"
VIEWS["image_events"] = "select ts_us, source, case k % 4 when 0 then 'generation_finished' when 1 then 'webapi_error' when 2 then 'backend_stderr' else 'backend_up' end as kind, k * 1.0 as prep_ms, k * 2.0 as gen_ms from {requests}"
WORK = "class in ('inference','embed')"
_SUMS = "case when sum(decode_ms) > 0 then sum(output_tokens)/(sum(decode_ms)/1000) end"

query("a1_request_measures", f"""with r as (select * from {{measured}} where {WORK}), p as ({rank_sql("select queue_ms as v from r", "", {"queue_ms_p90": 0.9})})
select round(max(d),6) as decode_tps_mean, round(max(q),6) as queue_ms_mean, max(l) as latency_max_ms, round(max(cm),6) as ctx_mean, max(cx) as ctx_max, max(cn) as ctx_n, any_value(cast(queue_ms_p90 as double)) as queue_ms_p90
from (select {_SUMS} as d, avg(queue_ms) as q, max(latency_ms) as l, avg(f) as cm, max(f) as cx, count(f) as cn from (select *, case when context_tokens > 0 and n_ctx_slot > 0 then context_tokens / n_ctx_slot end as f from r) y) x, p""")(
    lambda t: _round(measures.request_measures(t("measured"), START, END), 6, "decode_tps_mean", "queue_ms_mean", "ctx_mean").withColumn("queue_ms_p90", F.col("queue_ms_p90").cast("double"))
)
query("r1_rollup_measures", f"select round({_SUMS},6) as decode_tps_mean, round(avg(queue_ms),6) as queue_ms_mean, max(latency_ms) as latency_max_ms from {{measured}} where {WORK}")(
    lambda t: _round(measures.rollup_measures(rollups.coarsen(rollups.build_rollup(t("measured"), 60), 3600), START, END), 6, "decode_tps_mean", "queue_ms_mean")
)
query("w5_measure_series", f"""with r as (select cast(floor(ts_us/10800000000) as bigint)*10800000000 as bucket, {_SUMS} as decode_tps, avg(queue_ms) as queue_ms from {{measured}} where {WORK} group by 1)
select g.bucket, round(decode_tps,6) as decode_tps, round(queue_ms,6) as queue_ms from {grid(START, END, 10800)} g left join r on r.bucket = g.bucket""")(lambda t: _round(measures.request_measure_series(t("measured"), START, END, 10800), 6, "decode_tps", "queue_ms"))
query("b1_rollup_by_model", f"""select coalesce(model,'(unattributed)') as model, count(*) as requests, count(*) filter (where status >= 400) as errors, cast(coalesce(sum(prompt_tokens),0) as bigint) as prompt_tokens, cast(coalesce(sum(output_tokens),0) as bigint) as output_tokens, cast(coalesce(sum(cached_tokens),0) as bigint) as cached_tokens,
 round(avg(ttft_ms),6) as ttft_mean_ms, round(avg(latency_ms),6) as latency_mean_ms, round({_SUMS},6) as decode_tps, cast(max(ts_us) // 3600000000 * 3600000000 as bigint) as last_bucket from {{measured}} where {WORK} group by 1""")(
    lambda t: _round(measures.rollup_by_model(rollups.build_rollup(t("measured"), 3600), START, END), 6, "ttft_mean_ms", "latency_mean_ms", "decode_tps")
)


def drafted(t) -> DataFrame:
    """Engine N's requests as if it drafted: every third of those that were done accepted a share."""
    r = engine_rows(t).withColumn("draft_accept", F.when(F.col("req_id") % 3 == 0, (F.col("req_id") % 10) / 10.0))
    return r.withColumn("kind", F.when((F.col("kind") == "error") & (F.col("req_id") % 2 == 0), "disconnect").otherwise(F.col("kind")))


def _engine_sql() -> str:
    from .logs import PAIRS

    return PAIRS + f""", r as (select * from pairs), pc as ({rank_sql("select latency_ms as v from r", "", {"latency_p50": 0.5, "latency_p90": 0.9, "latency_p99": 0.99}, "linear")})
select round(avg(case when req_id % 3 = 0 then (req_id % 10) / 10.0 end),6) as draft_accept_mean, count(*) filter (where kind = 'error' and req_id % 2 = 0) as disconnected, max(ttft_ms) as ttft_max_ms, any_value(latency_p50) as latency_p50, any_value(latency_p90) as latency_p90, any_value(latency_p99) as latency_p99 from r, pc"""


query("a2_engine_measures", _engine_sql())(lambda t: _round(measures.engine_measures(drafted(t), 0, 1 << 62), 6, "draft_accept_mean"))
query("a4_image_measures", f"""select (select count(*) filter (where status in ('success','error')) / {(LAST - FIRST) / 3.6e9} from {{image_generations}}) as gen_per_hour, count(*) filter (where k = 0) as timed, round(avg(case when k = 0 then p end),6) as prep_ms_mean, max(case when k = 0 then p end) as prep_ms_max,
 round(avg(case when k = 0 then g end),6) as gen_ms_mean, count(*) filter (where k = 1) as webapi_errors, count(*) filter (where k = 2) as backend_stderr, count(*) filter (where k = 3) as backend_restarts from (select k % 4 as k, cast(prep_ms as double) as p, cast(gen_ms as double) as g from (select e.*, case kind when 'generation_finished' then 0 when 'webapi_error' then 1 when 'backend_stderr' then 2 else 3 end as k from {{image_events}} e) y) x""")(
    lambda t: _round(measures.image_measures(t("image_generations"), t("image_events").withColumn("ts_us", F.col("ts_us") - START + FIRST).withColumns({c: F.col(c).cast("double") for c in ("prep_ms", "gen_ms")}), FIRST, LAST), 6, "prep_ms_mean", "gen_ms_mean")
)
_SAMPLES = "select ts_us, case when k % 2 = 0 then 8192.0 + id end as limit_mib, case when k % 2 = 0 then 65536 + id end as token_limit, case when k % 5 > 0 then 32 + id % 3 end as ckpt_total, k % 33 as ckpt_used, k % 3 as evictions, k % 2 as evict_crowded, 1 - k % 2 as evict_invalidated, k % 4 as restores, 1 as ckpt_created, k % 6 as saves, case when k % 7 > 0 then k * 0.25 end as update_ms"
query("a5_cache_measures", f"""with s as ({_SAMPLES}, id from {{requests}}) select cast((select limit_mib from s where limit_mib is not null order by ts_us desc limit 1) as double) as limit_mib, (select token_limit from s where token_limit is not null order by ts_us desc limit 1) as token_limit, (select ckpt_total from s where ckpt_total is not null order by ts_us desc limit 1) as ckpt_total,
 max(ckpt_used) as ckpt_peak, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('evictions', 'evict_crowded', 'evict_invalidated', 'restores', 'ckpt_created', 'saves'))}, round(avg(cast(update_ms as double)),6) as update_ms_mean, max(cast(update_ms as double)) as update_ms_max from s""")(
    lambda t: _round(measures.cache_measures(t("requests").selectExpr(*[c.strip() for c in _SAMPLES[7:].split(", ")]).withColumns({c: F.col(c).cast("double") for c in ("limit_mib", "update_ms")}), START, END), 6, "update_ms_mean")
)
query("g3_slots_per_bucket", f"select g.bucket, s.slots from {grid(START, END, 10800)} g left join (select cast(floor(ts_us/10800000000) as bigint)*10800000000 as bucket, max_by(slots, ts_us) as slots from {{slot_samples}} where slots is not null group by 1) s on s.bucket = g.bucket")(
    lambda t: measures.concurrency_and_slots(t("requests"), t("slot_samples"), START, END, 10800).select("bucket", "slots")
)
_LEVELS = f"with e as (select greatest(started_us, {START}) as t, 1 as d from {{requests}} where {WORK} and started_us < ts_us and ts_us > {START} and started_us < {END} union all select least(ts_us, {END}), -1 from {{requests}} where {WORK} and started_us < ts_us and ts_us > {START} and started_us < {END}), n as (select t, sum(d) as d from e group by 1), l as (select t, sum(d) over (order by t) as level, lead(t) over (order by t) as u from n), c as (select (select slots from {{slot_samples}} where slots is not null order by ts_us desc limit 1) as slots, max(inflight) as sampled_peak from {{slot_samples}})"
query("j9_saturation", _LEVELS + f" select cast(max(level) as bigint) as peak, any_value(slots) as slots, round(sum(case when level >= slots then (u - t)/1e6 else 0 end),3) as saturated_s, any_value(sampled_peak) as sampled_peak from l, c where u is not null and level > 0")(
    lambda t: intervals.concurrency_of_capacity(t("requests"), t("slot_samples"), START, END).select(F.col("peak").cast("long").alias("peak"), "slots", F.round("saturated_s", 3).alias("saturated_s"), "sampled_peak")
)



def _rows(t) -> DataFrame:
    bounds = F.array(F.lit(60.0), F.lit(120.0), F.lit(240.0), F.lit(None).cast("double"))
    return _counts(t).where("counts is not null").select("ts_us", bounds.alias("bounds"), "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("observations"), (F.get("counts", F.lit(0)) * 30.0).alias("sum_value"))


_H = HISTS.replace("coalesce(counter < pc, false) or ", "")
_PICK = ", ".join(f"case when list_sum(k) > 0 then cast([60.0,120.0,240.0] as double[])[least(3, 1 + len(list_filter(range(1,5), lambda i: list_sum(k[1:i]) < {q} * list_sum(k))))] end as {n}" for n, q in QS3.items())
_SUM4 = "[sum(counts[1]), sum(counts[2]), sum(counts[3]), sum(counts[4])] as k"
query("a3_metrics", f"""with h as ({_H}), r as (select * from h where counts is not null), c as (select {_SUM4}, cast(sum(list_sum(counts)) as bigint) as observations, round(sum(counts[1]*30.0)/sum(list_sum(counts)),6) as mean from r),
 t as (select cast(coalesce(sum(counter - pc),0) as bigint) as total from (select *, {FELL} as restart from (select *, {LAGS}) a) b where not restart), g as (select round(avg(cast(gauge as double)),6) as gauge_mean, max(cast(gauge as double)) as gauge_max from {{scrapes}})
select total, round(total/{(END - START) / 1e6},9) as per_s, observations, mean, {_PICK}, gauge_mean, gauge_max, cast(0 as bigint) as rows_skipped from c, t, g""")(
    lambda t: _round(_round(measures.metric_summary(deltas.counter_deltas(t("scrapes"), ALL), _rows(t), "counter", "gauge", START, END), 6, "mean", "gauge_mean"), 9, "per_s")
)
query("w8_metric_percentiles", f"""with h as ({_H}), c as (select cast(floor(ts_us/10800000000) as bigint)*10800000000 as bucket, {_SUM4} from h where counts is not null group by 1),
 d as (select cast(floor(ts_us/10800000000) as bigint)*10800000000 as bucket, cast(coalesce(sum(case when not restart then counter - pc end),0) as bigint)/10800 as rate, max_by(cast(gauge as double), ts_us) as gauge from (select *, {FELL} as restart from (select *, {LAGS}) a) b group by 1)
select g.bucket, round(rate,6) as rate, gauge, {_PICK} from {grid(START, END, 10800)} g left join d on d.bucket = g.bucket left join c on c.bucket = g.bucket""")(
    lambda t: _round(measures.metric_series(deltas.counter_deltas(t("scrapes"), ALL), _counts(t).where("counts is not null"), "counter", "gauge", [60, 120, 240], START, END, 10800, QS3), 6, "rate")
)
query("w10_device_gauges", f"""with s as (select cast(floor(ts_us/86400000000) as bigint)*86400000000 as bucket, gpu_index, avg(cast(util_pct as double)) as util_pct, avg(cast(temp_c as double)) as temp_c, avg(cast(power_w as double)) as power_w, avg(cast(l_orderkey % 100 as double)) as bus_rx, avg(cast(l_orderkey % 7 as double)) as bus_tx, avg(cast(mem_used as double)) as mem_used from {{gpu_samples}} group by 1, 2)
select bucket, gpu_index, round(util_pct,6) as util_pct, round(temp_c,6) as temp_c, round(power_w,6) as power_w, round(bus_rx,6) as bus_rx, round(bus_tx,6) as bus_tx, round(mem_used,6) as mem_used from s""")(
    lambda t: _round(series.device_series(t("gpu_samples").selectExpr("ts_us", "gpu_index", *[f"cast({c} as double) as {n}" for c, n in (("util_pct", "util_pct"), ("temp_c", "temp_c"), ("power_w", "power_w"), ("mem_used", "mem_used"), ("l_orderkey % 100", "bus_rx"), ("l_orderkey % 7", "bus_tx"))]), FIRST, LAST, 86400, ("util_pct", "mem_used", "temp_c", "power_w", "bus_rx", "bus_tx")).where("util_pct is not null"), 6, "util_pct", "temp_c", "power_w", "bus_rx", "bus_tx", "mem_used")
)
