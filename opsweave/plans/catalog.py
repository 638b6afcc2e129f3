
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.exprs import BUCKETS, HIST_BOUNDS_MS
from ..operators import breakdown, deltas, intervals, rollups, series, summary, tables
from ..operators.percentiles import exact_percentiles
from .fixtures import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000_000
FIRST = 1_704_067_200_000_000  # 2024-01-01
START, END = FIRST, FIRST + 30 * DAY
A, B = FIRST + 9 * DAY, FIRST + 9 * DAY + DAY // 4  # a short window: raw rows, exact
W0, W1 = FIRST + 8 * DAY, FIRST + 13 * DAY  # a longer one: minute rollups
SHIP0, SHIP1 = 820_454_400_000_000, 820_454_400_000_000 + 30 * DAY  # January 1996, of the star tables
SHIP_START, SHIP_END = 788_918_400_000_000, 788_918_400_000_000 + 2500 * DAY  # 1995-01-01 to 2001-11-05: all order and ship dates
WORK = "class in ('inference','embed')"


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register f(tables) under name; tables(name) is a table of the given folder."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: view(spark, sf_dir, n))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return f

    return add


def windowed(register: Callable) -> Callable:
    """Register queries over the short windows and, those whose SQL names a window, as name_whole over whole tables."""

    def whole(name: str, sql: str) -> Callable[[Callable], Callable]:
        return (lambda f: f) if duck(sql) == ORACLES[name] else query(f"{name}_whole", sql)

    register(query, A, B, W0, W1, SHIP0, SHIP1)
    register(whole, START, END, START, END, SHIP_START, SHIP_END)
    return register


def hist_sql(column: str, where: str = "true") -> str:
    """The 22 counts of a histogram as a list."""
    low = [None, *HIST_BOUNDS_MS]
    parts = []
    for i in range(BUCKETS):
        cond = [f"{column} > {low[i]}"] if i else []
        cond += [f"{column} <= {HIST_BOUNDS_MS[i]}"] if i < len(HIST_BOUNDS_MS) else []
        parts.append(f"count(*) filter (where {' and '.join([column + ' is not null', where, *cond])})")
    return f"[{', '.join(parts)}]"


def rank_sql(values: str, keys: str, qs: dict[str, float], rule: str = "near") -> str:
    """Exact percentiles of v in the table expression values, by keys."""
    at = {"near": "least(n - 1, greatest(0, cast(round_even({q} * n + 0.5, 0) as bigint) - 1))", "linear": "cast(round_even({q} * (n - 1), 0) as bigint)"}[rule]
    by = f"partition by {keys}" if keys else ""
    picks = ", ".join(f"max(case when rn = 1 + {at.format(q=q)} then v end) as {name}" for name, q in qs.items())
    group = f" group by {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"select {head}max(n) as n, {picks} from (select *, row_number() over ({by} order by v) as rn, count(*) over ({by}) as n from ({values}) x where v is not null) y{group}"


def p_hist_sql(counts: str, q: float) -> str:
    """Percentile of the fixed histogram in a list of counts."""
    bounds = "cast([" + ", ".join(f"{float(b)}" for b in HIST_BOUNDS_MS) + "] as double[])"
    return f"case when list_sum({counts}) > 0 then {bounds}[least({len(HIST_BOUNDS_MS)}, 1 + len(list_filter(range(1, {BUCKETS + 1}), lambda i: list_sum({counts}[1:i]) < {q} * list_sum({counts}))))] end"


# Percentiles, histograms, rollups

QS3 = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
ROLL = f"""select cast(floor(ts_us/{{step}}) as bigint)*{{step}} as bucket, coalesce(model,'') as model, class, count(*) as req_count, count(*) filter (where status >= 400) as err_count,
  cast(coalesce(sum(prompt_tokens),0) as bigint) as in_tokens, cast(coalesce(sum(output_tokens),0) as bigint) as out_tokens, cast(coalesce(sum(cached_tokens),0) as bigint) as cached_tokens,
  coalesce(sum(ttft_ms),0) as ttft_sum, count(ttft_ms) as ttft_n, max(ttft_ms) as ttft_max, {hist_sql('ttft_ms')} as ttft_hist,
  coalesce(sum(latency_ms),0) as lat_sum, count(latency_ms) as lat_n, {hist_sql('latency_ms')} as lat_hist from {{{{requests}}}} group by 1, 2, 3"""


def roll_sql(step_s: int) -> str:
    return ROLL.format(step=step_s * 1_000_000)


def _rolled(df: DataFrame) -> DataFrame:
    """Rollups with rounded sums and histograms as text, to compare."""
    return df.withColumn("ttft_sum", F.round("ttft_sum", 3)).withColumn("lat_sum", F.round("lat_sum", 3)).withColumn("ttft_hist", F.array_join("ttft_hist", ",")).withColumn("lat_hist", F.array_join("lat_hist", ","))


_ROLLED = "select * replace (round(ttft_sum,3) as ttft_sum, round(lat_sum,3) as lat_sum, array_to_string(ttft_hist, ',') as ttft_hist, array_to_string(lat_hist, ',') as lat_hist) from ({0})"

query("r1_rollup_1m", _ROLLED.format(roll_sql(60)))(lambda t: _rolled(rollups.build_rollup(t("requests"), 60)))
query("r1_rollup_1h", _ROLLED.format(roll_sql(3600)))(lambda t: _rolled(rollups.build_rollup(t("requests"), 3600)))
query("r3_hour_from_minute", _ROLLED.format(roll_sql(3600)))(lambda t: _rolled(rollups.coarsen(rollups.build_rollup(t("requests"), 60), 3600)))
query("r2_refresh", _ROLLED.format(roll_sql(60)) + f" where bucket >= {(B - 900_000_000) // 60_000_000 * 60_000_000} and bucket <= {B // 60_000_000 * 60_000_000}")(lambda t: _rolled(rollups.build_rollup(rollups.touched_buckets(t("requests"), B - 900_000_000, B, 60), 60)))
query("r4_histogram_index", f"select id, case {' '.join(f'when ttft_ms <= {b} then {i}' for i, b in enumerate(HIST_BOUNDS_MS))} when ttft_ms is not null then {len(HIST_BOUNDS_MS)} end as idx from {{requests}}")(lambda t: t("requests").select("id", exprs.hist_index(F.col("ttft_ms")).cast("int").alias("idx")))
query("r5_histogram", f"select source, array_to_string({hist_sql('ttft_ms')}, ',') as hist from {{requests}} group by 1")(lambda t: t("requests").groupBy("source").agg(F.array_join(exprs.hist_counts(F.col("ttft_ms")), ",").alias("hist")))
query("r6_histogram_merge", f"select class, array_to_string({hist_sql('ttft_ms')}, ',') as hist from {{requests}} group by 1")(lambda t: rollups.merge_histograms(rollups.build_rollup(t("requests"), 3600), ["class"]).select("class", F.array_join("ttft_hist", ",").alias("hist")))
query("r7_histogram_percentile", f"select source, {', '.join(p_hist_sql('h', q) + f' as {n}' for n, q in QS3.items())} from (select source, {hist_sql('ttft_ms')} as h from {{requests}} group by 1) g")(
    lambda t: t("requests").groupBy("source").agg(exprs.hist_counts(F.col("ttft_ms")).alias("h")).select("source", *[exprs.hist_percentile(F.col("h"), q).alias(n) for n, q in QS3.items()])
)
query("r9_percentile_near", rank_sql("select source, ttft_ms as v from {requests}", "source", QS3))(lambda t: exact_percentiles(t("requests"), ["source"], "ttft_ms", QS3))
query("r10_percentile_linear", rank_sql("select model, class, latency_ms as v from {requests}", "model, class", QS3, "linear"))(lambda t: exact_percentiles(t("requests"), ["model", "class"], "latency_ms", QS3, "linear"))
query("r11_rank_one_group", rank_sql("select l_extendedprice as v from {lineitem}", "", {"p001": 0.001, **QS3}))(lambda t: exact_percentiles(t("lineitem"), [], "l_extendedprice", {"p001": 0.001, **QS3}))
query("r14_weighted_mean", "select source, round(sum(ttft_ms*output_tokens) filter (where ttft_ms is not null and output_tokens > 0) / sum(output_tokens) filter (where ttft_ms is not null and output_tokens > 0), 6) as mean from {requests} group by 1")(
    lambda t: summary.weighted_mean(t("requests"), ["source"], "ttft_ms", "output_tokens").withColumn("mean", F.round("mean", 6))
)

# What the windowed queries share

BUCKET = "cast(floor(ts_us/{s}) as bigint)*{s} as bucket"


def grid(start: int, end: int, step_s: int, clamped: bool = False) -> str:
    step = step_s * 1_000_000
    base = start // step * step
    n = (end - base) // step + 1 if clamped else (end - start) // step + 1
    return f"(select {base} + i*{step} as bucket from range({n}) t(i))"


TOK = ", ".join(f"cast(coalesce(sum({c}),0) as bigint) as {c}" for c in ("prompt_tokens", "output_tokens", "cached_tokens"))
def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


LAGS = "lag(counter) over w as pc, lag(le60) over w as p1, lag(le120) over w as p2, lag(le240) over w as p3, lag(le_inf) over w as p4, lag(ts_us) over w as pt from {scrapes} window w as (partition by source order by n)"
FELL = "coalesce(counter < pc, false) or coalesce(le60 < p1, false) or coalesce(le120 < p2, false) or coalesce(le240 < p3, false) or coalesce(le_inf < p4, false)"
ALL = ["counter", "le60", "le120", "le240", "le_inf"]
HISTS = f"select source, n, ts_us, case when list_min(c) >= 0 then c end as counts from (select source, n, ts_us, case when not ({FELL}) and p4 is not null then [cast(le60-p1 as bigint), cast(le120-p2-le60+p1 as bigint), cast(le240-p3-le120+p2 as bigint), cast(le_inf-p4-le240+p3 as bigint)] end as c from (select *, {LAGS}) a) b"


def _counts(t: Callable) -> DataFrame:
    return deltas.histogram_deltas(t("scrapes"), ["le60", "le120", "le240", "le_inf"])


MINUTES = f"select source, cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket, cast(sum(counter - pc) as bigint) as total from (select *, {FELL} as restart from (select *, {LAGS}) a) b where not restart and pc is not null group by 1, 2"
def _own_bounds(t: Callable) -> DataFrame:
    h = _counts(t).where("counts is not null")
    bounds = F.when(F.col("n") % 17 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(None).cast("double"))).otherwise(F.array(F.lit(60.0), F.lit(120.0), F.lit(240.0), F.lit(None).cast("double")))
    # The first layout of a window must not be the odd one.
    return h.select("source", (F.col("ts_us") + F.when(F.col("n") % 17 == 0, 0).otherwise(0)).alias("ts_us"), "n", bounds.alias("bounds"), "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("observations"), F.lit(0.0).alias("sum_value"))


@windowed
def _windowed(query: Callable, A: int, B: int, W0: int, W1: int, SHIP0: int, SHIP1: int) -> None:
    """Queries over windows: A..B exact from raw rows, W0..W1 longer, SHIP0..SHIP1 of the star tables."""

    # Summaries

    SUMMARY_RAW = f"""with r as (select * from {{requests}} where ts_us >= {A} and ts_us < {B}),
 s as (select count(*) filter (where {WORK}) as requests, count(*) as requests_all, count(*) filter (where {WORK} and status >= 400) as errors,
  cast(coalesce(sum(prompt_tokens) filter (where {WORK}),0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens) filter (where {WORK}),0) as bigint) as output_tokens,
  cast(coalesce(sum(cached_tokens) filter (where {WORK}),0) as bigint) as cached_tokens, max(ttft_ms) filter (where {WORK}) as ttft_max_ms,
  count(*) filter (where {WORK} and attribution in ('ambiguous','orphan','none')) as ambiguous_rows from r),
 t as ({rank_sql(f"select ttft_ms as v from r where {WORK}", "", {f"ttft_{k}": q for k, q in QS3.items()})}),
 l as ({rank_sql(f"select latency_ms as v from r where {WORK}", "", {f"latency_{k}": q for k, q in QS3.items()})})
select true as exact, s.*, t.* exclude (n), l.* exclude (n), requests/{(B - A) / 1e6} as req_per_s, coalesce(errors/nullif(requests,0),0) as error_rate,
  cached_tokens/nullif(cached_tokens+input_tokens,0) as cache_hit_rate, output_tokens/{(B - A) / 1e6} as out_tok_per_s, input_tokens/{(B - A) / 1e6} as in_tok_per_s from s, t, l"""
    query("a1_summary_raw", SUMMARY_RAW)(lambda t: summary.request_summary(t("requests"), A, B, grain="raw"))
    SUMMARY_ROLL = f"""with r as (select * from ({roll_sql(60)}) x where bucket >= {W0} and bucket < {W1}),
 h as (select {', '.join(f"coalesce(sum(ttft_hist[{i}]) filter (where {WORK}),0) as t{i}, coalesce(sum(lat_hist[{i}]) filter (where {WORK}),0) as l{i}" for i in range(1, BUCKETS + 1))} from r),
 s as (select cast(coalesce(sum(req_count) filter (where {WORK}),0) as bigint) as requests, cast(coalesce(sum(req_count),0) as bigint) as requests_all, cast(coalesce(sum(err_count) filter (where {WORK}),0) as bigint) as errors,
  cast(coalesce(sum(in_tokens) filter (where {WORK}),0) as bigint) as input_tokens, cast(coalesce(sum(out_tokens) filter (where {WORK}),0) as bigint) as output_tokens, cast(coalesce(sum(cached_tokens) filter (where {WORK}),0) as bigint) as cached_tokens,
  max(ttft_max) filter (where {WORK}) as ttft_max_ms, cast(null as bigint) as ambiguous_rows from r),
 p as (select [{', '.join(f't{i}' for i in range(1, BUCKETS + 1))}] as th, [{', '.join(f'l{i}' for i in range(1, BUCKETS + 1))}] as lh from h)
select false as exact, s.*, {', '.join(p_hist_sql('th', q) + f' as ttft_{n}' for n, q in QS3.items())}, {', '.join(p_hist_sql('lh', q) + f' as latency_{n}' for n, q in QS3.items())},
  requests/{(W1 - W0) / 1e6} as req_per_s, coalesce(errors/nullif(requests,0),0) as error_rate, cached_tokens/nullif(cached_tokens+input_tokens,0) as cache_hit_rate, output_tokens/{(W1 - W0) / 1e6} as out_tok_per_s, input_tokens/{(W1 - W0) / 1e6} as in_tok_per_s from s, p"""
    query("r12_a1_summary_rollup", SUMMARY_ROLL)(lambda t: summary.request_summary(t("requests"), W0, W1, grain="1m"))
    query("a1_context_usage", f"select round(avg(u),9) as mean, max(u) as max, count(u) as n from (select case when prompt_tokens > 0 and n_ctx_slot > 0 then (prompt_tokens+output_tokens)/n_ctx_slot end as u from {{requests}} where {WORK} and ts_us >= {W0} and ts_us < {W1}) x")(
        lambda t: summary.context_usage(t("requests"), W0, W1).withColumn("mean", F.round("mean", 9))
    )
    query("a4_image_summary", f"""with g as (select * from {{image_generations}} where ts_us >= {SHIP0} and ts_us < {SHIP1}), p as ({rank_sql("select total_ms as v from g", "", {"ms_p50": 0.5, "ms_p90": 0.9})})
select count(*) filter (where status <> 'running') as done, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'error') as errors, count(*) filter (where status = 'error')/count(*) filter (where status <> 'running') as error_rate,
 count(distinct model) as models, round(avg(total_ms),3) as mean_ms, max(total_ms) as max_ms, round(sum(total_ms)/{(SHIP1 - SHIP0) / 1000},9) as busy, any_value(p.ms_p50) as ms_p50, any_value(p.ms_p90) as ms_p90 from g, p""")(
        lambda t: summary.image_summary(t("image_generations"), SHIP0, SHIP1).withColumn("mean_ms", F.round("mean_ms", 3)).withColumn("busy", F.round("busy", 9))
    )
    query("a5_cache_summary", f"select round(avg(gauge),9) as mean, max(gauge) as max, max_by(gauge, ts_us) as last, count(*) as samples, max(gauge) >= 0.9 as pressure from {{scrapes}} where ts_us >= {W0} and ts_us < {W1}")(
        lambda t: summary.cache_summary(t("scrapes").select("ts_us", F.col("gauge").cast("double").alias("usage")), W0, W1).withColumn("mean", F.round("mean", 9))
    )
    query("a6_d10_d11_gauge_statistics", "select source, round(avg(gauge),9) as mean, cast(min(gauge) as double) as min, cast(max(gauge) as double) as max, cast(max_by(gauge, ts_us) as double) as last, count(gauge) as n from {scrapes} group by 1")(
        lambda t: summary.gauge_statistics(t("scrapes").withColumn("gauge", F.col("gauge").cast("double")), "gauge", ["source"]).withColumn("mean", F.round("mean", 9))
    )
    query("a7_j8_latest_per_source", "select source, n, cast(run as bigint) as run, cast(counter as bigint) as counter from {scrapes} qualify row_number() over (partition by source order by ts_us desc) = 1")(lambda t: tables.latest(t("scrapes"), ("source",), "ts_us").select("source", "n", "run", "counter"))
    query("a10_source_activity", "select source, max(ts_us) as last_us, count(*) as samples from {conn_samples} group by 1")(lambda t: t("conn_samples").groupBy("source").agg(F.max("ts_us").alias("last_us"), F.count("*").alias("samples")))
    query("a11_coverage", f"select min(ts_us) as oldest, coalesce(min(ts_us) <= {W0}, false) as complete from {{requests}}")(lambda t: summary.coverage(t("requests"), W0))
    query("a12_a13_table_statistics", "\nunion all\n".join(f"select '{n}' as \"table\", {s} as by_source, count(*) as rows, min(ts_us) as first, max(ts_us) as last from {{{n}}} where {w}" for n, s, w in (("requests", "true", "source = 's1'"), ("conn_samples", "true", "source = 's1'"), ("gpu_samples", "false", "true"))))(
        lambda t: summary.table_statistics({n: t(n) for n in ("requests", "conn_samples", "gpu_samples")}, "s1")
    )

    # Series

    SERIES = f"""with r as (select *, {BUCKET.format(s=900_000_000)} from {{requests}} where {WORK} and ts_us >= {A} and ts_us < {B}),
 s as (select bucket, count(*) as requests, count(*) filter (where status >= 400) as errors, coalesce(sum(output_tokens),0)/900 as o, coalesce(sum(prompt_tokens),0)/900 as i,
  cast(coalesce(sum(cached_tokens),0) as bigint)/nullif(coalesce(sum(cached_tokens),0)+coalesce(sum(prompt_tokens),0),0) as cache_hit_rate from r group by 1),
 p as ({rank_sql("select bucket, ttft_ms as v from r", "bucket", {f"ttft_{k}": q for k, q in QS3.items()})})
select g.bucket, coalesce(requests,0) as requests, coalesce(errors,0) as errors, coalesce(o,0) as out_tok_per_s, coalesce(i,0) as in_tok_per_s, cache_hit_rate, ttft_p50, ttft_p90, ttft_p99
from {grid(A, B, 900)} g left join s on s.bucket = g.bucket left join p on p.bucket = g.bucket"""
    query("w5_request_series", SERIES)(lambda t: series.request_series(t("requests"), A, B, 900))
    query("w5_rollup_series", f"""with r as (select cast(floor(bucket/{3600_000_000}) as bigint)*{3600_000_000} as b, * from ({roll_sql(60)}) x where {WORK} and bucket >= {W0} and bucket < {W1}),
 s as (select b, sum(req_count) as n, sum(err_count) as e, [{', '.join(f'sum(ttft_hist[{i}])' for i in range(1, BUCKETS + 1))}] as h from r group by 1)
select g.bucket, cast(coalesce(n,0) as bigint) as requests, cast(coalesce(e,0) as bigint) as errors, {p_hist_sql('h', 0.5)} as ttft_p50, {p_hist_sql('h', 0.99)} as ttft_p99 from {grid(W0, W1, 3600)} g left join s on s.b = g.bucket""")(
        lambda t: series.rollup_series(rollups.build_rollup(t("requests"), 60), W0, W1, 3600)
    )
    query("w9_cache_series", f"select g.bucket, round(avg(gauge),9) as usage, cast(max(gauge) as double) as peak from {grid(A, B, 1800)} g left join (select *, {BUCKET.format(s=1800_000_000)} from {{scrapes}} where ts_us >= {A} and ts_us < {B}) s on s.bucket = g.bucket group by 1")(
        lambda t: series.sample_series(t("scrapes").withColumn("gauge", F.col("gauge").cast("double")), A, B, 1800, {"usage": F.col("gauge")}, {"peak": F.col("gauge")}).withColumn("usage", F.round("usage", 9))
    )
    query("w10_device_series", f"""with s as (select *, {BUCKET.format(s=DAY)} from {{gpu_samples}} where ts_us >= {SHIP0} and ts_us < {SHIP1}), d as (select distinct gpu_index from s),
 m as (select bucket, gpu_index, avg(util_pct) as util_pct, avg(mem_used) as mem_used, avg(temp_c) as temp_c, avg(power_w) as power_w from s group by 1, 2)
select d.gpu_index, g.bucket, round(util_pct,6) as util_pct, round(mem_used,4) as mem_used, round(temp_c,6) as temp_c, round(power_w,6) as power_w from d cross join {grid(SHIP0, SHIP1, 86400)} g left join m on m.bucket = g.bucket and m.gpu_index = d.gpu_index""")(
        lambda t: series.device_series(t("gpu_samples"), SHIP0, SHIP1, 86400).select("gpu_index", "bucket", F.round("util_pct", 6).alias("util_pct"), F.round("mem_used", 4).alias("mem_used"), F.round("temp_c", 6).alias("temp_c"), F.round("power_w", 6).alias("power_w"))
    )
    query("w11_host_devices", f"""with s as (select *, {BUCKET.format(s=DAY)} from {{gpu_samples}} where ts_us >= {SHIP0} and ts_us < {SHIP1} and gpu_index in (1,2,3)),
 d as (select bucket, gpu_index, avg(util_pct) as u, avg(mem_used) as m, avg(power_w) as w from s group by 1, 2),
 h as (select bucket, gpu_index, temp_c as t from s where temp_c is not null qualify row_number() over (partition by bucket, gpu_index order by ts_us desc, l_orderkey desc, temp_c desc) = 1),
 x as (select d.bucket, avg(u) as u, sum(m) as m, sum(w) as w, max(t) as t from d left join h on h.bucket = d.bucket and h.gpu_index = d.gpu_index group by 1)
select g.bucket, round(u,6) as util_pct, round(m,4) as mem_used, round(w,6) as power_w, t as temp_c from {grid(SHIP0, SHIP1, 86400)} g left join x on x.bucket = g.bucket""")(
        lambda t: series.host_devices(t("gpu_samples"), [1, 2, 3], SHIP0, SHIP1, 86400, ("l_orderkey", "temp_c")).select("bucket", F.round("util_pct", 6).alias("util_pct"), F.round("mem_used", 4).alias("mem_used"), F.round("power_w", 6).alias("power_w"), "temp_c")
    )
    query("w12_w13_image_series", f"""with e as (select *, {BUCKET.format(s=DAY)} from {{image_generations}} where ts_us >= {SHIP0} and ts_us < {SHIP1}),
 a as (select bucket, count(*) filter (where status <> 'running')/24 as per_hour, count(*) filter (where status = 'error')/24 as errors_per_hour from e group by 1),
 p as ({rank_sql("select bucket, total_ms as v from e", "bucket", {"ms_p50": 0.5, "ms_p90": 0.9})}),
 k as (select ts_us, sum(queue_pending) as q, sum(vram_free) as f from {{image_samples}} where backend <> '' and ts_us >= {SHIP0} and ts_us < {SHIP1} group by 1),
 q as (select {BUCKET.format(s=DAY)}, avg(q) as queue, avg(f) as vram_free from k group by 1)
select g.bucket, coalesce(per_hour,0) as per_hour, coalesce(errors_per_hour,0) as errors_per_hour, ms_p50, ms_p90, round(queue,6) as queue, round(vram_free,2) as vram_free
from {grid(SHIP0, SHIP1, 86400)} g left join a on a.bucket = g.bucket left join p on p.bucket = g.bucket left join q on q.bucket = g.bucket""")(
        lambda t: series.image_series(t("image_generations"), t("image_samples"), SHIP0, SHIP1, 86400).withColumn("queue", F.round("queue", 6)).withColumn("vram_free", F.round("vram_free", 2))
    )

    # Breakdowns

    IN = f"ts_us >= {W0} and ts_us < {W1}"

    query("b1_by_model", f"select coalesce(model,'(unattributed)') as model, count(*) as requests, count(*) filter (where status >= 400) as errors, {TOK}, round(avg(ttft_ms),4) as ttft_mean_ms, round(avg(latency_ms),4) as latency_mean_ms, max(ts_us) as last_us from {{requests}} where {WORK} and {IN} group by 1")(
        lambda t: _round(breakdown.by_model(t("requests"), W0, W1), 4, "ttft_mean_ms", "latency_mean_ms")
    )
    query("b3_images_by_model", f"select model, count(*) as generations, round(avg(total_ms),3) as mean_ms, min(total_ms) as min_ms, max(total_ms) as max_ms, count(*) filter (where status = 'error')/count(*) as error_rate from {{image_generations}} where status <> 'running' and ts_us >= {SHIP0} and ts_us < {SHIP1} group by 1")(
        lambda t: _round(breakdown.images_by_model(t("image_generations"), SHIP0, SHIP1), 3, "mean_ms")
    )
    query("b4_by_endpoint", f"select endpoint, class, count(*) as requests, count(*) filter (where status >= 400) as errors from {{requests}} where {IN} group by 1, 2 order by 3 desc, 1, 2 limit 50")(lambda t: breakdown.by_endpoint(t("requests"), W0, W1))
    query("b5_j11_by_client", f"""with r as (select * from {{requests}} where {WORK} and {IN}),
 m as (select client_ip, string_agg(model, ',' order by n desc, model) as models from (select client_ip, model, count(*) as n from r where model is not null group by 1, 2) x group by 1),
 c as (select client_ip, count(*) as requests, count(*) filter (where status >= 400) as errors, count(*) filter (where model is null) as unattributed, count(distinct model) as distinct_models, {TOK},
  max(prompt_tokens/nullif(n_ctx_slot,0)) as peak_context, round(avg(ttft_ms),4) as ttft_ms, round(avg(latency_ms),4) as latency_ms, min(ts_us) as first_us, max(ts_us) as last_us from r group by 1 order by 2 desc, 1 limit 50)
select c.*, m.models from c left join m using (client_ip)""")(lambda t: _round(breakdown.by_client(t("requests"), W0, W1), 4, "ttft_ms", "latency_ms"))
    query("j12_top_model", f"select client_ip, model as top_model, n as requests from (select client_ip, model, count(*) as n from {{requests}} where model is not null and {IN} group by 1, 2) x qualify row_number() over (partition by client_ip order by n desc, model) = 1")(
        lambda t: breakdown.top_model_by_client(t("requests"), W0, W1)
    )
    query("b6_by_proxy_client", f"""select client_ip as client, count(*) as requests, cast(coalesce(sum(prompt_tokens),0) as bigint) as prompt_tokens, round(avg(prompt_tokens),6) as prompt_mean, max(prompt_tokens) as prompt_max, round(avg(1 + k % 9),6) as messages_mean,
  count(*) filter (where k % 2 = 0) as streamed, count(*) filter (where prompt_tokens is null) as unsized, max(prompt_tokens/nullif(n_ctx_slot,0)) as peak_share, max(ts_us) as last_us from {{requests}} where {IN} group by 1""")(
        lambda t: _round(breakdown.by_proxy_client(t("requests").select(F.col("client_ip").alias("client"), "prompt_tokens", (1 + F.col("k") % 9).alias("messages"), (F.col("k") % 2 == 0).alias("stream"), F.col("n_ctx_slot").alias("context_limit"), "ts_us"), W0, W1), 6, "prompt_mean", "messages_mean")
    )
    query("b8_status_by_class", f"select class, cast(status as varchar) as status, count(*) as n from {{requests}} where {IN} group by 1, 2")(lambda t: breakdown.counts_by(t("requests"), W0, W1, "class", "status"))
    query("b10_failure_kinds", f"select coalesce(error_type,'unknown') as error_type, count(*) as n from {{image_generations}} where status = 'error' and ts_us >= {SHIP0} and ts_us < {SHIP1} group by 1 order by 2 desc, 1 limit 10")(
        lambda t: breakdown.failure_report(t("image_generations"), SHIP0, SHIP1)["kinds"]
    )
    query("b11_by_concurrency", "select queue_pending, count(*) as n, round(avg(vram_free),2) as mean, max(vram_free) as peak, round(avg(vram_free)/queue_pending,2) as per_unit from {image_samples} where queue_pending > 0 group by 1")(
        lambda t: _round(breakdown.by_concurrency(t("image_samples"), "queue_pending", "vram_free"), 2, "mean", "per_unit")
    )
    query("b12_slowest", f"select id, ttft_ms, model from {{requests}} where ttft_ms is not null and {IN} order by ttft_ms desc, id limit 20")(lambda t: breakdown.top_rows(summary.in_window(t("requests"), W0, W1), "ttft_ms", 20, "id").select("id", "ttft_ms", "model"))
    query("b13_recent", "select id, ts_us, endpoint from {requests} where class <> 'health' order by ts_us desc, id limit 20")(lambda t: breakdown.top_rows(t("requests").where("class != 'health'"), "ts_us", 20, "id").select("id", "ts_us", "endpoint"))
    query("b14_recent_errors", "select id, ts_us, status from {requests} where status >= 400 order by ts_us desc, id limit 20")(lambda t: breakdown.top_rows(t("requests").where("status >= 400"), "ts_us", 20, "id").select("id", "ts_us", "status"))
    query("b15_recent_generations", "select prompt_id, ts_us, model from {image_generations} where status <> 'running' order by ts_us desc, prompt_id limit 20")(
        lambda t: breakdown.top_rows(t("image_generations").where("status != 'running'"), "ts_us", 20, "prompt_id").select("prompt_id", "ts_us", "model")
    )
    query("b16_events", "select event_id, event_type from {events} where event_type = 'error' order by ts desc, event_id limit 25")(lambda t: breakdown.top_rows(t("events").where("event_type = 'error'"), "ts", 25, "event_id").select("event_id", "event_type"))
    query("b17_model_names", f"select distinct model from {{requests}} where model is not null and ts_us >= {W0}")(lambda t: breakdown.model_names(rollups.build_rollup(t("requests"), 3600), W0))
    query("b18_any_row", "select count(*) > 0 as \"any\" from {conn_samples} where source = 's2'")(lambda t: t("conn_samples").where("source = 's2'").limit(1).agg((F.count("*") > 0).alias("any")))

    # Counters and histograms

    query("d1_d2_d4_counter_deltas", f"select source, n, restart, case when not restart then cast(counter - pc as bigint) end as d_counter, round(case when not restart then (counter - pc)/greatest((ts_us - pt)/1e6, 1e-6) end, 9) as rate from (select *, {FELL} as restart from (select *, {LAGS}) a) b")(
        lambda t: deltas.counter_deltas(t("scrapes"), ALL).select("source", "n", "restart", "d_counter", F.round(F.col("d_counter") / F.greatest("seconds", F.lit(1e-6)), 9).alias("rate"))
    )
    query("d3_histogram_deltas", f"select source, n, array_to_string(counts, ',') as counts from ({HISTS.replace('coalesce(counter < pc, false) or ', '')}) h")(lambda t: _counts(t).select("source", "n", F.array_join("counts", ",").alias("counts")))
    query("d5_minute_gauges", "select source, bucket, 'mean' as metric, round(avg(gauge),9) as value from (select *, cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket from {scrapes}) s group by 1, 2 union all select source, bucket, 'max', round(max(gauge),9) from (select *, cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket from {scrapes}) s group by 1, 2 having max(gauge) <> min(gauge)")(
        lambda t: _round(deltas.minute_gauges(t("scrapes").withColumn("gauge", F.col("gauge").cast("double")), "gauge", 3600), 9, "value")
    )
    query("d6_minute_counters", f"select *, round(total/3600, 9) as rate from ({MINUTES}) m")(lambda t: _round(deltas.minute_counters(deltas.counter_deltas(t("scrapes"), ALL), "counter", 3600), 9, "rate"))
    query("d7_minute_histograms", f"select source, bucket, concat_ws(',', sum(counts[1]), sum(counts[2]), sum(counts[3]), sum(counts[4])) as counts from (select *, cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket from ({HISTS.replace('coalesce(counter < pc, false) or ', '')}) h where counts is not null) x group by 1, 2")(
        lambda t: deltas.minute_histograms(_counts(t), 3600).select("source", "bucket", F.array_join("counts", ",").alias("counts"))
    )
    RANGE = f"""with h as ({HISTS.replace('coalesce(counter < pc, false) or ', '')}), r as (select * from h where counts is not null and ts_us >= {W0} and ts_us < {W1}),
 c as (select source, count(*) filter (where n % 17 = 0) as rows_skipped, cast(sum(list_sum(counts)) filter (where n % 17 <> 0) as bigint) as observations,
  [sum(counts[1]) filter (where n % 17 <> 0), sum(counts[2]) filter (where n % 17 <> 0), sum(counts[3]) filter (where n % 17 <> 0), sum(counts[4]) filter (where n % 17 <> 0)] as k from r group by 1)
select source, rows_skipped, observations, {', '.join(f"case when list_sum(k) > 0 then cast([60.0,120.0,240.0] as double[])[least(3, 1 + len(list_filter(range(1,5), lambda i: list_sum(k[1:i]) < {q} * list_sum(k))))] end as {n}" for n, q in QS3.items())} from c"""

    query("r8_d8_histogram_range", RANGE)(lambda t: deltas.histogram_range(_own_bounds(t), W0, W1, ("source",)).select("source", "rows_skipped", "observations", *QS3))
    query("d9_counter_total", f"select source, cast(coalesce(sum(total),0) as bigint) as total from ({MINUTES}) m where bucket >= {W0} and bucket < {W1} group by 1")(lambda t: deltas.counter_total(deltas.minute_counters(deltas.counter_deltas(t("scrapes"), ALL), "counter", 3600), W0, W1, ("source",)))

    # Intervals

    OPEN = f"select greatest(started_us, {A}) as a, least(ts_us, {B}) as b from {{requests}} where {WORK} and ts_us >= {A} and started_us < {B}"
    SWEEP = f"""with i as (select * from ({OPEN}) x where a < b), e as (select t, sum(d) as d from (select a as t, 1 as d from i union all select b, -1 from i) x group by 1),
 s as (select t as t0, lead(t) over (order by t) as t1, cast(sum(d) over (order by t) as bigint) as level from e)"""
    query("g1_seconds_at_level", f"{SWEEP} select level, round(sum(t1-t0)/1e6, 6) as seconds from s where level > 0 group by 1")(lambda t: _round(intervals.seconds_at_level(t("requests"), A, B), 6, "seconds"))
    query("g2_concurrency", f"{SWEEP} select coalesce(max(level),0) as peak, round(sum((t1-t0)/1e6*level)/{(B - A) / 1e6}, 9) as mean, round(sum((t1-t0)/1e6) filter (where level > 0), 6) as busy_s, cast(4 as bigint) as slots, round(sum((t1-t0)/1e6*level)/{(B - A) / 1e6}/4, 9) as utilisation, round(coalesce(sum((t1-t0)/1e6) filter (where level >= 4),0), 6) as saturated_s, round(coalesce(sum((t1-t0)/1e6) filter (where level >= 4),0)/{(B - A) / 1e6}, 9) as saturated from s")(
        lambda t: _round(_round(intervals.concurrency(t("requests"), A, B, 4), 9, "mean", "utilisation", "saturated"), 6, "busy_s", "saturated_s")
    )
    query("g3_concurrency_series", f"""{SWEEP}, c as (select g.bucket, sum((least(t1, g.bucket+900000000)-greatest(t0, g.bucket))/1e6*level)/900 as mean, max(level) as peak from {grid(A, B, 900)} g join s on level > 0 and t0 < g.bucket+900000000 and t1 > g.bucket group by 1)
select g.bucket, round(mean, 9) as mean, peak from {grid(A, B, 900)} g left join c on c.bucket = g.bucket""")(lambda t: _round(intervals.concurrency_series(t("requests"), A, B, 900), 9, "mean"))
    query("g4_busy_fraction", f"select source, round(sum(total_ms)/{(SHIP1 - SHIP0) / 1000}, 9) as busy from {{image_generations}} where ts_us >= {SHIP0} and ts_us < {SHIP1} group by 1")(
        lambda t: summary.in_window(t("image_generations"), SHIP0, SHIP1).groupBy("source").agg(F.round(F.sum("total_ms") / ((SHIP1 - SHIP0) / 1000), 9).alias("busy"))
    )
    query("j7_sole_client", "select r.id, min(c.client) as client, count(distinct c.ts_us) as samples from {requests} r join {conn_samples} c on c.source = r.source and c.ts_us >= r.started_us and c.ts_us <= r.ts_us group by 1 having count(distinct c.client) = 1")(lambda t: intervals.sole_clients(t("requests"), t("conn_samples")))
    query("b7_connected_clients", f"select source, client, count(distinct ts_us) as seen, max(conns) as peak, min(ts_us) as first_us, max(ts_us) as last_us, count(distinct ts_us)/any_value(times) as presence from {{conn_samples}} join (select source, count(distinct ts_us) as times from {{conn_samples}} where {IN} group by 1) x using (source) where {IN} group by 1, 2")(
        lambda t: intervals.by_connected_client(t("conn_samples"), W0, W1)
    )
    query("a14_device_ownership", "select source, coalesce(array_to_string(list_sort(list_distinct(list(k % 4))), ','), '') as held, count(*) as samples from {requests} where k % 3 <> 0 group by 1")(
        lambda t: t("requests").where("k % 3 != 0").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.col("k") % 4)), ",").alias("held"), F.count("*").alias("samples"))
    )


query("d1_d2_d4_counter_deltas_started", f"select source, n, restart, case when not restart then cast(counter - pc as bigint) end as d_counter from (select *, ({FELL}) or coalesce(run <> pr, false) as restart from (select *, lag(run) over w as pr, {LAGS}) a) b")(
    lambda t: deltas.counter_deltas(t("scrapes"), ALL, "run").select("source", "n", "restart", "d_counter")
)
query("a14_device_ownership_whole", "select source, coalesce(array_to_string(list_sort(list_distinct(list(k % 4))), ','), '') as held, count(*) as samples from {requests} group by 1")(
    lambda t: t("requests").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.col("k") % 4)), ",").alias("held"), F.count("*").alias("samples"))
)

# Tables

query("x1_registry_keep", "select source, max(ts_us) as ts_us, max_by(status, ts_us) as status, max_by(model, ts_us) filter (where model is not null) as model, max_by(n_ctx_slot, ts_us) filter (where n_ctx_slot is not null or k % 2 = 0) as n_ctx_slot from {requests} group by 1".replace("max_by(n_ctx_slot, ts_us) filter", "arg_max_null(n_ctx_slot, ts_us) filter"))(
    lambda t: tables.registry(t("requests").withColumn("looked", F.col("k") % 2 == 0), "source", "ts_us", ("status",), ("model",), {"n_ctx_slot": "looked"})
)
query("x2_registry_replace", "select source, id, model, status from {requests} qualify row_number() over (partition by source order by ts_us desc) = 1")(lambda t: tables.latest(t("requests"), ("source",), "ts_us").select("source", "id", "model", "status"))
query("x5_prune_counts", f"select 'requests' as \"table\", count(*) filter (where ts_us < {END - 7 * DAY}) as dropped from {{requests}} union all select 'conn_samples', count(*) filter (where ts_us < {END - 20 * DAY}) from {{conn_samples}} union all select 'forever', cast(0 as bigint)")(
    lambda t: tables.pruned_counts({"requests": (t("requests"), 7), "conn_samples": (t("conn_samples"), 20), "forever": (t("requests"), 0)}, END)
)
query("x7_first_rows", "select source, client_ip, endpoint, id from {requests} qualify row_number() over (partition by source, client_ip, endpoint order by id) = 1")(lambda t: tables.first_rows(t("requests"), ("source", "client_ip", "endpoint"), "id").select("source", "client_ip", "endpoint", "id"))
query("x4_purge", "select source, count(*) as n from {requests} where source <> 's2' group by 1")(lambda t: tables.purge(t("requests"), "s2").groupBy("source").agg(F.count("*").alias("n")))
query("j10_configured", "select source, count(*) as n from {conn_samples} where source in (select distinct source from {image_generations}) group by 1")(lambda t: tables.configured(t("conn_samples"), t("image_generations")).groupBy("source").agg(F.count("*").alias("n")))
query("s9_first_wins", "select id, source, k from {requests} where k >= 50 and not exists (select 1 from {requests} o where o.k < 50 and o.source = requests.source and o.k = requests.k - 50) qualify row_number() over (partition by source, k order by id) = 1")(
    lambda t: tables.first_wins(t("requests").where("k >= 50").select("id", "source", "k"), t("requests").where("k < 50").select("source", (F.col("k") + 50).alias("k")), ("source", "k"), "id")
)
query("s10_last_wins", "select source, client_ip, id from {requests} qualify row_number() over (partition by source, client_ip order by id desc) = 1")(
    lambda t: tables.last_wins(t("requests").where("id % 2 = 0").select("source", "client_ip", "id"), t("requests").where("id % 2 = 1").select("source", "client_ip", "id"), ("source", "client_ip"), "id")
)
query("p2_endpoint_class", "select id, endpoint, class from {requests}")(lambda t: t("requests").select("id", "endpoint", exprs.endpoint_class(F.col("endpoint")).alias("class")))
query("p1_durations", "select id, round(floor(value)*60000 + (k+1)*1000 + 250, 6) as ms from {requests}")(
    lambda t: t("requests").select("id", F.round(exprs.duration_ms(F.concat(F.floor("value").cast("string"), F.lit("m"), (F.col("k") + 1).cast("string"), F.lit("s250ms"))), 6).alias("ms"))
)
