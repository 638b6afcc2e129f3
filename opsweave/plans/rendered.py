"""Queries of parsers and mappers on lines and polls rendered from the given tables; the SQL answers from the columns they were rendered from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket_us, label_key, mask_secrets
from ..operators import backfill, breakdown, correlate, deltas, intervals, parse, polls, rollups, series, summary, tables
from ..sources import readers
from ..streaming.streams import scratch
from .catalog import ALL, FELL, HISTS, LAGS, QS3, A, B, _counts, grid, query, windowed

LINE = "source, id as seq, ts_us"


def lines(t, text: str, where: str = "true") -> DataFrame:
    """requests as lines of a log."""
    return t("requests").where(where).selectExpr("source", "id as seq", "ts_us", f"{text} as message")


# Log lines

ACCESS = "concat('[GIN] 2024/01/02 - 03:04:05 | ', status, ' | ', cast(floor(value) as bigint), 'm', k, '.5s | ', client_ip, ' | POST     \"', endpoint, '?k=', k, '\"')"
query("p3_access_lines", "select source, id as seq, status, round(floor(value)*60000 + k*1000 + 500, 6) as latency_ms, client_ip, concat(endpoint, '?k=', k) as endpoint, class from {requests}")(
    lambda t: parse.access_lines(lines(t, ACCESS)).select("source", "seq", "status", F.round("latency_ms", 6).alias("latency_ms"), "client_ip", "endpoint", "class")
)
SLOT = "concat('slot print_timing: id ', k % 4, ' | task ', id, ' | ', case k % 3 when 0 then concat('prompt eval time = ', k, '.25 ms / ', 1 + k, ' tokens ( 1.0 ms per token, ', k, '.5 tokens per second)') when 1 then concat('stop processing: n_tokens = ', k, ', truncated = ', k % 2) else concat('erased invalidated context checkpoint (pos_min = 1, size = ', k, '.5 MiB)') end)"
query("p4_slot_lines", "select source, id as seq, cast(k % 4 as int) as slot_id, id as task_id, case k % 3 when 0 then 'prompt_eval' when 1 then 'release' else 'ckpt_evict' end as kind, case when k % 3 = 0 then cast(k + 0.25 as double) end as ttft_ms, case when k % 3 = 1 then k end as context_tokens, case when k % 3 = 2 then 'invalidated' end as reason from {requests}")(
    lambda t: parse.slot_lines(lines(t, SLOT)).select("source", "seq", "slot_id", "task_id", "kind", "ttft_ms", "context_tokens", "reason")
)
SERVER = "concat('srv  update: - cache state: ', k, ' prompts, ', k, '.5 MiB (limits: ', (k % 3) * 8192, '.0 MiB, 65536 tokens, ', k, ' est)')"
query("p5_server_lines", "select source, id as seq, k as prompts, case when k % 3 > 0 then (k + 0.5)/((k % 3)*8192) end as usage from {requests}")(lambda t: parse.server_lines(lines(t, SERVER)).select("source", "seq", "prompts", "usage"))
query("p6_kv_lines", "select source, id as seq, case when k % 2 = 0 then 'CPU' else 'CUDA0' end as device, cast(k + 0.5 as double) as kv_mib from {requests}")(
    lambda t: parse.kv_lines(lines(t, "concat('llama_kv_cache: ', case when k % 2 = 0 then 'CPU' else 'CUDA0' end, ' KV buffer size = ', k, '.50 MiB')")).select("source", "seq", "device", "kv_mib")
)
GO = "concat('time=2024-01-02T03:04:05.678+02:00 level=', case when k % 5 = 0 then 'WARN' else 'INFO' end, ' source=s.go:1 msg=\"', case when k % 2 = 0 then concat('llama-server started in ', k, '.50 seconds') else 'loaded \\\"runners\\\"' end, '\" runner.name=registry.ollama.ai/library/m', k, ' runner.parallel=', k % 4)"
query("p7_structured_lines", "select source, id as seq, case when k % 5 = 0 then 'WARN' else 'INFO' end as level, case when k % 2 = 0 then 'model_loaded' when k % 5 = 0 then 'problem' end as event, case when k % 2 = 0 then cast((k + 0.5)*1000 as double) end as load_ms, concat('m', k) as model, k % 4 as parallel from {requests}")(
    lambda t: parse.go_lines(lines(t, GO)).select("source", "seq", "level", "event", "load_ms", "model", "parallel")
)
ENGINE_E = "concat('#', id, ' chat/completions (stream): ', format_number(output_tokens, 0), ' tokens generated at 49.5 T/s · prompt ', format_number(prompt_tokens + cached_tokens, 0), ' tokens, none cached, ', format_number(prompt_tokens, 0), ' new in 1.5 s · first token ', k, '.5 s, total ', k + 2, '.0 s')"
query("p11_engine_e_lines", "select source, id as seq, id as req_id, output_tokens, prompt_tokens, cached_tokens, prompt_tokens + cached_tokens as prompt_tokens_total, cast(k*1000 + 500.0 as double) as ttft_ms, cast((k + 2)*1000.0 as double) as latency_ms, cast(1500.0 as double) as decode_ms from {requests} where prompt_tokens is not null")(
    lambda t: parse.engine_e_lines(lines(t, ENGINE_E, "prompt_tokens is not null")).select("source", "seq", "req_id", "output_tokens", "prompt_tokens", "cached_tokens", "prompt_tokens_total", "ttft_ms", "latency_ms", "decode_ms")
)
PROXY = "concat('12:00 REQ ', endpoint, ' from=', client_ip, ' model=', coalesce(model, 'None'), ' msgs=', k, ' prompt=', coalesce(cast(prompt_tokens as string), 'unknown'), ' limit=4096 max_tokens=', 256 + k, ' stream=', case when k % 2 = 0 then 'True' else 'False' end)"
query("p12_proxy_lines", "select source, id as seq, endpoint, client_ip as client, model, k as messages, prompt_tokens, cast(4096 as bigint) as context_limit, 256 + k as max_tokens, k % 2 = 0 as stream from {requests}")(
    lambda t: parse.proxy_lines(lines(t, PROXY)).select("source", "seq", "endpoint", "client", "model", "messages", "prompt_tokens", "context_limit", "max_tokens", "stream")
)
IMAGE = "case k % 3 when 0 then concat('10:00:00 [Info] Generated an image in ', k, '.50 sec (prep) and 2.25 sec (gen)') when 1 then concat('10:00:01 [Error] [WebAPI] Error handling API request ''R', k, ''' for user ''u'': bad') else concat('[ComfyUI-', k % 4, '/STDERR] boom') end"
query("p13_p15_image_lines", "select source, id as seq, case k % 3 when 0 then 'generation_finished' when 1 then 'webapi_error' else 'backend_stderr' end as kind, case when k % 3 = 0 then cast(k*1000 + 500.0 as double) end as prep_ms, case when k % 3 = 1 then concat('R', k) end as route, case when k % 3 = 2 then k % 4 end as backend_index, case k % 3 when 0 then concat('image in ', k, '.50 s (prep) and 2.25 s (gen)') when 1 then concat('R', k, ': bad') else 'boom' end as msg from {requests}")(
    lambda t: parse.image_lines(lines(t, IMAGE)).select("source", "seq", "kind", "prep_ms", "route", "backend_index", "msg")
)
query("p14_quality", "select count(*) as lines, count(*) as claimed, kind, n from {requests}, (select case k % 3 when 0 then 'prompt_eval' when 1 then 'release' else 'ckpt_evict' end as kind, count(*) as n from {requests} group by 1) x group by kind, n")(lambda t: parse.quality(lines(t, SLOT), parse.slot_lines(lines(t, SLOT))))

# Scrapes

BODY = "concat('# HELP x\\n', 'x_total{source=\"', source, '\",n=\"', n % 3, '\"} ', counter, '\\nh_bucket{le=\"60\"} ', le60, '\\nh_bucket{le=\"+Inf\"} ', le_inf, '\\ng NaN\\n')"


def scraped(t) -> DataFrame:
    return parse.classified(parse.prometheus_lines(t("scrapes").selectExpr("source", "n as scrape", f"{BODY} as body")), ["g"], ["x_total"])


query("p8_p9_scrape_samples", "select source, n as scrape, 'x_total' as metric, 'counter' as kind, concat('n=', n % 3, ',source=', source) as labels, cast(null as double) as bound, cast(counter as double) as value from {scrapes} union all select source, n, 'h', 'bucket', '', 60.0, cast(le60 as double) from {scrapes} union all select source, n, 'h', 'bucket', '', null, cast(le_inf as double) from {scrapes}")(
    lambda t: scraped(t).select("source", "scrape", "metric", "kind", label_key(F.col("labels")).alias("labels"), "bound", "value")
)


@windowed
def _metrics(query: Callable, A: int, B: int, W0: int, W1: int, SHIP0: int, SHIP1: int) -> None:
    query("w8_metric_series", f"""with d as (select *, cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket from (select *, {FELL} as restart from (select *, counter, gauge, ts_us, source, {LAGS}) a) b where ts_us >= {W0} and ts_us < {W1}),
 s as (select bucket, cast(coalesce(sum(case when not restart then counter - pc end),0) as bigint)/3600 as rate, cast(max_by(gauge, ts_us) as double) as gauge from d group by 1) select g.bucket, rate, gauge from {grid(W0, W1, 3600)} g left join s on s.bucket = g.bucket""".replace("select *, counter, gauge, ts_us, source, lag", "select *, lag"))(
        lambda t: series.filled(
            summary.in_window(deltas.counter_deltas(t("scrapes"), ALL), W0, W1).groupBy(bucket_us(F.col("ts_us"), 3600).alias("bucket")).agg((F.coalesce(F.sum("d_counter"), F.lit(0)).cast("long") / 3600).alias("rate"), F.max_by(F.col("gauge").cast("double"), "ts_us").alias("gauge")),
            W0, W1, 3600,
        )
    )
    METRICS = f"""with h as ({HISTS.replace('coalesce(counter < pc, false) or ', '')}), r as (select * from h where counts is not null and ts_us >= {W0} and ts_us < {W1}),
 c as (select [sum(counts[1]), sum(counts[2]), sum(counts[3]), sum(counts[4])] as k, cast(sum(list_sum(counts)) as bigint) as observations from r),
 t as (select cast(coalesce(sum(counter - pc),0) as bigint) as total from (select *, {FELL} as restart from (select *, {LAGS}) a) b where not restart and ts_us >= {W0} and ts_us < {W1}),
 g as (select round(avg(gauge),9) as gauge_mean, cast(max(gauge) as double) as gauge_max from {{scrapes}} where ts_us >= {W0} and ts_us < {W1})
select total, total/{(W1 - W0) / 1e6} as per_s, observations, {', '.join(f"case when list_sum(k) > 0 then cast([60.0,120.0,240.0] as double[])[least(3, 1 + len(list_filter(range(1,5), lambda i: list_sum(k[1:i]) < {q} * list_sum(k))))] end as {n}" for n, q in QS3.items())}, gauge_mean, gauge_max from c, t, g"""

    def metric_summary(t) -> DataFrame:
        d = summary.in_window(deltas.counter_deltas(t("scrapes"), ALL), W0, W1)
        total = d.agg(F.coalesce(F.sum("d_counter"), F.lit(0)).cast("long").alias("total"), F.round(F.avg(F.col("gauge").cast("double")), 9).alias("gauge_mean"), F.max(F.col("gauge").cast("double")).alias("gauge_max"))
        bounds = F.array(F.lit(60.0), F.lit(120.0), F.lit(240.0), F.lit(None).cast("double"))
        h = _counts(t).where("counts is not null").select("ts_us", bounds.alias("bounds"), "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("observations"), F.lit(0.0).alias("sum_value"))
        r = deltas.histogram_range(h, W0, W1).select("observations", *QS3)
        return total.join(r, F.lit(True)).select("total", (F.col("total") / ((W1 - W0) / 1e6)).alias("per_s"), "observations", *QS3, "gauge_mean", "gauge_max")

    query("a3_metric_summary", METRICS)(metric_summary)


query("r13_first_with_data", "select case when count(*) > 0 then 'b' end as metric from {scrapes} having count(*) > 0")(
    lambda t: deltas.first_with_data(t("scrapes").select(F.explode(F.array(F.struct(F.lit("a").alias("metric"), F.lit(0).alias("observations")), F.struct(F.lit("c").alias("metric"), F.lit(5).alias("observations")), F.struct(F.lit("b").alias("metric"), F.lit(7).alias("observations")))).alias("x")).select("x.*"), {"a": 0, "b": 1, "c": 2})
)

# Polls

RING = "to_json(struct(struct(model) as engine, array(map('time', cast(started_us/1000000 as decimal(20,6)), 'duration_s', cast(value as decimal(12,2)), 'prompt_ms', k, 'prompt_read', k * 10, 'prompt_total', prompt_tokens, 'output_tokens', output_tokens, 'drafts_offered', k % 5, 'drafts_accepted', k % 2)) as requests))"
query("m1_ring_requests", "select source, model, started_us, prompt_tokens as prompt_tokens_total, output_tokens, cast(k as double) as ttft_ms, case when k > 0 then k*10/(k/1000) end as prefill_tps, case when k % 5 > 0 then (k % 2)/(k % 5) end as draft_accept from {requests} qualify row_number() over (partition by source, started_us, prompt_tokens order by ts_us) = 1")(
    lambda t: polls.ring_requests(t("requests").selectExpr("source", "ts_us", f"{RING} as body")).select("source", "model", "started_us", "prompt_tokens_total", "output_tokens", "ttft_ms", "prefill_tps", "draft_accept")
)
STATE = "to_json(struct(struct('m' as model, 4096 as max_context) as engine, struct(case k % 3 when 0 then 'generating' when 1 then 'reading' else 'idle' end as state, k as prompt_tokens, 5 as generated, k % 4 as queued, 1 as waiting, k as tok_s) as live))"
query("m2_a7_state_samples", "select source, ts_us, case k % 3 when 0 then 'generating' when 1 then 'reading' else 'idle' end as state, cast(case when k % 3 < 2 then 1.0 else 0.0 end as double) as running, cast(k % 4 + 1.0 as double) as queued, cast(case when k % 3 < 2 then k + 5.0 else 0.0 end as double) as kv_tokens, case when k % 3 = 0 then cast(k as double) end as decode_tps from {requests}")(
    lambda t: polls.state_samples(t("requests").selectExpr("source", "ts_us", f"{STATE} as body")).select("source", "ts_us", "state", "running", "queued", "kv_tokens", "decode_tps")
)
query("m3_instances", "select source, ts_us, 'm' as model, cast(4096.0 as double) as max_context from {requests}")(lambda t: polls.instances(t("requests").selectExpr("source", "ts_us", f"{STATE} as body")).select("source", "ts_us", "model", "max_context"))
query("m4_foreign_filter", "select source, count(*) filter (where k % 4 = 0) as own, count(*) filter (where k % 4 <> 0) as errors from {requests} group by 1")(
    lambda t: polls.foreign_filtered(t("requests").selectExpr("source", "ts_us", "'{}' as body", "case when k % 4 = 0 then 'S' else 'M' end as engine"), "S").groupBy("source").agg(F.count("body").alias("own"), F.count("error").alias("errors"))
)
# The same with values that rows decide on: models and contexts by row, bodies that only their engine reads, a metric that first has data later on.
STATED = "to_json(struct(struct(coalesce(model, 'none') as model, 4096 + k as max_context) as engine, struct('idle' as state) as live))"
query("m3_instances_by_row", "select source, ts_us, coalesce(model, 'none') as model, cast(4096.0 + k as double) as max_context from {requests}")(lambda t: polls.instances(t("requests").selectExpr("source", "ts_us", f"{STATED} as body")).select("source", "ts_us", "model", "max_context"))
query("m4_foreign_bodies", "select source, ts_us, case when k % 4 = 0 then concat('{\"k\":', cast(k as varchar), '}') end as body, k % 4 <> 0 as foreign_engine from {requests}")(
    lambda t: polls.foreign_filtered(t("requests").selectExpr("source", "ts_us", "concat('{\"k\":', k, '}') as body", "case when k % 4 = 0 then 'S' when k % 4 = 1 then 'M' else 'N' end as engine"), "S").select("source", "ts_us", "body", F.col("error").isNotNull().alias("foreign_engine"))
)
query("r13_first_of_events", "select event_type as metric from (select event_type, count(*) filter (where cast(json_extract_string(props,'$.k') as bigint) >= 98) as n from {events} group by 1) x where n > 0 order by case event_type when 'view' then 0 when 'signup' then 1 when 'error' then 2 when 'click' then 3 else 4 end limit 1")(
    lambda t: deltas.first_with_data(t("events").groupBy(F.col("event_type").alias("metric")).agg(F.count_if(F.get_json_object("props", "$.k").cast("long") >= 98).alias("observations")), {"view": 0, "signup": 1, "error": 2, "click": 3, "purchase": 4})
)
GRAPH = "to_json(map('1', struct('L' as class_type, map('ckpt_name', model, 'x', 'a') as inputs), '2', struct('V' as class_type, map('file', concat(prompt_id, '.safetensors')) as inputs)))"
query("m5_workflow_models", "select prompt_id as key, 'ckpt_name' as role, model as name from {image_generations} union all select prompt_id, 'file', concat(prompt_id, '.safetensors') from {image_generations}")(lambda t: polls.workflow_models(t("image_generations").selectExpr("prompt_id as key", f"{GRAPH} as graph")).select("key", "role", "name"))
query("m5_primary_model", "select prompt_id as key, model from {image_generations}")(lambda t: polls.primary_model(polls.workflow_models(t("image_generations").selectExpr("prompt_id as key", f"{GRAPH} as graph"))))
HISTORY = "concat('{\"status\":{\"status_str\":\"', status, '\",\"messages\":[[\"execution_start\",{\"timestamp\":', cast(ts_us/1000 as bigint), '}]', case when status = 'running' then '' else concat(',[\"execution_', status, '\",{\"timestamp\":', cast(ts_us/1000 as bigint) + cast(total_ms as bigint), '}]') end, ']}}')"
query("m6_history_generations", "select source, prompt_id, status, ts_us as started_us, case when status <> 'running' then cast(floor(total_ms) as double) end as total_ms from {image_generations}")(lambda t: polls.history_generations(t("image_generations").selectExpr("source", "prompt_id", f"{HISTORY} as body")).select("source", "prompt_id", "status", "started_us", "total_ms"))
query("m8_a8_residency", "select source, 'm' as name, max_by(k, ts_us) as size_vram from {requests} group by 1")(
    lambda t: polls.resident_now(polls.residency(t("requests").selectExpr("source", "ts_us", "to_json(struct(array(struct('m' as name, k as size_vram)) as models)) as body"))).select("source", "name", "size_vram")
)
query("m9_connection_counts", "select source, ts_us, client, conns from {conn_samples}")(
    lambda t: polls.connection_counts(t("conn_samples").selectExpr("source", "ts_us", "explode(transform(sequence(cast(1 as bigint), conns), i -> concat('[::ffff:', client, ']:', 40000 + i))) as peer")).select("source", "ts_us", "client", "conns")
)
query("m10_restart_events", "select source, ts_us, cast(run as bigint) as started from (select *, lag(run) over (partition by source order by ts_us) as b from {scrapes}) x where b is not null and run <> b")(lambda t: polls.restart_events(t("scrapes").select("source", "ts_us", F.col("run").alias("started"))))
query("s13_ring_gaps", "select source, ts_us, coalesce(started_us > (max(started_us) over (partition by source order by ts_us rows between unbounded preceding and 1 preceding)), false) as may_have_gap from {requests}")(
    lambda t: polls.ring_gaps(t("requests").selectExpr("source", "ts_us", "to_json(struct(transform(sequence(1, 12), i -> map('time', started_us)) as requests)) as body"))
)

SWARM = "case when o_orderkey % 7 > 0 then concat('{\"status\":{\"live_gens\":', queue_running, ',\"waiting_gens\":', queue_pending, ',\"loading_models\":0},\"backend_status\":{\"status\":\"running\"}}') end"
STATS = "case when o_orderkey % 3 > 0 then concat('{\"system\":{},\"devices\":[{\"name\":\"d\",\"vram_total\":', vram_total, ',\"vram_free\":', vram_free, '}]}') end"
QUEUE = "concat('{\"queue_running\":[', repeat('[1]', cast(queue_running as int)), '],\"queue_pending\":[', array_join(array_repeat('[0,\"x\"]', cast(queue_pending as int)), ','), ']}')"
query("m7_backend_samples", """select source, o_orderkey, '' as backend, 'running' as status, queue_running as live_gens, queue_pending as waiting_gens, cast(null as bigint) as queue_running, cast(null as bigint) as queue_pending, cast(null as bigint) as vram_free from {image_samples} where o_orderkey % 7 > 0
union all select source, o_orderkey, b, case when o_orderkey % 3 > 0 then 'running' else 'unreachable' end, null, null, case when o_orderkey % 3 > 0 then queue_running end, case when o_orderkey % 3 > 0 then queue_pending end, case when o_orderkey % 3 > 0 then vram_free end from {image_samples}, (values ('ComfyUI-0'), ('ComfyUI-1')) x(b)""")(
    lambda t: polls.backend_samples(t("image_samples").selectExpr("source", "o_orderkey as ts_us", f"{SWARM} as status", f"transform(array('ComfyUI-0', 'ComfyUI-1'), b -> struct(b as backend, {STATS} as stats, {QUEUE} as queue)) as backends")).select(
        "source", F.col("ts_us").alias("o_orderkey"), "backend", "status", "live_gens", "waiting_gens", "queue_running", "queue_pending", "vram_free"
    )
)
query("a6_cache_usage", """with s as (select source, ts_us, id, case when n_ctx_slot > 0 then prompt_tokens / n_ctx_slot end as share, k % 3 as active_jobs, k % 5 as pending_jobs, k / 100 as hit_rate from {requests}),
 l as (select * from s qualify row_number() over (partition by source order by ts_us desc, id desc) = 1)
select source, round(avg(s.share), 9) as mean, max(s.share) as max, count(s.share) as n, any_value(l.share) as last, any_value(l.active_jobs) as active_jobs, any_value(l.pending_jobs) as pending_jobs, any_value(l.hit_rate) as hit_rate from s join l using (source) group by source""")(
    lambda t: summary.cache_usage(t("requests").selectExpr("source", "ts_us", "prompt_tokens as used_tokens", "n_ctx_slot as max_tokens", "k % 3 as active_jobs", "k % 5 as pending_jobs", "k / 100 as hit_rate"), 0, 1 << 62).withColumn("mean", F.round("mean", 9))
)
query("a9_registry_list", """select source, last_us, started_us, k % 2 = 0 as reachable, case when k % 3 = 1 then 0 when k % 3 = 2 then 2 end as devices, (1706659200000000 - last_us)/1e6 as stale_s, (1706659200000000 - started_us)/1e6 as uptime_s, case when k % 3 > 0 then (1706659200000000 - last_us)/1e6 end as devices_age_s
from (select source, ts_us as last_us, started_us, k from {requests} where source <> 's3' qualify row_number() over (partition by source order by id desc) = 1) x""")(
    lambda t: tables.registry_list(
        tables.latest(t("requests").selectExpr("source", "id", "ts_us as last_us", "started_us", "case when k % 2 = 0 then true end as reachable", "case k % 3 when 1 then '[]' when 2 then '[3,4]' end as devices", "case when k % 3 > 0 then ts_us end as devices_us"), ("source",), "id"),
        t("requests").where("source != 's3'").select("source"),
        1_706_659_200_000_000,
    ).select("source", "last_us", "started_us", "reachable", F.nullif(F.size("devices"), F.lit(-1)).cast("int").alias("devices"), "stale_s", "uptime_s", "devices_age_s")
)
query("j9_capacity", "select (select slots from (select *, case when k % 3 > 0 then 1 + k % 4 end as slots from {requests}) where slots is not null order by ts_us desc, id desc limit 1) as slots, max(k % 9) as sampled_peak from {requests}")(
    lambda t: intervals.capacity(t("requests").selectExpr("ts_us", "case when k % 3 > 0 then 1 + k % 4 end as slots", "k % 9 as inflight"), 0, 1 << 62)
)

# Events

SAID = "concat('time=2024-01-02T03:04:05.678+02:00 level=', case when k % 3 = 2 then 'WARN' else 'INFO' end, ' source=s.go:1 msg=\"', case k % 3 when 0 then 'timer expired, expiring to unload' when 1 then 'runner with non-zero duration has gone idle, adding timer' else concat('odd ', k) end, '\" runner.name=m', k % 5, ' duration=', k, 'm')"
query("e3_server_events", """select source, id as seq, case k % 3 when 0 then 'unload' when 1 then 'idle_timer' else 'problem' end as kind, case when k % 3 = 2 then 'WARN' else 'INFO' end as level, concat('m', k % 5) as model,
 case k % 3 when 0 then 'timer expired, expiring to unload' when 1 then 'runner with non-zero duration has gone idle, adding timer' else concat('odd ', k) end as msg from {requests}
union all select source, id, 'truncation', 'WARN', null, concat('context truncated at ', k, ' tokens') from {requests} where k % 3 = 1 and k % 2 = 1""")(
    lambda t: correlate.server_events(parse.go_lines(lines(t, SAID)), parse.slot_lines(lines(t, SLOT))).select("source", "seq", "kind", "level", "model", "msg")
)
query("e7_engine_events", "select source, seq, case when message like 'listening%' then 'start' else 'error' end as kind, 'm1' as model, case when message like 'listening%' then 'listening on http://0.0.0.0:8011' else 'upstream exploded' end as msg from {n_log} where message like 'listening%' or message like '% error %'")(
    lambda t: correlate.engine_events(parse.engine_n_lines(t("n_log"))).select("source", "seq", "kind", "model", "msg")
)


# Backfill: three lines of each request that works, in the order of requests.

def whole_log(t) -> DataFrame:
    parts = (
        "concat('slot print_timing: id 0 | task ', id, ' | prompt eval time = ', k, '.50 ms / ', 1 + k, ' tokens ( 1.0 ms per token, 2.0 tokens per second)')",
        "concat('slot release: id 0 | task ', id, ' | stop processing: n_tokens = ', k, ', truncated = ', k % 2)",
        "concat('[GIN] 2024/01/02 - 03:04:05 | ', status, ' | ', k, '.5s | ', client_ip, ' | POST     \"', endpoint, '\"')",
    )
    each = ", ".join(f"struct(3*id + {i} as seq, {p} as message)" for i, p in enumerate(parts))
    return t("requests").where("class in ('inference','embed')").selectExpr("source", "ts_us", f"inline(array({each}))")


def backfilled(t) -> tuple[DataFrame, str]:
    folder = scratch(t("requests").sparkSession)
    return backfill.backfill(whole_log(t), folder), folder


query("s11_backfill", """with r as (select * from {requests} where class in ('inference','embed')) select 'lines' as "table", 3*count(*) as read, cast(null as bigint) as added from r union all select 'requests', count(*), count(*) from r
union all select 'events', count(*), count(distinct concat(ts_us, ' ', k)) from r where k % 2 = 1 union all select 'cache_samples', 0, 0""")(lambda t: backfilled(t)[0])


def full_rollup(t) -> DataFrame:
    spark, (_, folder) = t("requests").sparkSession, backfilled(t)
    backfill.refresh_rollups(spark, folder)
    return spark.read.parquet(f"{folder}/rollup_1h").select("bucket", "class", "req_count", "err_count", F.col("ttft_n").alias("timed"))


query("s12_full_rollup", "select cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket, class, count(*) as req_count, count(*) filter (where status >= 400) as err_count, count(*) as timed from {requests} where class in ('inference','embed') group by 1, 2")(full_rollup)

# Clocks, names, loads, tables

query("t1_t3_clocks", "select source, seq, ts_us - 3600000000*(case when first_k is null then 0 else 1 end) as clock_us from (select source, ts_us // 1000000 * 1000000 as ts_us, row_number() over (partition by source order by ts_us, id) as seq, max(case when k % 5 = 0 then 1 end) over (partition by source order by ts_us, id) as first_k from {requests}) x")(
    lambda t: readers.with_clock(t("requests").selectExpr("source", "row_number() over (partition by source order by ts_us, id) as seq", "case when k % 5 = 0 then concat('time=', date_format(timestamp_micros(ts_us), \"yyyy-MM-dd'T'HH:mm:ss\"), '+01:00 x') else concat('[GIN] ', date_format(timestamp_micros(ts_us), 'yyyy/MM/dd - HH:mm:ss'), ' | 200') end as message")).select("source", "seq", "clock_us")
)
query("e1_load_events", "with o as (select source, ts_us, k, row_number() over (partition by source order by ts_us, id) as seq from {requests}), l as (select *, sum(case when k % 3 = 0 then 1 else 0 end) over (partition by source order by seq) as load from o), m as (select *, lag(ts_us) over (partition by source, load order by seq) as b from l where k % 3 <> 0) select source, seq from m where b is null or ts_us - b > 2000000")(
    lambda t: correlate.load_events(t("requests").selectExpr("source", "ts_us", "row_number() over (partition by source order by ts_us, id) as seq", "case when k % 3 = 0 then 'load_start' else 'model_loaded' end as event", "'b' as blob")).select("source", "seq")
)
query("e2_kv_placement", "select source, k as load, cast(sum(prompt_tokens) as double) as kv_mib, cast(coalesce(sum(prompt_tokens) filter (where id % 4 = 0), 0) as double) as cpu_mib, case when coalesce(sum(prompt_tokens) filter (where id % 4 = 0), 0) > 0 then 'WARN' else 'INFO' end as level from {requests} where prompt_tokens is not null group by 1, 2")(
    lambda t: correlate.kv_placement(t("requests").where("prompt_tokens is not null").selectExpr("source", "k as load", "'kv_buffer' as kind", "case when id % 4 = 0 then 'cpu' else 'CUDA0' end as device", "cast(prompt_tokens as double) as kv_mib")).select("source", "load", "kv_mib", "cpu_mib", "level")
)
query("e8_backend_state", "select source, backend, queue_pending, queue_running from {image_samples} qualify row_number() over (partition by source, backend order by ts_us desc, o_orderkey desc) = 1")(
    lambda t: t("image_samples").groupBy("source", "backend").agg(F.max_by(F.struct("queue_pending", "queue_running"), F.struct("ts_us", "o_orderkey")).alias("s")).select("source", "backend", "s.*")
)
query("j6_model_names", "select source, id as seq, concat('n', k % 7) as model from {requests} where k % 7 < 5")(
    lambda t: correlate.with_model_names(t("requests").where("k % 7 < 5").selectExpr("source", "id as seq", "concat('/m/sha256-', k % 7) as blob"), t("requests").where("false").selectExpr("source", "id as seq", "model as blob", "model"), t("requests").selectExpr("concat('sha256:', k % 7) as digest", "concat('n', k % 7) as model").distinct()).select("source", "seq", "model")
)
# A name is learned just before each row whose k is divisible by 11, and holds from there on; digests 5 and 6 have no manifest, so before that they have none.
query("j6_model_names_whole", """with o as (select source, 2*id + 1 as seq, k % 7 as b, case when k % 11 = 0 then concat('learned', id % 3) end as name from {requests})
select source, seq, coalesce(last_value(name ignore nulls) over (partition by source, b order by seq), case when b < 5 then concat('n', b) end) as model from o""")(
    lambda t: correlate.with_model_names(
        t("requests").selectExpr("source", "2*id + 1 as seq", "concat('/m/sha256-', k % 7) as blob"),
        t("requests").where("k % 11 = 0").selectExpr("source", "2*id as seq", "concat('/m/sha256-', k % 7) as blob", "concat('learned', id % 3) as model"),
        t("requests").where("k % 7 < 5").selectExpr("concat('sha256:', k % 7) as digest", "concat('n', k % 7) as model").distinct(),
    ).select("source", "seq", "model")
)
query("x6_widened", "select count(*) as n, count(extra) as extra from (select id, cast(null as bigint) as extra from {requests} union all select id, k from {requests})")(lambda t: tables.widened(t("requests").select("id"), t("requests").select("id", F.col("k").alias("extra"))).agg(F.count("*").alias("n"), F.count("extra").alias("extra")))
query("x8_masked", "select id, '***' as token, client_ip as url, concat('$', chr(123), 'PW', chr(125)) as password from {requests}")(
    lambda t: t("requests").select("id", F.from_json(mask_secrets(F.to_json(F.struct(F.col("model").alias("x"), F.col("endpoint").alias("token"), F.col("client_ip").alias("url"), F.lit("${PW}").alias("password")))), "token string, url string, password string").alias("c")).select("id", "c.*")
)


def report(t, start: int = A, end: int = B) -> dict[str, DataFrame]:
    """Everything of one window at once: summary, series, breakdowns and concurrency of the same slice."""
    r = t("requests")
    return {
        "summary": summary.request_summary(r, start, end),
        "series": series.request_series(r, start, end, 900),
        "by_model": breakdown.by_model(r, start, end),
        "by_endpoint": breakdown.by_endpoint(r, start, end),
        "by_client": breakdown.by_client(r, start, end),
        "concurrency": intervals.concurrency(r, start, end),
        "rollup": summary.in_window(rollups.build_rollup(r, 60), start, end, "bucket"),
    }


@windowed
def _reports(query: Callable, A: int, B: int, W0: int, W1: int, SHIP0: int, SHIP1: int) -> None:
    query("a15_report_rows", f"select 'requests' as part, count(*) as n from {{requests}} where class in ('inference','embed') and ts_us >= {A} and ts_us < {B} union all select 'buckets', cast({(B - A) // 900_000_000 + 1} as bigint)")(
        lambda t: report(t, A, B)["summary"].select(F.lit("requests").alias("part"), F.col("requests").alias("n")).unionByName(report(t, A, B)["series"].agg(F.count("*").alias("n")).select(F.lit("buckets").alias("part"), "n"))
    )
