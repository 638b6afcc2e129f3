"""Queries of the log, correlation and streaming operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import breakdown, correlate, parse, series, summary
from ..streaming import streams
from .catalog import QUERIES, _round, grid, query, rank_sql, windowed
from .fixtures import view

SUBMITTED = ("endpoint", "messages", "max_tokens", "tools")


def engine_rows(t) -> DataFrame:
    """Engine N's requests, with their submissions."""
    return correlate.paired_requests(parse.engine_n_lines(t("n_log")), SUBMITTED)


X = "nullif(regexp_extract(message, '{0}', {1}), '')"
PARSED = f"""select source, seq, ts_us, message,
  case when message like '% done finish=%' then 'done' when message like '%] error %' then 'error' when message like 'listening%' then 'listening' else 'submit' end as kind,
  cast({X.format('req (\\d+)', 1)} as bigint) as req_id, {X.format('finish=(\\S+)', 1)} as finish, cast({X.format('prompt=(\\d+)', 1)} as bigint) as prompt_tokens,
  cast({X.format('gen=(\\d+)', 1)} as bigint) as output_tokens, cast({X.format('cache=(\\d+)', 1)} as bigint) as cached_tokens, cast({X.format('ttft=(\\d+)ms', 1)} as double) as ttft_ms,
  cast({X.format('prefill=([0-9.]+)tok', 1)} as double) as prefill_tps, cast({X.format('decode=([0-9.]+)tok', 1)} as double) as decode_tps, cast({X.format('wall=([0-9.]+)s', 1)} as double)*1000 as latency_ms,
  cast({X.format('msgs=(\\d+)', 1)} as bigint) as messages, cast({X.format('max_tokens=(\\d+)', 1)} as bigint) as max_tokens from {{n_log}}"""
PAIRS = f"""with p as ({PARSED}), e as (select *, sum(case when kind = 'listening' then 1 else 0 end) over (partition by source order by seq) as epoch from p),
 k as (select *, coalesce(sum(case when kind in ('done','error') then 1 else 0 end) over (partition by source, epoch, req_id order by seq rows between unbounded preceding and 1 preceding), 0) as turn from e where kind <> 'listening'),
 l as (select *, last_value(case when kind = 'submit' then seq end ignore nulls) over (partition by source, epoch, req_id, turn order by seq rows between unbounded preceding and 1 preceding) as sub,
  last_value(case when kind = 'submit' then ts_us end ignore nulls) over (partition by source, epoch, req_id, turn order by seq rows between unbounded preceding and 1 preceding) as submit_us,
  last_value(case when kind = 'submit' then messages end ignore nulls) over (partition by source, epoch, req_id, turn order by seq rows between unbounded preceding and 1 preceding) as msgs from k),
 pairs as (select * exclude (messages), msgs as messages, sub is not null as paired, coalesce(finish, case when kind = 'error' then 'error' end) as f from l where kind in ('done','error'))
"""

query("p10_engine_log", f"select source, seq, kind, req_id, finish, prompt_tokens, output_tokens, cached_tokens, ttft_ms, prefill_tps, decode_tps, latency_ms, messages, max_tokens from ({PARSED}) x")(
    lambda t: parse.engine_n_lines(t("n_log")).select("source", "seq", "kind", "req_id", "finish", "prompt_tokens", "output_tokens", "cached_tokens", "ttft_ms", "prefill_tps", "decode_tps", "latency_ms", "messages", "max_tokens")
)
query("p14_dispatch", "select case when message like 'listening%' then 'n' else 'req' end as form, count(*) as n from {n_log} group by 1")(lambda t: parse.dispatch(t("n_log")).where("owner is null").groupBy(F.when(F.col("message").startswith("listening"), "n").otherwise("req").alias("form")).agg(F.count("*").alias("n")))
query("j5_paired_requests", PAIRS + "select source, seq, req_id, kind, paired, submit_us, messages, case when latency_ms > 0 then ts_us - cast(round(latency_ms*1000) as bigint) else submit_us end as started_us from pairs")(
    lambda t: engine_rows(t).select("source", "seq", "req_id", "kind", "paired", "submit_us", "messages", "started_us")
)
query("j5_abandoned", PAIRS + ", o as (select source, epoch, req_id, arg_max(kind, seq) as last, max(max_epoch) as newest from (select *, max(epoch) over (partition by source) as max_epoch from e) y where kind <> 'listening' group by 1, 2, 3) select source, count(*) as abandoned from o where last = 'submit' and epoch < newest group by 1")(
    lambda t: correlate.abandoned(parse.engine_n_lines(t("n_log")))
)


def finished(t) -> DataFrame:
    return engine_rows(t).withColumn("finish", F.coalesce("finish", F.when(F.col("kind") == "error", "error"))).withColumn("model", F.when(F.col("req_id") % 7 != 0, F.concat(F.lit("m"), (F.col("req_id") % 3).cast("string"))))


@windowed
def _engine(query: Callable, A: int, B: int, W0: int, W1: int, SHIP0: int, SHIP1: int) -> None:
    FIN = PAIRS + f", r as (select * exclude (finish), f as finish, case when req_id % 7 <> 0 then concat('m', cast(req_id % 3 as varchar)) end as model from pairs where ts_us >= {W0} and ts_us < {W1})"
    query("a2_engine_summary", FIN + f""", tt as ({rank_sql("select ttft_ms as v from r", "", {"ttft_p50": 0.5, "ttft_p90": 0.9}, "linear")})
select count(*) as requests, count(*) filter (where finish = 'error') as errors, count(*) filter (where not paired) as unpaired, cast(coalesce(sum(output_tokens),0) as bigint) as output_tokens, cast(coalesce(sum(prompt_tokens),0) as bigint) as prompt_tokens,
 coalesce(sum(cached_tokens)/sum(prompt_tokens+cached_tokens),0) as cache_hit_rate, round(avg(decode_tps),6) as decode_tps_mean, round(avg(prefill_tps),6) as prefill_tps_mean, any_value(tt.ttft_p50) as ttft_p50, any_value(tt.ttft_p90) as ttft_p90 from r, tt""")(
        lambda t: _round(summary.engine_summary(finished(t), W0, W1), 6, "decode_tps_mean", "prefill_tps_mean")
    )
    query("w6_engine_series", FIN + f"""select g.bucket, count(r.seq) as requests, count(r.seq) filter (where finish = 'error') as errors, coalesce(sum(output_tokens),0)/3600 as out_tok_per_s, round(avg(decode_tps),6) as decode_tps, round(avg(ttft_ms),4) as ttft_mean
from {grid(W0, W1, 3600, True)} g left join r on cast(floor(r.ts_us/3600000000) as bigint)*3600000000 = g.bucket group by 1""")(lambda t: _round(_round(series.engine_series(finished(t), W0, W1, 3600), 6, "decode_tps"), 4, "ttft_mean"))
    query("b2_engine_by_model", FIN + "select coalesce(model,'unknown') as model, count(*) as requests, round(avg(ttft_ms),4) as ttft_ms, round(avg(decode_tps),6) as decode_tps, cast(coalesce(sum(output_tokens),0) as bigint) as output_tokens, max(ts_us) as last_us from r group by 1")(
        lambda t: _round(_round(breakdown.engine_by_model(finished(t), W0, W1), 4, "ttft_ms"), 6, "decode_tps")
    )
    query("b9_finish_reasons", FIN + "select coalesce(finish,'unknown') as finish, count(*) as n from r group by 1")(lambda t: breakdown.counts_by(finished(t), W0, W1, "finish"))


def _ordered(t) -> DataFrame:
    return t("requests").selectExpr("source", "ts_us", "class", "k", "row_number() over (partition by source order by ts_us, id) as seq")


def _ordered_ids(t) -> DataFrame:
    return t("requests").selectExpr("source", "id", "k", "ts_us as ts", "row_number() over (partition by source order by ts_us, id) as seq")


FIFO = """with o as (select source, ts_us, class, k, row_number() over (partition by source order by ts_us, id) as seq from {requests}), v as (select *, case when class = 'health' then 1 else -1 end as d from o where class = 'health' or k % 3 <> 0),
 b as (select *, sum(d) over w as balance from v window w as (partition by source order by seq)), c as (select *, least(0, min(balance) over (partition by source order by seq)) as low from b),
 f as (select *, d < 0 and low < coalesce(lag(low) over (partition by source order by seq), 0) as lost, balance - low as rest from c),
 g as (select *, case when d > 0 then sum(case when d > 0 then 1 else 0 end) over (partition by source order by seq) else sum(case when d < 0 and not lost then 1 else 0 end) over (partition by source order by seq) end as n from f)
select a.source, a.seq, w.seq as w_seq, case when a.lost then 'none' when a.rest > 0 then 'ambiguous' else 'exact' end as "match" from g a left join g w on w.d > 0 and w.source = a.source and w.n = a.n and not a.lost where a.d < 0"""
query("j2_fifo_join", FIFO)(lambda t: correlate.fifo_join(_ordered(t).where("class = 'health'").select("source", "seq"), _ordered(t).where("class != 'health' and k % 3 != 0").select("source", "seq")).select("source", "seq", "w_seq", "match"))
query("j2_fifo_join_whole", FIFO.replace(" or k % 3 <> 0", " or true"))(lambda t: correlate.fifo_join(_ordered(t).where("class = 'health'").select("source", "seq"), _ordered(t).where("class != 'health'").select("source", "seq")).select("source", "seq", "w_seq", "match"))
#: The queue of each source as a list, row by row: what is too old leaves, an arrival is put behind, a call takes the first.
QUEUE = """with recursive o as (select source, id, ts_us, class, k, row_number() over (partition by source order by ts_us, id) as seq from {{requests}}),
 e as (select source, {seq} as seq, ts_us // 1000 as ts, class = 'health' as arrives, row_number() over (partition by source order by seq) as n from o where class = 'health' or {calls}),
 w as (select distinct source, cast(0 as bigint) as n, cast(null as bigint) as seq, cast([] as struct(seq bigint, ts bigint)[]) as q, cast(null as bigint) as task_seq, cast(null as varchar) as "match", cast([] as bigint[]) as lost from e
  union all select source, n, seq, case when arrives then list_append(live, {{'seq': seq, 'ts': ts}}) else live[2:] end, case when not arrives then live[1].seq end, case when arrives then null when len(live) = 0 then 'none' when len(live) > 1 then 'ambiguous' else 'exact' end, lost
  from (select e.source, e.n, e.seq, e.ts, e.arrives, list_filter(w.q, lambda x: e.ts - x.ts <= 30000000) as live, list_transform(list_filter(w.q, lambda x: e.ts - x.ts > 30000000), lambda x: x.seq) as lost from w join e on e.source = w.source and e.n = w.n + 1) s)
 select source, seq, task_seq, "match" from w where "match" is not null union all select source, l, l, 'orphan' from (select source, unnest(lost) as l from w) x{rest}"""
REST = " union all select source, l.seq, l.seq, 'orphan' from (select source, unnest(q) as l from w qualify n = max(n) over (partition by source)) y"


def queue_sql(calls: str, seq: str = "seq", rest: str = REST) -> str:
    return QUEUE.format(calls=calls, seq=seq, rest=rest)


query("j2_fifo_with_expiry_whole", queue_sql("true"))(lambda t: correlate.fifo_with_expiry(_ordered(t).withColumn("arrives", F.col("class") == "health").withColumn("ts_us", (F.col("ts_us") / 1000).cast("long"))))
query("j2_fifo_with_expiry", queue_sql("k % 3 <> 0"))(lambda t: correlate.fifo_with_expiry(_ordered(t).where("class = 'health' or k % 3 != 0").withColumn("arrives", F.col("class") == "health").withColumn("ts_us", (F.col("ts_us") / 1000).cast("long"))))
query("t4_forward_clock", """select source, seq, max(case when k % 4 <> 0 then ts_us end) over (partition by source order by seq) as ts_us from (select source, ts_us, k, row_number() over (partition by source order by ts_us, id) as seq from {requests}) o""")(
    lambda t: correlate.forward_clock(_ordered(t).select("source", "seq", F.when(F.col("k") % 4 != 0, F.col("ts_us")).alias("clock_us"))).select("source", "seq", "ts_us")
)
# Clocks of three kinds: up to 2 s behind the time before, further back, and far ahead once, so that all lines after it fall back.
CLOCKS = "case when k % 5 = 0 then null when k % 5 = 1 then ts - 1500000 when k % 5 = 2 then ts - 3600000000 when id % 1000 = 7 then ts + 864000000000 else ts end"
query("t4_falling_clock", f"""with recursive o as (select source, row_number() over (partition by source order by ts_us, id) as seq, {CLOCKS} as clock from (select *, ts_us as ts from {{requests}}) r),
 w as (select distinct source, cast(0 as bigint) as seq, cast(null as bigint) as ts_us from o
  union all select o.source, o.seq, case when clock is null then w.ts_us when w.ts_us - clock > 0 and w.ts_us - clock <= 2000000 then w.ts_us else clock end from w join o on o.source = w.source and o.seq = w.seq + 1)
 select source, seq, ts_us from w where seq > 0""")(
    lambda t: correlate.forward_clock(_ordered_ids(t).selectExpr("source", "seq", f"{CLOCKS} as clock_us")).select("source", "seq", "ts_us")
)
query("e4_slots_resident", """with o as (select source, ts_us, k, model, row_number() over (partition by source order by ts_us, id) as seq from {requests} where model is not null), c as (select *, case when k % 2 = 0 then 1 + k % 4 else 0 end as now from o),
 d as (select *, now - coalesce(lag(now) over (partition by source, model order by seq), 0) as change from c) select source, seq, nullif(cast(sum(change) over (partition by source order by seq) as bigint), 0) as slots from d""")(
    lambda t: correlate.slots_resident(t("requests").where("model is not null").selectExpr("source", "row_number() over (partition by source order by ts_us, id) as seq", "model", "1 + k % 4 as parallel", "k % 2 = 0 as loaded")).select("source", "seq", "slots")
)
query("e5_in_flight", "with e as (select source, started_us as t, 1 as d from {requests} union all select source, ts_us, -1 from {requests}), n as (select source, t, sum(d) as d from e group by 1, 2) select source, t as ts_us, cast(sum(d) over (partition by source order by t) as bigint) as open from n")(
    lambda t: correlate.in_flight(t("requests").select("source", F.col("started_us").alias("first_us"), "ts_us"))
)


# Streams over the events: what the sink holds once all input is read.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests as a stream."""
    path = f"{sf_dir}/events.parquet"
    raw = streams.stream_of(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(path).schema)  # a pattern: a stream's plain path must be a folder
    e = raw.selectExpr("event_id as id", "unix_micros(cast(ts as timestamp)) as ts_us", "user_id", "event_type", "value", "cast(get_json_object(props,'$.k') as bigint) as k")
    return e.selectExpr("id", "ts_us", "k", "concat('s', cast(user_id % 4 as string)) as source", "concat('10.0.0.', cast(user_id as string)) as client_ip", "case when k % 11 = 0 then null else concat('m', cast(user_id % 5 as string)) end as model", "case event_type when 'signup' then 'embed' when 'view' then 'health' else 'inference' end as class", "case event_type when 'error' then 500 else 200 end as status", "case when event_type in ('error','view') then null else cast(floor(value) as bigint) end as output_tokens", "value")


def stream_query(name: str, sql: str | None = None):
    def add(f):
        query(name, sql)(None)
        QUERIES[name] = f
        return f

    return add


@stream_query("z4_rollup_stream", "select cast(floor(ts_us/3600000000) as bigint)*3600000000 as bucket, coalesce(model,'') as model, class, count(*) as req_count, count(*) filter (where status >= 400) as err_count, cast(coalesce(sum(output_tokens),0) as bigint) as out_tokens from {requests} group by 1, 2, 3")
def z4_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.rollup_stream(_events(spark, sf_dir), "1 hour"), "complete")


@stream_query("z5_replay_safe", "select id, source from {requests}")
def z5_replay_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.drained(streams.once(twice, ["id"]).select("id", "source"))


@stream_query("z1_fifo_stream", queue_sql("k % 3 <> 0", "id", ""))
def z1_fifo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("class = 'health' or k % 3 != 0")
    return streams.drained(streams.fifo_stream(e.select("source", F.col("id").alias("seq"), (F.col("ts_us") / 1000).cast("long").alias("ts_us"), (F.col("class") == "health").alias("arrives"))))


@stream_query("z3_counter_stream", "select source, id as n, cast(c - pc as bigint) as delta from (select source, id, floor(value) as c, lag(floor(value)) over (partition by source order by id) as pc from {requests}) x where c >= pc")
def z3_counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.counter_delta_stream(_events(spark, sf_dir).select("source", F.col("id").alias("n"), F.floor("value").alias("counter"))))


@stream_query("z6_live_feed", "select source, k as task_id, max_by(id, id) as n_gen from {requests} group by 1, 2")
def z6_live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _events(spark, sf_dir).select("source", F.col("k").alias("task_id"), F.col("id").alias("seq"), F.col("id").alias("n_gen"), F.lit(0.0).alias("tg"), F.lit(0.0).alias("tg_3s"))
    return streams.drained(streams.live_feed(p), "complete").select("source", "task_id", "n_gen")


__all__ = ["engine_rows", "view"]
