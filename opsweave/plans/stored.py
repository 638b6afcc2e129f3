"""Queries of what lies in files: logs, scrapes, samples and tables are written from the given tables, then read as they would be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pick_grain, pick_step, window_us
from ..operators import parse, polls, shared, summary, tables
from ..operators.versioned import DAY_US, VersionedTable
from ..sources import readers
from .catalog import query
from .fixtures import VIEWS

VIEWS["logged"] = "select source, ts_us, id, k, value, row_number() over (partition by source order by id) as seq from {requests}"


def filed(df: DataFrame, order: str, apart: str | None = None, **options: str) -> str:
    """The folder of df (source, value): a text file for each source, its lines by order; where a column is to set them apart, several files, each in order."""
    folder = shared.folder(df.sparkSession, "files")
    df.repartition("source", *([apart] if apart else [])).sortWithinPartitions("source", order).select("source", "value").write.options(**options).partitionBy("source").text(folder)
    return folder



def scan(t, reader, text: str) -> DataFrame:
    """Lines written as text, read by reader."""
    r = t("requests")
    return reader(r.sparkSession, filed(r.selectExpr("source", "id", f"{text} as value"), "id")).withColumn("source", F.regexp_extract("file", "source=([^/]*)", 1))


query("s1_journal", "select source, ts_us, case when k % 3 = 2 then concat('été ', cast(id as varchar)) else concat('line ', cast(id as varchar)) end as message from {requests} where k % 5 > 0")(
    lambda t: scan(t, readers.journal_scan, """case when k % 5 = 0 then '{"MESSAGE":"no time"}' when k % 3 = 2 then concat('{"__REALTIME_TIMESTAMP":"', ts_us, '","MESSAGE":[', concat_ws(',', transform(sequence(1, length(hex(encode(concat('été ', id), 'utf-8'))) div 2), i -> conv(substring(hex(encode(concat('été ', id), 'utf-8')), 2*i - 1, 2), 16, 10))), '],"S":"', source, '"}')
   else concat('{"__REALTIME_TIMESTAMP":"', ts_us, '","MESSAGE":"line ', id, '"}') end""").select("source", "ts_us", "message")
)
query("s2_log_lines", "select source, seq, concat('line ', cast(id as varchar)) as message from {logged} where k % 10 > 0")(
    lambda t: scan(t, readers.log_scan, "case when k % 10 = 0 then '' else concat('line ', id) end").select("source", "seq", "message")
)
query("s3_container_lines", "select source, seq, case when k % 2 = 0 then ts_us end as ts_us, concat('line ', cast(id as varchar)) as message from {logged}")(
    lambda t: scan(t, readers.container_log_scan, "concat(case when k % 2 = 0 then concat(date_format(timestamp_micros(ts_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z ') else '' end, 'line ', id)").select("source", "seq", "ts_us", "message")
)


def startups(t) -> str:
    """A log file for each source, as if each were a start of one server: their names are in the order of sources."""
    folder = filed(t("requests").selectExpr("source", "id", "concat(source, ' ', id) as value"), "id")
    spark = t("requests").sparkSession
    out = shared.folder(spark, "starts")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(out))
    for part in fs.globStatus(jvm.Path(f"{folder}/source=*/part-*")):
        fs.rename(part.getPath(), jvm.Path(f"{out}/{part.getPath().getParent().getName()[7:]}.log"))
    return out


query("s4_startup_files", "select row_number() over (order by source, seq) as seq, concat(source, ' ', cast(id as varchar)) as message from {logged}")(lambda t: readers.startup_scan(t("requests").sparkSession, startups(t)).select("seq", "message"))
query("s4_newest_file", "select seq, concat(source, ' ', cast(id as varchar)) as message from {logged} where source = (select max(source) from {logged})")(lambda t: readers.startup_scan(t("requests").sparkSession, startups(t), newest=True).select("seq", "message"))


def answers(t, body: str) -> str:
    """The folder of answers of sources, a file for each of their days; body is an aggregate over the requests of that day."""
    days = t("requests").groupBy("source", F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(F.expr(body).alias("value"))
    spark, folder = days.sparkSession, shared.folder(days.sparkSession, "answers")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for x in days.toLocalIterator():
        out = fs.create(jvm.Path(f"{folder}/{x.source}/{x.day * DAY_US:020d}.txt"))
        out.write(bytearray(x.value.encode()))
        out.close()
    return folder


def scraped(t) -> DataFrame:
    folder = answers(t, "concat('# TYPE x gauge\\n', array_join(collect_list(concat('x{a=\"', k, '\"} ', id)), '\\n'), '\\ny NaN\\n')")
    return parse.prometheus_lines(readers.scrape_scan(t("requests").sparkSession, folder)).select("source", "ts_us", "name", F.col("labels")["a"].cast("long").alias("k"), "value")


def polled(t) -> DataFrame:
    folder = answers(t, "to_json(struct(struct('m' as model, 4096 as max_context) as engine, struct(case count(*) % 3 when 0 then 'generating' when 1 then 'reading' else 'idle' end as state, sum(k) as prompt_tokens, 5 as generated, max(k) as queued, 1 as waiting, 2 as tok_s) as live))")
    return polls.state_samples(readers.scrape_scan(t("requests").sparkSession, folder)).select("source", "ts_us", "state", "queued")


query("s5_scrape_files", "select source, ts_us // 86400000000 * 86400000000 as ts_us, 'x' as name, k, cast(id as double) as value from {requests}")(scraped)
query("s6_poll_files", "select source, ts_us // 86400000000 * 86400000000 as ts_us, case count(*) % 3 when 0 then 'generating' when 1 then 'reading' else 'idle' end as state, cast(max(k) + 1.0 as double) as queued from {requests} group by 1, 2")(polled)
query("s7_device_lines", "select gpu_index, cast(util_pct as double) as util_pct, cast(temp_c as double) as temp_c, count(*) as n from (select l_linenumber as gpu_index, l_quantity as util_pct, case when l_returnflag = 'N' then null else 30 + l_quantity end as temp_c from {lineitem}) x group by 1, 2, 3")(
    lambda t: readers.device_scan(t("lineitem").sparkSession, filed(t("lineitem").selectExpr("concat('s', l_linenumber) as source", "l_orderkey", "concat(l_linenumber, ', ', l_quantity, ', 100, 200, ', case when l_returnflag = 'N' then '[N/A]' else cast(30 + l_quantity as string) end, ', 5.5, [N/A]') as value"), "l_orderkey", "l_orderkey")).groupBy("gpu_index", "util_pct", "temp_c").agg(F.count("*").alias("n"))
)
query("s8_manifests", "select concat('sha256:', cast(id as varchar)) as digest, concat(case when k % 2 = 0 then '' else 'own/' end, source, ':', cast(k as varchar), 'b') as model from {requests}")(
    lambda t: readers.manifests_of(t("requests").selectExpr(f"concat('{{\"layers\":[{{\"mediaType\":\"x\",\"digest\":\"no\"}},{{\"mediaType\":\"{readers.MODEL_LAYER}\",\"digest\":\"sha256:', id, '\"}}]}}') as value", "concat('/m/reg/', case when k % 2 = 0 then 'library' else 'own' end, '/', source, '/', k, 'b') as file"))
)
# A banner before each source's lines; a clock that passes midnight each day of the lines.
query("t5_banner_clock", "select source, seq, 1704067200000000 + (seq - 1)*7000000000 as ts_us from {logged}")(
    lambda t: readers.banner_clock(
        t("logged").selectExpr("source", "inline(case when seq = 1 then array(struct(cast(0 as bigint) as seq, '== server logs 2024-01-01 ==' as message), struct(seq, '00:00:00.000 up' as message)) else array(struct(seq, concat(date_format(timestamp_seconds((cast(seq as bigint) - 1)*7000), 'HH:mm:ss'), '.000 x') as message)) end)")
    ).where("seq > 0").select("source", "seq", "ts_us")
)
#: Texts of windows, by k; their spans in seconds; what the span of k hours takes for a step and a grain.
_WINDOWS = {"15m": 900, "1.5h": 5400, "2d": 172800, "1w": 604800, "30s": 30}
query("w1_windows", f"select id, case k % 5 {' '.join(f'when {i} then {s}' for i, s in enumerate(_WINDOWS.values()))} end * cast(1000000 as bigint) as span_us from {{requests}}")(
    lambda t: t("requests").select("id", F.element_at(F.array(*[F.lit(window_us(w)) for w in _WINDOWS]), (F.col("k") % 5 + 1).cast("int")).alias("span_us"))
)
query("w2_steps", "select id, (1 + k)*3600 as span_s, (select min(s) from (values (5), (15), (30), (60), (300), (900), (1800), (3600), (10800), (21600), (86400)) v(s) where (1 + k)*3600/s <= 240) as step_s, case when 1 + k <= 6 then 'raw' when 1 + k <= 168 then '1m' else '1h' end as grain from {requests}")(
    lambda t: t("requests").selectExpr("id", "(1 + k)*3600 as span_s").join(F.broadcast(t("requests").sparkSession.createDataFrame([((1 + k) * 3600, pick_step((1 + k) * 3_600_000_000), pick_grain((1 + k) * 3_600_000_000)) for k in range(100)], "span_s long, step_s int, grain string")), "span_s")
)
query("x3_registry_known", "select source, max(ts_us) as ts_us, arg_max(case when k % 3 > 0 then model end, ts_us) filter (where k % 3 > 0 and (k % 2 = 0 or model is not null)) as model from {requests} group by 1")(
    lambda t: tables.registry(t("requests").selectExpr("source", "ts_us", "case when k % 3 > 0 then model end as model", "k % 3 > 0 and k % 2 = 0 as looked"), "source", "ts_us", known={"model": "looked"}).select("source", "ts_us", "model")
)


def footers(t, stored=("events", "orders", "lineitem")) -> DataFrame:
    keys = {"events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    return summary.footer_statistics(t("events").sparkSession, {n: (t(n).inputFiles(), keys[n]) for n in stored})


query("a12_footers", "select 'events' as \"table\", count(*) as n, min(event_id) as first, max(event_id) as last from {events} union all select 'orders', count(*), min(o_orderkey), max(o_orderkey) from {orders} union all select 'lineitem', count(*), min(l_orderkey), max(l_orderkey) from {lineitem}")(footers)


def pruned(t) -> DataFrame:
    """Rows of a stored table by day, after retention of five days and without one source."""
    r = t("requests").select("source", "id", "ts_us", "k")
    table = VersionedTable(r.sparkSession, shared.folder(r.sparkSession, "versions"), ("source", "id"))
    table.upsert_last_wins(r.withColumn("made", F.lit(1)), "made")
    table.upsert_last_wins(r.where("k % 10 = 0").withColumn("k", F.col("k") + 1000).withColumn("made", F.lit(2)), "made")
    dropped, purged = table.prune(1_706_659_200_000_000 - 3_600_000_000, 20), table.purge("s3")
    left = table.read().groupBy(F.floor(F.col("ts_us") / DAY_US).alias("day")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    return left.withColumns({"dropped": F.lit(dropped).cast("long"), "purged": F.lit(purged).cast("long")})


query("x4_x5_stored", "with l as (select *, ts_us >= 1706659200000000 - 3600000000 - 20*86400000000 as young from {requests}) select cast(ts_us // 86400000000 as bigint) as day, count(*) as n, cast(sum(case when k % 10 = 0 then k + 1000 else k end) as bigint) as k, (select count(*) from l where not young) as dropped, (select count(*) from l where young and source = 's3') as purged from l where young and source <> 's3' group by 1")(pruned)
