"""Backfill: a whole log becomes tables. Each line is given to the parser that owns it, once; rows that are new are appended, and what they cover is rolled up."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..streaming import correlator
from . import correlate, ordered, parse, rollups, shared, tables

#: Seconds of the buckets of each rollup; the coarser one is made of the finer.
ROLLUPS = {"rollup_1m": 60, "rollup_1h": 3600}
#: Fields of slot lines that tables are made of.
_SLOT = (*correlate._FIELDS, "ckpt_index", "ckpt_total")
_PARSERS = {"access": parse.access_lines, "slot": functools.partial(parse.slot_lines, only=_SLOT), "go": parse.go_lines, "server": parse.server_lines, "kv": parse.kv_lines}
_LINE = ("source", "seq", "ts_us", "message")


def parsed_log(lines: DataFrame, owners: tuple[str, ...] = tuple(_PARSERS)) -> tuple[dict[str, DataFrame], int]:
    """Records of the lines (source, seq, ts_us, message) by owner, and how many lines there were. Lines of other than owners are counted only.

    One pass over the lines parts them by owner; each part is then read and parsed once, and written.
    """
    spark, seen = lines.sparkSession, Observation()
    path = shared.folder(spark)
    shared.note(path)
    dealt = parse.dispatch(shared.spread(lines.select(*_LINE)).observe(seen, F.count(F.lit(1)).alias("lines")))
    dealt.where(F.col("owner").isin(*owners)).write.partitionBy("owner").parquet(path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.select(*_LINE).schema)
    parts = spark.read.schema(f"{kinds}, owner string").parquet(path)
    records = {owner: parser(parts.where(F.col("owner") == owner).drop("owner")) for owner, parser in _PARSERS.items() if owner in owners}
    done = shared.together(*[lambda r=r: shared.written(r.drop("message")) for r in records.values()])
    return dict(zip(records, done, strict=True)), seen.get["lines"]


def structured_names(go: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Structured records with model where only a blob is told: the name learned for the blob before, else the manifest's (digest, model); and loaded, the name a load line loads."""
    manifests = go.sparkSession.createDataFrame([], "digest string, model string") if manifests is None else manifests
    # A load line tells no blob: it is that of the load it ends.
    loads = go.where("event in ('load_start', 'model_loaded')").select("source", "seq", "event", "blob")
    begun = ordered.running(loads, {"start": ("max", F.when(F.col("event") == "load_start", F.struct("seq", "blob")), True)})
    began = begun.where("event = 'model_loaded'").select("source", "seq", F.col("start.blob").alias("began"))
    # Most records tell their model, and load none: these are joined with nothing.
    asks = F.coalesce(F.col("event") == "model_loaded", F.lit(False)) | (F.col("model").isNull() & F.col("blob").isNotNull())
    go = go.drop("began", "loaded")
    g = go.where(asks).join(began, ["source", "seq"], "left").withColumn("of", F.coalesce("blob", "began"))
    learned = go.where("model is not null and blob is not null").select("source", "seq", "blob", "model")
    blank = g.where("model is null and of is not null").select("source", "seq", F.col("of").alias("blob"))
    found = correlate.with_model_names(blank, learned, manifests).select("source", "seq", F.col("model").alias("found"))
    g = g.join(found, ["source", "seq"], "left")
    load = F.col("event") == "model_loaded"
    return g.withColumn("loaded", F.when(load, F.coalesce("model", "found"))).withColumn("blob", F.when(load, F.col("of")).otherwise(F.col("blob"))).withColumn("resolved", F.coalesce("model", "found")).drop("of", "began", "found").unionByName(go.where(~asks).withColumns({"loaded": F.lit(None).cast("string"), "resolved": F.col("model")}))


def request_rows(access: DataFrame, slot: DataFrame, go: DataFrame) -> DataFrame:
    """Requests of access records joined with tasks and named; other endpoints as they are, and orphans."""
    columns = {"endpoint": "string", "method": "string", "client_ip": "string", "status": "int", "latency_ms": "double", "class": "string"}
    said = go.where("model <> '' or event in ('model_loaded', 'unload')")
    finished = F.coalesce((F.col("event") == "request_finished") & (F.col("model") != ""), F.lit(False))
    named = F.when(finished, F.concat(F.lit("named" + parse.MARK), "model")).otherwise(F.concat(F.lit("go" + parse.MARK), F.to_json(F.struct("event", "model", "loaded"))))
    told = [(slot, correlator.slot_text()), (access, correlator.call_text(tuple(columns))), (said, named)]
    met = correlator.in_parts(functools.reduce(DataFrame.unionByName, [t.select("source", "seq", "ts_us", line.alias("line")) for t, line in told]), said)
    met = met.withColumn("call", F.from_json("call", ", ".join(f"`{n}` {kind}" for n, kind in columns.items())))
    orphan = F.col("match") == "orphan"
    met = met.select(
        "source", "seq", "ts_us", "match", "model", *[F.col(n).alias(f"w_{n}") for n in correlator.TASK], "call.method", "call.client_ip", "call.status", "call.latency_ms",
        F.when(orphan, "(unclaimed)").otherwise(F.col("call.endpoint")).alias("endpoint"), F.when(orphan, "inference").otherwise(F.col("call.class")).alias("class"),
    )
    named = correlate.derived(met)
    numbers = {"prompt_tokens": "long", "prompt_tokens_total": "long", "output_tokens": "long", "context_tokens": "long", "n_ctx_slot": "long", "ttft_ms": "double", "decode_ms": "double", "total_ms": "double", "decode_tps": "double", "task_id": "long"}
    return named.select(
        "source", "seq", "ts_us", "started_us", "endpoint", "method", "client_ip", "status", "latency_ms", "class", "model",
        *[F.col(f"w_{c}").cast(kind).alias(c) for c, kind in numbers.items()], "cached_tokens", "queue_ms", "match",
    )


def event_rows(slot: DataFrame, go: DataFrame, kv: DataFrame) -> DataFrame:
    """Events: unloads, idle timers, problems, truncations, loads with how long they took, and loads whose cache lies on the CPU in part."""
    own = correlate.server_events(go, slot)
    loads = correlate.load_events(go.where("event in ('load_start', 'model_loaded')"))
    began = go.where("event = 'load_start'").select("source", "seq", "num_ctx", "parallel", "port")
    # Sizes of the cache belong to the load that began last before them.
    lines = kv.select("source", "seq").unionByName(loads.select("source", "seq")).withColumn("start", F.lit(False)).unionByName(began.select("source", "seq").withColumn("start", F.lit(True)))
    of = shared.written(ordered.running(lines, {"load_seq": ("max", F.when(F.col("start"), F.col("seq")), True)}).where("not start").select("source", "seq", "load_seq"))
    sizes = kv.where("kind = 'kv_buffer'").join(of, ["source", "seq"]).withColumnRenamed("load_seq", "load")
    placed = correlate.kv_placement(sizes)
    e = loads.drop("num_ctx", "parallel", "port").join(of, ["source", "seq"]).join(began.select("source", F.col("seq").alias("load_seq"), "num_ctx", "parallel", "port"), ["source", "load_seq"], "left")
    e = e.join(placed.select("source", F.col("load").alias("load_seq"), "kv_mib", "cpu_mib", "cpu_share"), ["source", "load_seq"], "left")
    none = F.lit(None)
    detail = F.to_json(F.struct("blob", "num_ctx", "parallel", "port", "kv_mib", "cpu_mib"))
    loaded = e.select("source", "seq", "ts_us", F.lit("model_loaded").alias("kind"), F.lit("INFO").alias("level"), F.col("loaded").alias("model"), "msg", F.col("load_ms").alias("duration_ms"), detail.alias("detail"))
    said = F.format_string("%.0f%% of the live cache is on the CPU: %.0f of %.0f MiB", F.col("cpu_share") * 100, "cpu_mib", "kv_mib")
    spilt = e.where("cpu_mib > 0").select("source", "seq", "ts_us", F.lit("kv_offload").alias("kind"), F.lit("WARN").alias("level"), F.col("loaded").alias("model"), said.alias("msg"), none.cast("double").alias("duration_ms"), F.to_json(F.struct("kv_mib", "cpu_mib", "cpu_share")).alias("detail"))
    return own.unionByName(loaded).unionByName(spilt)


def log_tables(lines: DataFrame, manifests: DataFrame | None = None) -> dict[str, DataFrame]:
    """requests, events and cache_samples of the lines of servers (source, seq, ts_us, message). seq is unique within a source."""
    return tables_of(parsed_log(lines)[0], manifests)


def tables_of(records: dict[str, DataFrame], manifests: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of parsed_log()."""
    slot, go = records["slot"], shared.written(structured_names(records["go"], manifests))
    caches = slot.unionByName(records["server"], allowMissingColumns=True)
    requests, samples, events = shared.together(
        lambda: request_rows(records["access"], slot, go),
        lambda: shared.written(correlate.cache_samples(caches)),
        lambda: shared.written(event_rows(slot, go, records["kv"])),
    )
    # The model mentioned last up to a line, for lines that name none.
    asks = samples.select("source", "seq").unionByName(events.where("kind = 'truncation'").select("source", "seq")).distinct()
    said = go.where("model is not null").select("source", "seq", "model").unionByName(asks, allowMissingColumns=True)
    last = ordered.running(said, {"recent": ("max", F.when(F.col("model").isNotNull(), F.struct("seq", "model")), True)}).where("model is null").select("source", "seq", F.col("recent.model").alias("recent"))
    last = shared.written(last)
    return {
        "requests": requests,
        "events": events.join(last, ["source", "seq"], "left").withColumn("model", F.when(F.col("kind") == "truncation", F.coalesce("model", "recent")).otherwise(F.col("model"))).drop("recent"),
        "cache_samples": samples.join(last, ["source", "seq"], "left").withColumnRenamed("recent", "model"),
    }


def backfill(lines: DataFrame, folder: str, manifests: DataFrame | None = None) -> DataFrame:
    """Take the lines of a log into the tables under folder; table, read, added: a row for each table and one for the lines.

    A second run adds nothing: rows go by the keys of their table, the first of a key by seq. Rollups are made anew for all hours
    that the requests of this log touch.
    """
    spark = lines.sparkSession
    keys = {"requests": tables.KEYS["requests"], "events": tables.KEYS["events"], "cache_samples": ("source", "ts_us", "seq")}

    def taken(name: str, rows: DataFrame) -> tuple[str, int, int, int | None, int | None]:
        seen = Observation()
        rows = shared.written(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("low"), F.max("ts_us").alias("high")))
        told = seen.get
        return name, told["n"], tables.append_first_wins(rows, f"{folder}/{name}", keys[name], "seq"), told["low"], told["high"]

    with shared.released(spark):
        records, n = parsed_log(lines)
        found = shared.together(*[lambda name=name, rows=rows: taken(name, rows) for name, rows in tables_of(records, manifests).items()])
        low, high = next((f[3], f[4]) for f in found if f[0] == "requests")
        if low is not None:
            refresh_rollups(spark, folder, low, high)
    return spark.createDataFrame([("lines", n, None), *[f[:3] for f in found]], "table string, read long, added long")


def refresh_rollups(spark: SparkSession, folder: str, since_us: int | None = None, until_us: int | None = None) -> None:
    """Rebuild the rollups under folder from its requests, for all whole hours that [since, until] touches: by default, from the first request to the last."""
    requests = tables.table_at(spark, f"{folder}/requests")
    if requests is None:
        return
    if since_us is None or until_us is None:
        low, high = requests.agg(F.min("ts_us"), F.max("ts_us")).first()
        since_us, until_us = low if since_us is None else since_us, high if until_us is None else until_us
    own = rollups.touched_buckets(requests, since_us, until_us, max(ROLLUPS.values()))
    made = None
    with shared.released(spark):
        for name, step in ROLLUPS.items():
            made = shared.written(rollups.build_rollup(own, step) if made is None else rollups.coarsen(made, step))
            tables.upsert_last_wins(made.withColumn("ts_us", F.col("bucket")).withColumn("made", F.current_timestamp()), f"{folder}/{name}", ("bucket", "model", "class"), "made")
