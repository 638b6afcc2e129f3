"""JSON polls and scrapes of engines as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SECOND, ratio

# Keys of a workflow's inputs that name models, and suffixes of weights.
MODEL_KEYS = ("ckpt_name", "unet_name", "vae_name", "lora_name", "clip_name", "control_net_name", "model_name", "style_model_name")
MODEL_SUFFIXES = (".safetensors", ".ckpt", ".pt", ".pth", ".bin", ".gguf", ".sft", ".onnx")
#: Fixed value: entries in a full ring of requests.
RING = 12

_STATE = "engine struct<model string, model_label string, version string, maya_version string, engine string, max_context string, context string, kv string, kv_resident string>, live struct<state string, prompt_tokens string, generated string, running string, active string, queued string, waiting string, writing string, prompt_read string, prompt_total string, tok_s string, prefill_tok_s_mean string>, hardware struct<gpu_pcie_rx_mb string, gpu_pcie_tx_mb string, cpu string, ram_used string, ram_total string>, conversation_cache struct<bytes string, parked string>, tiers struct<now struct<vram_hit string, ram_fetch string, disk string, promo string>>"
_RING = "requests array<map<string,string>>, engine struct<model string>"


def number(text: Column) -> Column:
    """A number in a poll; anything else, true and false included, is null."""
    return F.when(~F.lower(text).isin("nan", "infinity", "-infinity"), text.try_cast("double"))


def ring_requests(polls: DataFrame) -> DataFrame:
    """Request rows of polls (source, ts_us, body): every ring entry with a start, once; times in microseconds, durations in ms."""
    r = polls.select("source", "ts_us", F.from_json("body", _RING).alias("p")).select("source", "ts_us", F.col("p.engine.model").alias("model"), F.explode("p.requests").alias("h"))
    n = lambda k: number(F.col("h")[k])
    read = F.coalesce(n("prompt_read"), n("prompt_tokens"))
    out = r.where(n("time").isNotNull()).select(
        "source",
        F.col("ts_us").alias("poll_us"),
        "model",
        F.round((n("time") + F.coalesce(n("duration_s"), F.lit(0.0))) * SECOND).cast("long").alias("ts_us"),
        F.round(n("time") * SECOND).cast("long").alias("started_us"),
        F.col("h")["finish"].alias("finish"),
        n("prompt_tokens").cast("long").alias("prompt_tokens"),
        n("reused").cast("long").alias("cached_tokens"),
        n("prompt_total").cast("long").alias("prompt_tokens_total"),
        n("output_tokens").cast("long").alias("output_tokens"),
        n("prompt_ms").alias("ttft_ms"),
        (n("duration_s") * 1000).alias("latency_ms"),
        n("decode_ms").alias("decode_ms"),
        F.coalesce(n("prefill_tok_s"), F.when((read > 0) & (n("prompt_ms") > 0), read / (n("prompt_ms") / 1000))).alias("prefill_tps"),
        n("decode_tok_s").alias("decode_tps"),
        n("hit_rate").alias("expert_hit_rate"),
        n("pcie_share").alias("pcie_share"),
        n("drafts_offered").alias("drafts_offered"),
        n("drafts_accepted").alias("drafts_accepted"),
        F.when(n("drafts_offered") > 0, n("drafts_accepted") / n("drafts_offered")).alias("draft_accept"),
    )
    w = Window.partitionBy("source", "started_us", "prompt_tokens_total").orderBy("poll_us")
    return out.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "poll_us")


def ring_gaps(polls: DataFrame) -> DataFrame:
    """source, ts_us, may_have_gap: a full ring whose oldest entry is newer than all entries seen before may have skipped requests."""
    p = polls.select("source", "ts_us", F.from_json("body", _RING)["requests"].alias("r"))
    times = F.filter(F.transform("r", lambda h: number(h["time"])), lambda t: t.isNotNull())
    p = p.select("source", "ts_us", F.size("r").alias("n"), F.array_min(times).alias("oldest"), F.array_max(times).alias("newest"))
    seen = F.max("newest").over(Window.partitionBy("source").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, -1))
    return p.select("source", "ts_us", F.coalesce((F.col("n") >= RING) & (F.col("oldest") > seen), F.lit(False)).alias("may_have_gap"))


def state_samples(polls: DataFrame) -> DataFrame:
    """State samples of polls: tokens in the cache while busy, rates only while they mean something, tier numbers only while busy."""
    s = polls.select("source", "ts_us", F.from_json("body", _STATE).alias("p")).select("source", "ts_us", "p.*")
    state, n = F.col("live.state"), lambda c: number(F.col(c))
    busy = F.coalesce(state.isin("reading", "generating"), F.lit(False))
    zero = lambda c: F.coalesce(n(c), F.lit(0.0))
    running = F.when(busy & n("live.active").isNotNull(), n("live.active")).otherwise(F.coalesce(n("live.running"), F.when(busy, 1.0).otherwise(0.0)))
    tier = lambda c: F.when(busy, n(f"tiers.now.{c}"))
    return s.select(
        "source",
        "ts_us",
        state.alias("state"),
        running.alias("running"),
        (zero("live.queued") + zero("live.waiting")).alias("queued"),
        F.when(busy, zero("live.prompt_tokens") + zero("live.generated")).otherwise(0.0).alias("kv_tokens"),
        F.coalesce(F.nullif(n("engine.max_context"), F.lit(0.0)), n("engine.context")).alias("kv_max"),
        F.when(state == "generating", n("live.tok_s")).alias("decode_tps"),
        F.when(busy, n("live.prefill_tok_s_mean")).alias("prefill_tps"),
        n("hardware.cpu").alias("cpu_pct"),
        n("conversation_cache.bytes").alias("conv_cache_bytes"),
        n("live.writing").alias("writing"),
        tier("vram_hit").alias("vram_hit"),
        tier("ram_fetch").alias("ram_fetch"),
        tier("disk").alias("disk_fetch"),
    )


def instances(polls: DataFrame) -> DataFrame:
    """Model, version and context of each poll: the first of several places that says it."""
    p = polls.select("source", "ts_us", F.from_json("body", _STATE)["engine"].alias("e"))
    return p.select("source", "ts_us", F.coalesce("e.model_label", "e.model").alias("model"), F.coalesce("e.maya_version", "e.version", "e.engine").alias("version"), F.coalesce(F.nullif(number(F.col("e.max_context")), F.lit(0.0)), number(F.col("e.context"))).alias("max_context"), F.col("e.kv").alias("kv_type"))


def foreign_filtered(polls: DataFrame, expected: str) -> DataFrame:
    """polls (source, ts_us, body, engine) with data only where the expected engine answered: others keep reachability and an error, no body."""
    own = F.coalesce(F.col("engine") == expected, F.lit(False))
    return polls.withColumn("error", F.when(~own, F.concat(F.lit("another engine answered: "), F.coalesce("engine", F.lit("none"))))).withColumn("body", F.when(own, F.col("body")))


def restart_events(polls: DataFrame) -> DataFrame:
    """source, ts_us, started of polls whose start time differs from the poll before."""
    before = F.lag("started").over(Window.partitionBy("source").orderBy("ts_us"))
    return polls.withColumn("__b", before).where("__b is not null and started is not null and started != __b").drop("__b")


def workflow_models(graphs: DataFrame) -> DataFrame:
    """key, role, name, node_class, node of workflow graphs (key, graph JSON): inputs that name a model by their key, or by a weights suffix."""
    nodes = F.from_json("graph", "map<string,struct<class_type string, inputs map<string,string>>>")
    n = graphs.select("key", F.explode(nodes).alias("node", "v")).select("key", "node", F.col("v.class_type").alias("node_class"), F.explode("v.inputs").alias("role", "name"))
    low = F.lower("name")
    weights = low.endswith(MODEL_SUFFIXES[0])
    for s in MODEL_SUFFIXES[1:]:
        weights = weights | low.endswith(s)
    return n.where((F.trim("name") != "") & (F.col("role").isin(*MODEL_KEYS) | weights))


def primary_model(models: DataFrame) -> DataFrame:
    """key, model: the checkpoint, else the diffusion model, else the first in order of nodes."""
    place = F.when(F.col("role") == "ckpt_name", 0).when(F.col("role") == "unet_name", 1).otherwise(2)
    return models.groupBy("key").agg(F.min_by("name", F.struct(place, "node", "role")).alias("model"))


def history_generations(entries: DataFrame) -> DataFrame:
    """Generations of history entries (source, prompt_id, body): times of their first messages, running without an end; entries without any time are dropped."""
    m = F.from_json("body", "status struct<status_str string, messages array<array<string>>>")["status"]
    first = lambda name: F.from_json(F.get(F.get(F.filter(m["messages"], lambda x: F.get(x, F.lit(0)) == name), F.lit(0)), F.lit(1)), "timestamp double, node_id string, node_type string, exception_message string")
    e = entries.select("source", "prompt_id", m["status_str"].alias("s"), first("execution_start").alias("a"), first("execution_success").alias("b"), first("execution_error").alias("f"))
    end = F.coalesce("b.timestamp", "f.timestamp")
    return e.select(
        "source",
        "prompt_id",
        (F.coalesce(end, F.col("a.timestamp")) * 1000).cast("long").alias("ts_us"),
        (F.col("a.timestamp") * 1000).cast("long").alias("started_us"),
        F.when(end.isNull(), "running").otherwise(F.col("s")).alias("status"),
        (end - F.col("a.timestamp")).alias("total_ms"),
        F.col("f.node_id").alias("error_node"),
        F.col("f.node_type").alias("error_type"),
        F.nullif(F.substring("f.exception_message", 1, 2000), F.lit("")).alias("error_message"),
    ).where("ts_us is not null")


def residency(polls: DataFrame) -> DataFrame:
    """loaded_count and models of residency polls (source, ts_us, body)."""
    m = F.from_json("body", "models array<struct<name string, size_vram long, expires_at string>>")["models"]
    return polls.select("source", "ts_us", F.when(m.isNotNull(), F.size(m)).otherwise(0).alias("loaded_count"), m.alias("models"))


def resident_now(samples: DataFrame) -> DataFrame:
    """Models of the newest residency sample of each source."""
    last = samples.groupBy("source").agg(F.max_by("models", "ts_us").alias("models"))
    return last.select("source", F.inline("models"))


def connection_counts(sockets: DataFrame) -> DataFrame:
    """source, ts_us, client, conns of socket lines (source, ts_us, peer): ports and brackets go."""
    host = F.regexp_replace(F.regexp_replace("peer", r":\d+$", ""), r"^\[(?:::ffff:)?|\]$", "")
    return sockets.select("source", "ts_us", host.alias("client")).groupBy("source", "ts_us", "client").agg(F.count("*").alias("conns"))


def live_state(samples: DataFrame) -> DataFrame:
    """The newest sample of each source, with the largest context and queue of all of them."""
    return samples.groupBy("source").agg(F.max_by(F.struct("ts_us", "state", "running", "queued", "kv_tokens"), "ts_us").alias("now"), F.max("kv_tokens").alias("peak_kv"), F.max("queued").alias("peak_queue")).select("source", "now.*", "peak_kv", "peak_queue")


def cache_hit(rows: DataFrame, key: str) -> DataFrame:
    """Share of prompts that the cache answered, per key."""
    return rows.groupBy(key).agg(ratio(F.sum("cached_tokens"), F.sum("prompt_tokens_total")).alias("hit"))


def backend_samples(polls: DataFrame) -> DataFrame:
    """Sample rows of an image server's polls (source, ts_us, status, backends): one for the orchestrator, with backend '', and one for each backend.

    status is the JSON of the orchestrator's answer, null if it gave none: then it has no row. backends is an array of (backend, stats, queue),
    the JSON of two answers each; a backend of which one is missing is unreachable, and its figures are null.
    """
    asked = "status struct<live_gens long, waiting_gens long, loading_models long>, backend_status struct<status string>"
    stats = "devices array<struct<vram_total long, vram_free long, torch_vram_total long, torch_vram_free long>>"
    a = F.from_json("status", asked)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    device = ("vram_total", "vram_free", "torch_vram_total", "torch_vram_free")
    head = polls.where("status is not null").select(
        "source", "ts_us", F.lit("").alias("backend"), a["backend_status"]["status"].alias("status"), *[a["status"][c].alias(c) for c in ("live_gens", "waiting_gens", "loading_models")], *none("long", "queue_running", "queue_pending", *device)
    )
    each = polls.select("source", "ts_us", F.explode("backends").alias("b"))
    there = F.col("b.stats").isNotNull() & F.col("b.queue").isNotNull()
    first = F.get(F.from_json("b.stats", stats)["devices"], F.lit(0))
    waiting = F.from_json("b.queue", "queue_running array<string>, queue_pending array<string>")
    size = lambda c: F.when(there, F.coalesce(F.nullif(F.size(waiting[c]), F.lit(-1)), F.lit(0)).cast("long")).alias(c)
    own = each.select(
        "source", "ts_us", "b.backend", F.when(there, "running").otherwise("unreachable").alias("status"), *none("long", "live_gens", "waiting_gens", "loading_models"), size("queue_running"), size("queue_pending"), *[F.when(there, first[c]).alias(c) for c in device]
    )
    return head.unionByName(own)
