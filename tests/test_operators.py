"""Operators on literal rows, and against short folds on random ones."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from opsweave.functions import exprs
from opsweave.operators import correlate, deltas, intervals, parse, polls, summary, tables
from opsweave.operators.percentiles import exact_percentiles
from opsweave.sources import readers
from opsweave.streaming import streams

S = 1_000_000


def lines(spark, *messages, ts=None):
    return spark.createDataFrame([("a", i, (ts[i] if ts else i * 10_000), m) for i, m in enumerate(messages)], "source string, seq long, ts_us long, message string")


def test_durations(spark):
    cases = {"16.862061865s": 16862.061865, "33.313µs": 0.033313, "1m30s": 90000.0, "2h": 7.2e6, "5": None, "1s!": None, "": None, " 250ms ": 250.0}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", exprs.duration_ms(F.col("t")).alias("ms")).collect()
    for r in rows:
        assert r.ms == pytest.approx(cases[r.t]) if cases[r.t] is not None else r.ms is None


def test_windows_and_steps():
    assert exprs.window_us("15m") == 900 * S and exprs.window_us("1.5h") == 5400 * S and exprs.window_us("2w") == 14 * 86400 * S
    for bad in ("", "5", "h", "5y", "1.h", "-1h"):
        with pytest.raises(ValueError):
            exprs.window_us(bad)
    assert exprs.pick_step(3600 * S) == 15 and exprs.pick_step(30 * 86400 * S) == 10800
    assert [exprs.pick_grain(h * 3600 * S) for h in (6, 7, 168, 169)] == ["raw", "1m", "1m", "1h"]


def test_histogram_percentiles_are_bounds(spark):
    def p(values, q):
        h = spark.createDataFrame([(v,) for v in values], "v double").agg(exprs.hist_counts(F.col("v")).alias("h"))
        return h.select(exprs.hist_percentile(F.col("h"), q).alias("p")).first().p

    assert (p([80.0, 90.0, 120.0], 0.5), p([80.0, 90.0, 120.0], 0.99)) == (100.0, 200.0)
    assert p([1e7], 0.5) == 300000.0 and p([], 0.5) is None and p([None, 10.0], 0.5) == 10.0


def test_exact_percentiles_match_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice("ab") if r.random() < 0.9 else None, round(r.uniform(-5, 5), r.choice([0, 3]))) for _ in range(700)]
    qs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    for rule, at in (("near", lambda q, n: min(n - 1, max(0, round(q * n + 0.5) - 1))), ("linear", lambda q, n: round(q * (n - 1)))):
        got = exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, rule).collect()
        for x in got:
            own = sorted(v for g, v in rows if g == x.g)
            assert x.n == len(own) and [x[k] for k in qs] == [own[at(q, len(own))] for q in qs.values()]
    assert exact_percentiles(spark.createDataFrame([(100.0,), (200.0,), (300.0,), (400.0,), (500.0,)], "v double"), [], "v", {"m": 0.5}, "linear").first().m == 300.0


def test_fifo_join_matches_a_queue(spark):
    r = random.Random(2)
    events = [(s, i, i * S, r.random() < 0.5) for s in ("x", "y") for i in range(300)]
    want = {}
    for s in ("x", "y"):
        q = deque()
        for _, i, _, arrives in (e for e in events if e[0] == s):
            if arrives:
                q.append(i)
            else:
                want[s, i] = (q.popleft(), "ambiguous" if len(q) else "exact") if q else (None, "none")
    e = spark.createDataFrame(events, "source string, seq long, ts_us long, arrives boolean")
    got = correlate.fifo_join(e.where("arrives").select("source", "seq"), e.where("not arrives").select("source", "seq")).collect()
    assert {(x.source, x.seq): (x.w_seq, x.match) for x in got} == want
    # Nothing waits for 30 s here: with expiry the answer is the same, and what is left are orphans.
    folded = correlate.fifo_with_expiry(e.withColumn("ts_us", F.col("seq"))).collect()
    assert {(x.source, x.seq): (x.task_seq, x.match) for x in folded if x.match != "orphan"} == want


def test_fifo_orphans():
    f = correlate.Fifo()
    assert f.feed([(1, 0, True), (2, 31 * S, False), (3, 32 * S, True), (4, 33 * S, False)]) == [(1, 1, "orphan"), (2, None, "none"), (4, 3, "exact")]


def test_sweep_matches_a_fold(spark):
    r = random.Random(3)
    rows = [(a := r.randrange(0, 20_000), a + r.randrange(0, 4000)) for _ in range(200)]
    i = spark.createDataFrame([(a * S, b * S) for a, b in rows], "started_us long, ts_us long")
    start, end = 1000 * S, 18_500 * S
    want: dict[int, int] = {}
    for t in range(1000, 18_500):
        level = sum(a <= t < b for a, b in rows)
        want[level] = want.get(level, 0) + 1
    got = intervals.overlap_segments(i, start, end, 1800).groupBy("level").agg((F.sum(F.col("t1") - F.col("t0")) / S).alias("s")).collect()
    assert {x.level: x.s for x in got} == want


def test_concurrency_literal(spark):
    rows = [(1, "inference", 0, 40 * S), (2, "inference", 20 * S, 40 * S), (3, "health", 0, 100 * S)]
    r = spark.createDataFrame(rows, "id long, class string, started_us long, ts_us long")
    got = intervals.concurrency(r, 0, 50 * S, 2).first()
    assert (got.peak, got.busy_s, got.saturated_s, got.mean) == (2, 40.0, 20.0, 60 / 50)
    assert intervals.concurrency(r.limit(0), 0, 50 * S).first().utilisation is None


def test_sole_client(spark):
    r = spark.createDataFrame([(1, "a", 0, 10 * S), (2, "a", 20 * S, 30 * S), (3, "a", 90 * S, 95 * S)], "id long, source string, started_us long, ts_us long")
    c = spark.createDataFrame([("a", 5 * S, "x"), ("a", 25 * S, "x"), ("a", 25 * S, "y")], "source string, ts_us long, client string")
    assert [(x.id, x.client) for x in intervals.sole_clients(r, c).collect()] == [(1, "x")]


def test_histogram_delta_and_layouts(spark):
    rows = [("a", 0, 1, 4, 9, 12), ("a", 1 * S, 2, 5, 11, 15), ("a", 2 * S, 3, 1, 2, 3)]
    d = deltas.histogram_deltas(spark.createDataFrame(rows, "source string, ts_us long, n long, x long, y long, z long"), ["x", "y", "z"])
    assert [r.counts for r in d.orderBy("n").collect()] == [None, [1, 1, 1], None]
    h = spark.createDataFrame([(0, [1.0, None], [1, 0], 1, 0.5), (1, [2.0, None], [5, 0], 5, 5.0), (2, [1.0], [1, 2], 3, 1.0)], "ts_us long, bounds array<double>, counts array<long>, observations long, sum_value double")
    got = deltas.histogram_range(h, 0, 10).first()
    assert (got.counts, got.rows_skipped, got.mean, got.p50) == ([1, 0], 2, 0.5, 1.0)


def test_layout_run_seen_last_counts(spark):
    rows = [("a", i * S, i, [1, 0], layout) for i, layout in enumerate("ppqqp")]
    m = deltas.minute_histograms(spark.createDataFrame(rows, "source string, ts_us long, n long, counts array<long>, layout string"), 60, "layout")
    assert [(r.layout, r.counts) for r in m.collect()] == [("p", [1, 0])]


def test_slot_and_access_lines(spark):
    access = '[GIN] 2026/01/02 - 03:04:05 | 200 | 16.862061865s | 10.0.0.7 | POST     "/api/chat?x=1"'
    a = parse.access_lines(lines(spark, access, "noise")).first()
    assert (a.status, a.latency_ms, a.client_ip, a.method, a["class"]) == (200, pytest.approx(16862.061865), "10.0.0.7", "POST", "inference")
    head = "slot print_timing: id  3 | task 42 | "
    s = parse.slot_lines(lines(spark, head + "prompt eval time =    1254.52 ms /    55 tokens (   22.81 ms per token,    43.84 tokens per second)", head + "new prompt, n_ctx_slot = 32768, n_keep = 4, task.n_tokens = 1408", head + "erased invalidated context checkpoint (pos_min = 1, size = 12.5 MiB)", head + "stop processing: n_tokens = 1600, truncated = 0", head + "what"))
    got = {r.kind: r for r in s.collect()}
    assert got["prompt_eval"].ttft_ms == 1254.52 and got["new_prompt"].prompt_tokens_total == 1408 and got["release"].context_tokens == 1600
    assert (got["ckpt_evict"].reason, got["ckpt_evict"].ckpt_mib, got["ckpt_evict"].task_id) == ("invalidated", 12.5, 42) and len(got) == 4


def test_server_and_cache_lines(spark):
    s = parse.server_lines(lines(spark, "srv  update: - cache state: 5 prompts, 8010.969 MiB (limits: 8192.000 MiB, 65536 tokens, 70000 est)", "srv  x: - cache state: 1 prompts, 1.0 MiB (limits: 0.0 MiB, 0 tokens, 0 est)", "srv  x: prompt cache update took 364.22 ms")).orderBy("seq").collect()
    assert s[0].usage == pytest.approx(0.978, abs=1e-3) and s[1].usage is None and s[2].update_ms == 364.22
    k = parse.kv_lines(lines(spark, "llama_kv_cache: CUDA0 KV buffer size = 1024.00 MiB", "llama_kv_cache: size = 512.00 MiB (  4096 cells,  32 layers,  1/1 seqs), K (f16):  256.00 MiB, V (f16):  256.00 MiB")).orderBy("seq").collect()
    assert (k[0].device, k[0].kv_mib) == ("CUDA0", 1024.0) and (k[1].cells, k[1].k_type, k[1].v_mib) == (4096, "f16", 256.0)


def test_structured_lines(spark):
    g = parse.go_lines(lines(spark, 'time=2026-01-02T03:04:05.678+02:00 level=INFO source=sched.go:1 msg="llama-server started in 2.50 seconds" runner.name=registry.ollama.ai/library/llama3.2:3b runner.parallel=4', 'time=x level=INFO source=s msg="starting llama-server" cmd="/bin/l --model /b/sha256-1 --port 1234 -c 4096 -np 2"', 'time=x level=WARN source=s msg="it\'s \\"bad\\"" k=v')).orderBy("seq").collect()
    assert (g[0].event, g[0].load_ms, g[0].model, g[0].parallel) == ("model_loaded", 2500.0, "llama3.2:3b", 4)
    assert (g[1].event, g[1].blob, g[1].port, g[1].num_ctx, g[1].parallel) == ("load_start", "/b/sha256-1", 1234, 4096, 2)
    assert (g[2].event, g[2].msg, g[2].kv["k"]) == ("problem", 'it\'s "bad"', "v")


def test_engine_lines(spark):
    done = "[req 2] done finish=stop_token prompt=10 gen=1 cache=90 reuse=prefix ttft=100ms prefill=5.5tok/s decode=n/a wall=0.05s speculative=mtp 2.5tok/round (75.0%)"
    n = parse.engine_n_lines(lines(spark, done, "[req 2] error boom", "listening on http://h:1 (model id: m1, ctx)")).orderBy("seq").collect()
    assert (n[0].prompt_tokens_total, n[0].decode_tps, n[0].decode_ms, n[0].draft_accept, n[1].error, n[2].model) == (100, None, 0.0, 0.75, "boom", "m1")
    e = parse.engine_e_lines(lines(spark, "#2 chat/completions (stream): 1,225 tokens generated at 49.8 T/s · prompt 107,134 tokens, none cached, 107,134 new in 146.4 s (732 T/s) · first token 146.4 s, total 171.0 s · draft 825/1200 accepted (69%)", "Loading model /a/b/c/ (x)")).orderBy("seq").collect()
    assert (e[0].output_tokens, e[0].cached_tokens, e[0].draft_mean_len, e[0].prefill_tps, e[1].model) == (1225, 0, 0.6875, 732.0, "c")
    p = parse.proxy_lines(lines(spark, "x REQ backend=None /v1/chat from=10.0.0.1 model=m msgs=3 prompt=unknown limit=4096 max_tokens=1,000 stream=True")).first()
    assert (p.backend, p.prompt_tokens, p.context_limit, p.max_tokens, p.stream, p.model) == (None, None, 4096, 1000, True, "m")


def test_image_lines(spark):
    i = parse.image_lines(lines(spark, "10:00:00.1 [Info] Generated an image in 0.50 sec (prep) and 2.25 sec (gen)", "10:00:01 [Error] [WebAPI] Error handling API request 'X' for user 'u': bad", "[ComfyUI-0/STDERR] \x1b[31mboom\x1b[0m", "[ComfyUI-0/STDERR]  ", "10:00:02 [Warning] odd", "10:00:03 [Info] plain")).orderBy("seq").collect()
    assert [r.kind for r in i] == ["generation_finished", "webapi_error", "backend_stderr", "problem"]
    assert (i[0].prep_ms, i[0].gen_ms, i[1].route, i[1].user, i[1].reason, i[2].text, i[2].backend_index) == (500.0, 2250.0, "X", "u", "bad", "boom", 0)


def test_prometheus_samples(spark):
    body = '# HELP x\nx_total{model_name="m",a="q\\"z\\\\n"} 3\nh_bucket{le="0.5",model_name="m"} 2\nh_bucket{le="+Inf"} 5\nbad line here {\ny NaN\nz +Inf'
    p = parse.prometheus_lines(spark.createDataFrame([("a", body)], "source string, body string")).collect()
    assert [(r.name, r.value) for r in p] == [("x_total", 3.0), ("h_bucket", 2.0), ("h_bucket", 5.0), ("z", float("inf"))]
    assert p[0].labels["a"] == 'q"z\n'  # in this order: quote, backslash, line end
    c = parse.classified(parse.prometheus_lines(spark.createDataFrame([("a", body)], "source string, body string")), ["z"], ["x_total"]).collect()
    assert [(r.metric, r.kind, r.bound) for r in c] == [("x_total", "counter", None), ("h", "bucket", 0.5), ("h", "bucket", None), ("z", "gauge", None)]


def test_correlation_of_a_request(spark):
    head = "slot f: id 0 | task 7 | "
    log = lines(spark, head + "new prompt, n_ctx_slot = 4096, n_keep = 0, task.n_tokens = 1408", head + "prompt eval time = 1254.52 ms / 55 tokens ( 1.0 ms per token, 1.0 tokens per second)", head + "eval time = 14591.31 ms / 500 tokens ( 1.0 ms per token, 1.0 tokens per second)", head + "total time = 15845.83 ms / 555 tokens", head + "stop processing: n_tokens = 1908, truncated = 0", '[GIN] 2026/01/02 - 03:04:05 | 200 | 16.862061865s | 10.0.0.7 | POST "/api/chat"')
    tasks = correlate.tasks_of(parse.slot_lines(log))
    calls = parse.access_lines(log).where(F.col("class").isin("inference", "embed"))
    row = correlate.derived(correlate.fifo_join(tasks, calls)).first()
    assert row.match == "exact" and row.cached_tokens == 1408 - 55
    assert row.queue_ms == pytest.approx(16862.061865 - 15845.83)


def test_names_follow_the_scheduler(spark):
    rows = spark.createDataFrame([("a", 10, "exact"), ("a", 20, "none"), ("a", 30, "exact"), ("a", 50, "exact")], "source string, seq long, match string")
    names = spark.createDataFrame([("a", 11, "m1"), ("a", 31, "m2")], "source string, seq long, model string")
    loads = spark.createDataFrame([("a", 1, "m1"), ("a", 5, "m2")], "source string, seq long, model string")
    got = {r.seq: (r.model, r.match) for r in correlate.named_rows(rows, names, loads).collect()}
    assert got == {10: ("m1", "exact"), 20: (None, "none"), 30: ("m2", "exact"), 50: ("m2", "ambiguous")}


def test_model_names_by_blob(spark):
    rows = spark.createDataFrame([("a", 5, "/m/sha256-1"), ("a", 9, "/m/sha256-1"), ("a", 9, "/m/sha256-2")], "source string, seq long, blob string").dropDuplicates(["seq", "blob"])
    learned = spark.createDataFrame([("a", 7, "/m/sha256-1", "x")], "source string, seq long, blob string, model string")
    listed = spark.createDataFrame([("sha256:1", "one"), ("sha256:2", "two")], "digest string, model string")
    got = {(r.seq, r.blob[-1]): r.model for r in correlate.with_model_names(rows.where("blob like '%1'"), learned, listed).collect()}
    assert got == {(5, "1"): "one", (9, "1"): "x"}


def test_cache_samples(spark):
    rows = [(1, "ckpt_evict", "crowded", None, None), (2, "cache_save", None, None, None), (3, "cache_state", None, 0.9, None), (4, "cache_update", None, None, 5.0), (5, "ckpt_restore", None, None, None), (6, "cache_state", None, 0.8, None), (7, "ckpt_create", None, None, None), (8, "cache_state", None, 0.7, None), (9, "cache_update", None, None, 7.0), (10, "cache_update", None, None, 8.0)]
    r = spark.createDataFrame([("a", s, s, k, why, None, None, u, None, None, None, ms) for s, k, why, u, ms in rows], "source string, seq long, ts_us long, kind string, reason string, ckpt_index int, ckpt_total int, usage double, used_mib double, limit_mib double, prompts long, update_ms double")
    got = [(x.usage, x.update_ms, x.evictions, x.saves, x.restores, x.ckpt_created) for x in correlate.cache_samples(r).orderBy("ts_us").collect()]
    assert got == [(0.9, 5.0, 1, 1, 0, 0), (0.8, None, 0, 0, 1, 1), (0.7, 7.0, 0, 0, 0, 0), (None, 8.0, 0, 0, 0, 0)]


def test_loads_and_placement(spark):
    rows = [(1, "load_start", "b1", 0), (2, "model_loaded", None, S), (3, "model_loaded", "b1", 2 * S), (4, "model_loaded", "b1", 9 * S), (5, "load_start", "b2", 10 * S), (6, "model_loaded", None, 10 * S)]
    r = spark.createDataFrame([("a", s, e, b, t) for s, e, b, t in rows], "source string, seq long, event string, blob string, ts_us long")
    assert [(x.seq, x.blob) for x in correlate.load_events(r).orderBy("seq").collect()] == [(2, "b1"), (4, "b1"), (6, "b2")]
    kv = spark.createDataFrame([("a", 1, "kv_buffer", "CUDA0", 3.0), ("a", 1, "kv_buffer", "CPU", 1.0)], "source string, load long, kind string, device string, kv_mib double")
    p = correlate.kv_placement(kv).first()
    assert (p.cpu_share, p.level) == (0.25, "WARN")


def test_clocks(spark, tmp_path):
    log = lines(spark, "time=2026-01-02T03:04:05.123456789+02:00 level=X", "[GIN] 2026/01/02 - 03:04:04 | x", "no clock", "[GIN] 2026/01/02 - 02:00:00 | x")
    c = readers.with_clock(log)
    got = [r.ts_us for r in correlate.forward_clock(c.select("source", "seq", "clock_us")).orderBy("seq").collect()]
    first = 1767315845123456
    assert got == [first, first, first, 1767312000 * S]
    banner = lines(spark, "== X logs 2026-09-09 15:19 ==", "23:59:58 [Info] a", "00:00:01.5 [Info] b", "plain")
    ts = [r.ts_us for r in readers.banner_clock(banner).orderBy("seq").collect()]
    assert ts[2] - ts[1] == 3_500_000 and ts[3] is None and ts[1] == 1788998398 * S


def test_readers(spark, tmp_path):
    (tmp_path / "j.json").write_text("\n".join([json.dumps({"__REALTIME_TIMESTAMP": "5", "MESSAGE": "hé"}), json.dumps({"__REALTIME_TIMESTAMP": "6", "MESSAGE": [104, 105]}), "{bad", json.dumps({"MESSAGE": "x"})]))
    assert [(r.ts_us, r.message) for r in readers.journal_scan(spark, str(tmp_path / "j.json")).orderBy("ts_us").collect()] == [(5, "hé"), (6, "hi")]
    (tmp_path / "c.log").write_text("2026-01-02T03:04:05.5Z one\n\nplain\n")
    got = readers.container_log_scan(spark, str(tmp_path / "c.log")).orderBy("seq").collect()
    assert [(r.ts_us, r.message) for r in got] == [(1767323045500000, "one"), (None, "plain")]
    (tmp_path / "d.csv").write_text("0, 55, 1000, 2000, 60, 99.5, 300\n1, [N/A], 1, 2, 3, 4, 5\nbad\n")
    assert [(r.gpu_index, r.util_pct) for r in readers.device_scan(spark, str(tmp_path / "d.csv")).orderBy("gpu_index").collect()] == [(0, 55.0), (1, None)]
    folder = tmp_path / "m" / "registry" / "library" / "llama" / "3b"
    folder.parent.mkdir(parents=True)
    folder.write_text(json.dumps({"layers": [{"mediaType": readers.MODEL_LAYER, "digest": "sha256:1"}, {"mediaType": "x", "digest": "sha256:2"}]}))
    assert [(r.digest, r.model) for r in readers.manifest_scan(spark, str(tmp_path / "m")).collect()] == [("sha256:1", "llama:3b")]


def test_polls(spark):
    body = json.dumps({"engine": {"model": "m", "max_context": 100}, "live": {"state": "reading", "prompt_tokens": 5, "generated": 2, "queued": 1, "tok_s": 9}, "requests": [{"time": 10, "duration_s": 2, "prompt_ms": 500, "prompt_read": 100, "drafts_offered": 4, "drafts_accepted": 3}, {"duration_s": 1}, {"time": True}]})
    p = spark.createDataFrame([("a", 1, body), ("a", 2, body)], "source string, ts_us long, body string")
    r = polls.ring_requests(p).collect()
    assert [(x.ts_us, x.started_us, x.prefill_tps, x.draft_accept, x.latency_ms) for x in r] == [(12 * S, 10 * S, 200.0, 0.75, 2000.0)]
    s = polls.state_samples(p).first()
    assert (s.running, s.queued, s.kv_tokens, s.decode_tps, s.kv_max) == (1.0, 1.0, 7.0, None, 100.0)
    ring = lambda a: json.dumps({"requests": [{"time": a + i} for i in range(12)]})
    g = polls.ring_gaps(spark.createDataFrame([("a", 1, ring(0)), ("a", 2, ring(5)), ("a", 3, ring(40))], "source string, ts_us long, body string")).orderBy("ts_us").collect()
    assert [x.may_have_gap for x in g] == [False, False, True]


def test_image_polls(spark):
    graph = json.dumps({"2": {"class_type": "L", "inputs": {"ckpt_name": "base", "x": "1"}}, "1": {"class_type": "V", "inputs": {"file": "vae.SAFETENSORS"}}})
    models = polls.workflow_models(spark.createDataFrame([("k", graph)], "key string, graph string"))
    assert {(r.role, r.name) for r in models.collect()} == {("ckpt_name", "base"), ("file", "vae.SAFETENSORS")}
    assert polls.primary_model(models).first().model == "base"
    done = json.dumps({"status": {"status_str": "success", "messages": [["execution_start", {"timestamp": 1000}], ["execution_success", {"timestamp": 3500}], ["execution_start", {"timestamp": 9}]]}})
    live = json.dumps({"status": {"messages": [["execution_start", {"timestamp": 1000}]]}})
    got = polls.history_generations(spark.createDataFrame([("a", "1", done), ("a", "2", live), ("a", "3", "{}")], "source string, prompt_id string, body string")).orderBy("prompt_id").collect()
    assert [(r.status, r.total_ms) for r in got] == [("success", 2500.0), ("running", None)]
    c = polls.connection_counts(spark.createDataFrame([("a", 1, "10.0.0.1:5"), ("a", 1, "[::ffff:10.0.0.1]:6"), ("a", 1, "[fe80::1]:7")], "source string, ts_us long, peer string"))
    assert {(r.client, r.conns) for r in c.collect()} == {("10.0.0.1", 2), ("fe80::1", 1)}


def test_tables_replay_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", 5), (90_000_000_000, "b", 6)], "ts_us long, source string, v long")
    path = str(tmp_path / "t")
    assert tables.append_first_wins(rows, path, ("ts_us", "source", "v"), "ts_us") == 3
    assert tables.append_first_wins(rows, path, ("ts_us", "source", "v"), "ts_us") == 0
    up = str(tmp_path / "u")
    tables.upsert_last_wins(spark.createDataFrame([(1, "k", 1), (2, "j", 1)], "ts_us long, key string, v long"), up, ("key",), "ts_us")
    tables.upsert_last_wins(spark.createDataFrame([(3, "k", 2)], "ts_us long, key string, v long"), up, ("key",), "ts_us")
    assert {(r.key, r.v) for r in spark.read.parquet(up).collect()} == {("k", 2), ("j", 1)}
    assert tables.prune(rows, 86_400_000_000 * 7, 7).count() == 4 and tables.prune(rows, 86_400_000_000 * 8, 7).count() == 1
    wide = tables.widened(rows, rows.withColumn("new", F.lit(1)))
    assert wide.where("new is null").count() == 4


def test_registry_rules(spark):
    polls_ = spark.createDataFrame([("a", 1, "up", "m", [0], True), ("a", 2, "down", None, None, False), ("b", 1, "up", "m", [1], True), ("b", 2, "up", None, None, True)], "source string, ts_us long, status string, model string, held array<int>, looked boolean")
    got = {r.source: (r.status, r.model, r.held) for r in tables.registry(polls_, "source", "ts_us", ("status",), ("model",), {"held": "looked"}).collect()}
    assert got == {"a": ("down", "m", [0]), "b": ("up", "m", None)}


def test_masking(spark):
    d = spark.createDataFrame([('{"token":"abc","url":"x","password":"${PW}"}',)], "c string").select(exprs.mask_secrets(F.col("c")).alias("c")).first().c
    assert json.loads(d) == {"token": "***", "url": "x", "password": "${PW}"}


def test_empty_windows_are_null_not_zero(spark):
    empty = spark.createDataFrame([], "ts_us long, usage double")
    r = summary.cache_summary(empty, 0, 10).first()
    assert (r.mean, r.max, r.samples, r.pressure) == (None, None, 0, False)
    assert not summary.coverage(empty, 5).first().complete


def test_streams_agree_with_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [("a", i, i * S, r.random() < 0.5) for i in range(200)]
    e = spark.createDataFrame(rows, "source string, seq long, ts_us long, arrives boolean")
    for k in range(4):  # four files, one batch each
        e.where((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(x.seq, x.task_seq, x.match) for x in streams.drained(streams.fifo_stream(stream)).collect()}
    want = {(x.seq, x.task_seq, x.match) for x in correlate.fifo_with_expiry(e).collect()}
    assert got <= want and {m for _, _, m in want - got} <= {"orphan"}


def test_pair_stream_agrees_with_batch(spark, tmp_path):
    kinds = ["listening", "submit", "submit", "done", "done", "done", "submit", "listening", "done", "submit", "submit", "error"]
    ids = [None, 1, 2, 2, 1, 1, 3, None, 3, 4, 4, 4]
    r = spark.createDataFrame([("a", i, i, k, q, None, None) for i, (k, q) in enumerate(zip(kinds, ids, strict=True))], "source string, seq long, ts_us long, kind string, req_id long, latency_ms double, note string")
    r.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {(x.seq, x.paired) for x in streams.drained(streams.pair_stream(spark.readStream.schema(r.schema).parquet(str(tmp_path / "in")))).collect()}
    assert got == {(x.seq, x.paired) for x in correlate.paired_requests(r, ("note",)).collect()} == {(3, True), (4, True), (5, False), (8, False), (11, True)}
    assert {x.source: x.abandoned for x in correlate.abandoned(r).collect()} == {"a": 1}


def test_refresh_folds_late_rows_in(spark, tmp_path):
    row = "id long, ts_us long, model string, class string, status int, prompt_tokens long, output_tokens long, cached_tokens long, ttft_ms double, latency_ms double"
    refresh = streams.refresh_rollups(str(tmp_path / "raw"), str(tmp_path / "roll"), 60)
    refresh(spark.createDataFrame([(1, 1 * S, "m", "inference", 200, 1, 1, 0, 5.0, 9.0), (2, 70 * S, "m", "inference", 200, 1, 1, 0, 5.0, 9.0)], row), 0)
    refresh(spark.createDataFrame([(3, 2 * S, "m", "inference", 500, 1, 1, 0, 5.0, 9.0)], row), 1)
    got = {r.bucket: (r.req_count, r.err_count) for r in spark.read.parquet(str(tmp_path / "roll")).collect()}
    assert got == {0: (2, 1), 60 * S: (1, 0)}
