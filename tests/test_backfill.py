"""Backfill of a log, events, samples and registry rows on literal tables."""

import pytest

from opsweave.operators import backfill, correlate, intervals, parse, polls, summary, tables

S = 1_000_000


def lines(spark, *messages):
    return spark.createDataFrame([("a", i, i * S, m) for i, m in enumerate(messages)], "source string, seq long, ts_us long, message string")


def test_a_log_is_taken_once(spark, tmp_path):
    head = "slot f: id 0 | task 7 | "
    log = lines(
        spark,
        head + "prompt eval time = 100.50 ms / 55 tokens ( 1.0 ms per token, 1.0 tokens per second)",
        head + "total time = 400.0 ms / 99 tokens",
        head + "stop processing: n_tokens = 1908, truncated = 1",
        '[GIN] 2026/01/02 - 03:04:05 | 200 | 1.5s | 10.0.0.7 | POST "/api/chat"',
        '[GIN] 2026/01/02 - 03:04:06 | 200 | 2ms | 10.0.0.7 | GET "/api/ps"',
        "srv  update: - cache state: 5 prompts, 10.0 MiB (limits: 20.0 MiB, 6 tokens, 7 est)",
        "srv  x: prompt cache update took 4.0 ms",
        'time=x level=WARN source=s msg="odd"',
    )
    first = {r.table: (r.read, r.added) for r in backfill.backfill(log, str(tmp_path)).collect()}
    assert first == {"lines": (8, None), "requests": (1, 1), "events": (2, 2), "cache_samples": (1, 1)}
    again = {r.table: (r.read, r.added) for r in backfill.backfill(log, str(tmp_path)).collect()}
    assert again == {"lines": (8, None), "requests": (1, 0), "events": (2, 0), "cache_samples": (1, 0)}
    for name in backfill.ROLLUPS:
        row = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert [(r.bucket, r.req_count, r.ttft_sum, r.lat_n) for r in row] == [(0, 1, 100.5, 1)]
    request = spark.read.parquet(f"{tmp_path}/requests").first()
    assert (request.task_id, request.match, request.queue_ms) == (7, "exact", 1100.0)


def test_a_log_without_requests(spark, tmp_path):
    got = {r.table: (r.read, r.added) for r in backfill.backfill(lines(spark, "nothing"), str(tmp_path)).collect()}
    assert got["lines"] == (1, None) and got["requests"] == (0, 0)
    backfill.refresh_rollups(spark, str(tmp_path))


def test_events_of_logs(spark):
    structured = parse.go_lines(lines(spark, 'time=x level=INFO source=s msg="timer expired, expiring to unload" runner.name=m', 'time=x level=INFO source=s msg="runner with non-zero duration has gone idle, adding timer" duration=5m0s', 'time=x level=ERROR source=s msg="bad" k=v', 'time=x level=INFO source=s msg="fine"'))
    got = [(r.kind, r.level, r.model, r.detail) for r in correlate.server_events(structured, parse.slot_lines(lines(spark, "none"))).orderBy("seq").collect()]
    assert got == [("unload", "INFO", "m", None), ("idle_timer", "INFO", None, '{"keep_alive":"5m0s"}'), ("problem", "ERROR", None, '{"k":"v"}')]
    records = parse.engine_e_lines(lines(spark, "Loading model /a/m1/", "Model loaded in 2.5 s", "Serving OAI API on http://h:1 (docs at x)", "#3 completions: client disconnected", "Sent to request: boom"))
    got = [(r.kind, r.model, r.msg, r.duration_ms) for r in correlate.engine_events(records).orderBy("seq").collect()]
    assert got == [("load", "m1", "model loaded", 2500.0), ("start", "m1", "listening on http://h:1", None), ("disconnect", "m1", "client disconnected, generation cancelled", None), ("error", "m1", "boom", None)]


def test_backend_samples(spark):
    status = '{"status":{"live_gens":2,"waiting_gens":1,"loading_models":0},"backend_status":{"status":"running"}}'
    stats = '{"devices":[{"vram_total":10,"vram_free":4}]}'
    rows = [("a", 1, status, [("b0", stats, '{"queue_running":[[1]],"queue_pending":[]}'), ("b1", None, None)]), ("a", 2, None, [("b0", '{"devices":[]}', "{}")]), ("a", 3, None, None)]
    got = polls.backend_samples(spark.createDataFrame(rows, "source string, ts_us long, status string, backends array<struct<backend string, stats string, queue string>>")).orderBy("ts_us", "backend").collect()
    assert [(r.ts_us, r.backend, r.status, r.live_gens, r.queue_running, r.queue_pending, r.vram_free) for r in got] == [(1, "", "running", 2, None, None, None), (1, "b0", "running", None, 1, 0, 4), (1, "b1", "unreachable", None, None, None, None), (2, "b0", "running", None, 0, 0, None)]


def test_cache_usage_takes_the_newest_sample_as_it_is(spark):
    rows = [("a", 1, 50, 100, 1, 2, 0.5), ("a", 2, 90, 100, 3, 0, 0.6), ("a", 3, None, 100, 4, 1, None), ("b", 1, 5, 0, 0, 0, 0.1), ("a", 9, 1, 1, 1, 1, 1.0)]
    got = {r.source: tuple(r)[1:] for r in summary.cache_usage(spark.createDataFrame(rows, "source string, ts_us long, used_tokens long, max_tokens long, active_jobs long, pending_jobs long, hit_rate double"), 0, 9).collect()}
    assert got == {"a": (pytest.approx(0.7), 0.9, None, 4, 1, None, 2), "b": (None, None, None, 0, 0, 0.1, 0)}


def test_capacity_comes_from_samples(spark):
    requests = spark.createDataFrame([(1 * S, 9 * S, "inference"), (2 * S, 5 * S, "embed"), (3 * S, 4 * S, "health")], "started_us long, ts_us long, class string")
    samples = spark.createDataFrame([(1 * S, 1, 4), (2 * S, 2, 7), (3 * S, None, 5), (11 * S, 9, 99)], "ts_us long, slots long, inflight long")
    got = intervals.concurrency_of_capacity(requests, samples, 0, 10 * S).first()
    plain = intervals.concurrency(requests, 0, 10 * S, 2).first()
    assert (got.slots, got.sampled_peak) == (2, 7)
    assert (got.peak, got.mean, got.utilisation, got.saturated_s, got.saturated) == (plain.peak, plain.mean, plain.utilisation, plain.saturated_s, plain.saturated)
    none = intervals.concurrency_of_capacity(requests, samples.where("false"), 0, 10 * S).first()
    assert (none.peak, none.slots, none.utilisation, none.saturated_s, none.sampled_peak) == (2, None, None, None, None)


def test_registry_rows_have_ages(spark):
    rows = [("a", 10 * S, 4 * S, True, "[1,2]", 8 * S), ("b", 9 * S, None, None, "", None), ("c", None, None, False, "[]", 10 * S), ("gone", 1, 1, True, None, None)]
    table = spark.createDataFrame(rows, "source string, last_us long, started_us long, reachable boolean, devices string, devices_us long")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    got = {r.source: (r.reachable, r.devices, r.stale_s, r.uptime_s, r.devices_age_s) for r in tables.registry_list(table, sources, 12 * S).collect()}
    assert got == {"a": (True, [1, 2], 2.0, 8.0, 4.0), "b": (False, None, 3.0, None, None), "c": (False, [], None, None, 2.0)}


def test_an_empty_log(spark, tmp_path):
    empty = spark.createDataFrame([], "source string, seq long, ts_us long, message string")
    got = {r.table: (r.read, r.added) for r in backfill.backfill(empty, str(tmp_path)).collect()}
    assert got == {"lines": (0, None), "requests": (0, 0), "events": (0, 0), "cache_samples": (0, 0)}
