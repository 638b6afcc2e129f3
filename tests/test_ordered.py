"""Queues and clocks of one source, cut into parts, against folds over the whole of it."""

import random

from pyspark.sql import functions as F

from opsweave.operators import correlate, ordered

S = 1_000_000


def test_running_values(spark):
    r = random.Random(2)
    rows = [(s, i, r.choice([None, r.randint(-9, 9)])) for s in "ab" for i in r.sample(range(500), 120)]
    table = spark.createDataFrame(rows, "source string, seq long, v long")
    got = ordered.running(table, {"total": ("sum", F.col("v"), True), "high": ("max", F.col("v"), False), "low": ("min", F.col("v"), True)}, part=37).collect()
    assert len(got) == len(rows)
    for x in got:
        own = sorted((i, v) for s, i, v in rows if s == x.source)
        upto = [v for i, v in own if i <= x.seq and v is not None]
        before = [v for i, v in own if i < x.seq and v is not None]
        assert (x.total, x.high, x.low) == (sum(upto), max(before, default=None), min(upto, default=None))


def test_queue_in_parts(spark):
    r = random.Random(5)
    rows = []
    for s in "ab":
        t = 0
        for i in range(800):
            t += r.choice([0, S, 4 * S, 12 * S, 45 * S]) if r.random() < 0.9 else -r.randint(0, 20) * S
            rows.append((s, i, max(t, 0), r.random() < (0.5 if s == "a" else 0.7)))
    got = correlate.fifo_with_expiry(spark.createDataFrame(rows, "source string, seq long, ts_us long, arrives boolean"), part=16).collect()
    want = []
    for s in "ab":
        fifo = correlate.Fifo()
        out = fifo.feed((i, t, a) for x, i, t, a in rows if x == s)
        want += [(s, *o) for o in out] + [(s, q, q, "orphan") for q, _ in fifo.queue]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_clock_in_parts(spark):
    r = random.Random(6)
    rows, want = [], {}
    for s in "ab":
        t, now = 0, None
        for i in range(600):
            t += r.choice([0, S, 2 * S]) if r.random() < 0.95 else -r.choice([1, 10, 100]) * S
            clock = t if r.random() < 0.7 else None
            rows.append((s, i, clock, "x"))
            if clock is not None and not (now is not None and 0 < now - clock <= 2 * S):
                now = clock
            want[s, i] = now
    got = correlate.forward_clock(spark.createDataFrame(rows, "source string, seq long, clock_us long, message string"), part=16)
    assert got.columns == ["source", "seq", "clock_us", "message", "ts_us"]
    assert {(x.source, x.seq): x.ts_us for x in got.collect()} == want
