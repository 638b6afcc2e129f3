"""States carried from part to part, against plain folds; as-of values; long backlogs in parts."""

import random

from pyspark.sql import functions as F

from opsweave.operators import correlate, ordered

S = 1_000_000


def test_summaries_of_held_states():
    r = random.Random(3)
    for _ in range(400):
        rows = []
        for _ in range(r.randint(0, 12)):
            v = None if r.random() < 0.2 else r.randint(0, 30)
            width = r.choice([2, 5, 100])
            rows.append((None, None, None) if v is None else (v, v + width, v) if r.random() < 0.5 else (v - width, ordered._FAR, v))
        summary = ordered.HELD.summary(rows)
        for x in [None, *range(-2, 40)]:
            want = x
            for row in rows:
                want = ordered.HELD.step(want, row)
            assert ordered.HELD.after(summary, x) == want, (rows, x)


def test_summaries_of_clamped_states():
    r = random.Random(4)
    for _ in range(200):
        rows = [(low, low + r.randint(0, 6)) for low in (r.randint(-9, 9) for _ in range(r.randint(0, 9)))]
        summary = ordered.CLAMPED.summary(rows)
        for x in range(-15, 20):
            want = x
            for row in rows:
                want = ordered.CLAMPED.step(want, row)
            assert ordered.CLAMPED.after(summary, x) == want


def test_a_standing_backlog(spark):
    """More arrive than are taken, so that the queue never empties: still no part is larger than asked for."""
    r = random.Random(8)
    rows = []
    for s, share in (("a", 0.6), ("b", 0.5), ("c", 0.95)):
        t = 0
        for i in range(900):
            t += r.choice([0, S // 10, S, 2 * S, 9 * S])
            rows.append((s, 3 * i, t, r.random() < share))
    rows += [("d", 0, 5, False), ("d", 1, 6, True)]
    got = correlate.fifo_with_expiry(spark.createDataFrame(rows, "source string, seq long, ts_us long, arrives boolean"), part=64).collect()
    want = []
    for s in "abcd":
        fifo = correlate.Fifo()
        out = fifo.feed((i, t, a) for x, i, t, a in rows if x == s)
        want += [(s, *o) for o in out] + [(s, q, q, "orphan") for q, _ in fifo.queue]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_values_as_of(spark):
    r = random.Random(9)
    marks = [(s, r.randint(0, 10**9), i, r.choice(["x", "y", "z"])) for s in "ab" for i in range(60)]
    asks = [(s, r.choice([t for _, t, _, _ in marks]) + r.choice([-1, 0, 1]), i) for s in "ab" for i in range(60)] + [("a", -5, 99), ("c", 3, 1)]
    m = spark.createDataFrame(marks, "source string, at long, seq long, v string")
    a = spark.createDataFrame(asks, "source string, at long, n long")
    got = {(x.source, x.n): x.last for x in ordered.asof(a, m, F.col("v"), "last").collect()}
    assert len(got) == len(asks)
    for s, t, n in asks:
        before = [(u, i, v) for x, u, i, v in marks if x == s and u <= t]
        assert got[s, n] == (max(before)[2] if before else None)
