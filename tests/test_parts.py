"""Joins, differences and clocks that run in parts of an order, against plain folds over each source; parts are cut small."""

import random
from datetime import datetime, timedelta, timezone

from opsweave.operators import correlate, deltas
from opsweave.sources import readers


def _calls(events):
    """seq of a call -> (seq it takes, match), for events (source, seq, arrives)."""
    queues, out = {}, {}
    for source, seq, arrives in sorted(events):
        queue = queues.setdefault(source, [])
        if arrives:
            queue.append(seq)
        else:
            took = queue.pop(0) if queue else None
            out[source, seq] = (took, "none" if took is None else "ambiguous" if queue else "exact")
    return out


def test_fifo_join_in_parts(spark):
    r = random.Random(1)
    events = []
    for source in "abc":
        seq = 0
        for i in range(400):
            seq += r.choice((1, 1, 2, 40))
            events.append((source, seq, r.random() < (0.9 if i % 100 < 50 else 0.2)))
    waiting = spark.createDataFrame([e[:2] for e in events if e[2]], "source string, seq long")
    calls = spark.createDataFrame([e[:2] for e in events if not e[2]], "source string, seq long")
    got = correlate.fifo_join(waiting, calls, part=7).collect()
    assert {(x.source, x.seq): (x.w_seq, x.match) for x in got} == _calls(events) and len(got) == calls.count()


def test_fifo_join_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "source string, seq long"), spark.createDataFrame([("a", 1)], "source string, seq long")
    assert correlate.fifo_join(one, none).count() == 0
    assert [(x.w_seq, x.match) for x in correlate.fifo_join(none, one).collect()] == [(None, "none")]


def test_counter_deltas_in_parts(spark):
    r = random.Random(2)
    rows = []
    for source in "ab":
        x, y, run = 0, 0.0, 1
        for n in range(300):
            if r.random() < 0.05:
                x, y, run = 0, 0.0, run + r.randrange(2)
            x, y = x + r.randrange(4), y + r.random()
            rows.append((source, n, n * 1_500_000, x if r.random() < 0.9 else None, y, run if r.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "source string, n long, ts_us long, x long, y double, run int")
    want = {}
    for source in "ab":
        before, known = None, None
        for s, n, ts, x, y, run in (row for row in rows if row[0] == source):
            fell = before is not None and any(a is not None and b is not None and a < b for a, b in ((x, before[1]), (y, before[2])))
            fell = fell or (run is not None and known is not None and run != known)
            known = known if run is None else run
            clear = fell or before is None
            want[s, n] = (fell, None if before is None else (ts - before[0]) / 1e6, None if clear or x is None or before[1] is None else x - before[1], None if clear else y - before[2])
            before = (ts, x, y)
    for part in (5, 1 << 16):
        got = {(q.source, q.n): (q.restart, q.seconds, q.d_x, q.d_y) for q in deltas.counter_deltas(df, ["x", "y"], "run", part=part).collect()}
        assert got == want
    assert deltas.counter_deltas(df, ["x"]).columns == [*df.columns, "restart", "seconds", "d_x"]


def test_banner_clock_in_parts(spark):
    r = random.Random(3)
    lines, want = [], {}
    for source in "ab":
        date, days, before = None, 0, None
        for seq in range(500):
            kind = r.random()
            if kind < 0.03:
                date, days, before = datetime(2024, r.randint(1, 12), r.randint(1, 28), tzinfo=timezone.utc), 0, None
                lines.append((source, seq, f"== engine logs {date:%Y-%m-%d}"))
            elif kind < 0.2:
                lines.append((source, seq, "no clock"))
            else:
                s = r.choice((60, 43_100, 43_300, 86_390)) + r.randrange(9)
                days += before is not None and s - before < -43_200
                before = s
                lines.append((source, seq, f"{timedelta(seconds=s)} said".rjust(13, "0")))
                want[source, seq] = None if date is None else int((date + timedelta(days=days, seconds=s)).timestamp()) * 1_000_000
    df = spark.createDataFrame(lines, "source string, seq long, message string")
    got = {(x.source, x.seq): x.ts_us for x in readers.banner_clock(df, part=6).collect()}
    assert len(got) == len(lines) and {k: got[k] for k in want} == want and all(v is None for k, v in got.items() if k not in want)


def test_names_and_loads_as_of_a_line(spark):
    rows = spark.createDataFrame([("a", 1, "exact"), ("a", 5, "exact"), ("a", 9, "exact")], "source string, seq long, match string")
    loads = spark.createDataFrame([("a", 0, "m"), ("a", 3, "m"), ("a", 7, "n")], "source string, seq long, model string")
    names = spark.createDataFrame([], "source string, seq long, model string")
    got = {x.seq: (x.model, x.match) for x in correlate.named_rows(rows, names, loads).collect()}
    assert got == {1: ("m", "exact"), 5: ("m", "exact"), 9: ("n", "ambiguous")}
    kinds = [("a", 0, 0, "blob", "x"), ("a", 1, 0, "load_start", None), ("a", 2, 0, "model_loaded", None), ("a", 3, 0, "blob", "y"), ("a", 4, 1_000_000, "model_loaded", None), ("a", 5, 9_000_000, "model_loaded", None), ("a", 6, 9_500_000, "load_start", None), ("a", 7, 9_600_000, "model_loaded", None)]
    told = correlate.load_events(spark.createDataFrame(kinds, "source string, seq long, ts_us long, event string, blob string"))
    assert sorted((x.seq, x.blob, x.load) for x in told.collect()) == [(2, None, 1), (4, "y", 1), (5, "y", 1), (7, None, 2)]
