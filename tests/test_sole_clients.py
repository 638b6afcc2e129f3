"""Requests with one client only, against the same rule row by row."""

import random

from opsweave.operators import intervals

S = 1_000_000


def plain(requests, samples):
    out = []
    for i, source, a, b in requests:
        met = [s for s in samples if s[0] == source and s[1] is not None and a <= s[1] <= b]
        clients = {c for _, _, c in met if c is not None}
        if len(clients) == 1:
            out.append((i, clients.pop(), len({t for _, t, _ in met})))
    return sorted(out)


def answer(spark, requests, samples):
    r = spark.createDataFrame(requests, "id long, source string, started_us long, ts_us long")
    c = spark.createDataFrame(samples, "source string, ts_us long, client string")
    return sorted(map(tuple, intervals.sole_clients(r, c).collect()))


def test_sole_clients_by_the_rule(spark):
    at = random.Random(7)
    samples = [(at.choice("ab"), at.choice([None, *range(0, 9_000 * S, 60 * S)]), at.choice("xxxxxy") if at.random() < 0.9 else None) for _ in range(150)]
    requests = []
    for i in range(300):
        a = at.randrange(0, 9_000) * S
        requests.append((i, at.choice("abc"), a, a + at.choice([0, 30, 300, 900]) * S))
    got = answer(spark, requests, samples)
    assert got == plain(requests, samples) and len(got) > 50


def test_a_request_is_not_dealt_over_the_minutes_it_covers(spark):
    """More minutes than an array holds."""
    samples = [("a", 5 * S, "x"), ("a", 7_200 * S, "x"), ("a", 1 << 59, "y")]
    requests = [(1, "a", -(1 << 58), 1 << 58), (2, "a", -(1 << 58), 1 << 59), (3, "a", 6 * S, 7 * S)]
    assert answer(spark, requests, samples) == [(1, "x", 2)] == plain(requests, samples)
