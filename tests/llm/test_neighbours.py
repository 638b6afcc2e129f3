"""Nearest neighbours against brute force."""

import numpy as np

from opsweave.llm import neighbours
from opsweave.llm.neighbours import nearest


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for j, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[j]
            order = [t for t in np.lexsort((ids, -s.round(12))) if ids[t] != q][:k]
            out[int(q)] = [(int(ids[t]), float(s[t])) for t in order]
    return out


def test_recall_and_order(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + 0.5 * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(600)]
    for i in range(600, 680):  # a group of equal vectors
        rows.append((i, rows[0][1]))
    rows += [(700, None), (750, [0.0] * 16), (800, [float("nan")] + [1.0] * 15), (850, [None] + [1.0] * 15), (900, [1.0, 2.0]), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as query", "'x' as vector")
    got = {}
    for x in nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute(rows, 50, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for i, _ in got[0]] == [600, 601, 602, 603, 604]
    assert all(abs(s - 1) < 1e-9 for _, s in got[0])


def test_recall_of_many_vectors(spark, monkeypatch):
    """Starting partitions of 64 in 20,000 vectors: what is found is found by neighbours of neighbours."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "TABLES", 2)
    r = np.random.default_rng(3)
    x = (r.standard_normal((200, 24))[r.integers(0, 200, 20_000)] + 0.8 * r.standard_normal((20_000, 24))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for q in nearest(frame, every=200).collect():
        got.setdefault(q.query_id, set()).add(q.vec_id)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 20_000, 200):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 500


def test_lengths_apart_and_ties(spark):
    """Vectors of different lengths are never neighbours; equal scores go by id."""
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(i, [1.0, float(i % 2), 2.0]) for i in range(30, 50)] + [(50, [1.0] * 5)]
    got = {}
    for x in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {0: [3, 6, 9, 12, 15], 10: [1, 4, 7, 13, 16], 20: [2, 5, 8, 11, 14], 30: [32, 34, 36, 38, 40], 40: [30, 32, 34, 36, 38]}


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])]
    got = nearest(spark.createDataFrame(few, schema)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert nearest(spark.createDataFrame([], schema)).count() == 0


def test_repeated_ids_are_one_vector(spark):
    """Of rows that repeat an id with other vectors one counts, the same on every run; equal rows are one."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    runs = [sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(table.repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1]
    cosine = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    wants = []
    for q in ([1.0, 0.0], [0.0, 1.0]):
        scored = sorted((-cosine(q, v), i) for i, v in rows if i > 0)
        wants.append([(0, k, i, -s) for k, (s, i) in enumerate(scored, 1)])
    assert runs[0] in wants
