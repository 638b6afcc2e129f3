"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, queries by greedy search in it.

Equal vectors are one node. Nodes start with neighbours from a few small random partitions; then each round joins every node's
neighbours, in both directions, with each other (neighbours of neighbours meet at the node between them), and
each node keeps the nearest. Two neighbours meet at a node once: a pair is compared only while one of its two edges is fresh, and
nodes without fresh edges rest. Rounds end when few edges are fresh. Nodes with many neighbours are dealt out, so no group is
unbounded, and none is cut. Graph and search use vectors of 8-bit numbers; all that a search ends with are compared by the
vectors themselves, in double precision.

Vectors that are null or zero, or that hold null or non-finite components take no part. Only vectors of one length can be
near each other: each length has a graph of its own, and what is too few of its length gets fewer answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, materialise, mix, scratch, spread

#: Neighbours of a node; members of a starting partition; neighbours that meet in one place, and what each learns there at most.
DEGREE, LEAF, MEET, LEARN = 28, 256, 96, 16
#: Starting partitions of all nodes; rounds of neighbours of neighbours at most (more are an error), and the share of fresh edges at which they end.
TABLES, ROUNDS, SETTLED = 4, 64, 0.02
#: Nodes that a search keeps for a query, and follows in a round; starting nodes of each length; rounds at most (more are an error).
WIDTH, FOLLOW, ENTRIES, STEPS = 160, 40, 48, 200


def _matrix(vectors, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1)


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, node (smallest vec_id with an equal vector), vector (float64 bytes), for the vectors that take part.

    Of rows that repeat a vec_id with other vectors, those of one vector count: of that with the smallest digest.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    v = v.withColumn("key", F.sha2(F.to_json(F.struct("v")).cast("binary"), 256))
    own = v.groupBy("vec_id").agg(F.min("key").alias("key"))
    member = own.join(own.groupBy("key").agg(F.min("vec_id").alias("node")), "key")

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: np.asarray(x, np.float64).tobytes())

    return v.join(member, ["vec_id", "key"]).select("vec_id", "node", packed(F.col("v")).alias("vector"))


def _near(ids: np.ndarray, m: np.ndarray, least: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) for each row a and at most the `most` nearest others above a's least similarity; one of the two is fresh."""
    x = m.astype(np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    s[np.ix_(~fresh, ~fresh)] = -2
    k = min(most, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(ids), 0), np.int64)
    value = np.take_along_axis(s, at, axis=1)
    row, column = np.nonzero(value > np.maximum(least[:, None], -1.5))
    return ids[row], ids[at[row, column]], value[row, column]


def _best(edges: DataFrame, most: int) -> DataFrame:
    """Each node's most similar ones; an edge is fresh if it was not there before."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("k") <= most).select("a", "b", "s", "fresh")


_EDGES = "a long, b long, s double, fresh boolean"


def _start(small: DataFrame, total: int) -> DataFrame:
    """Edges between nodes that share a random partition: signs of random projections, partitions cut to LEAF by id hash."""
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / LEAF * 2)), 0, 40))

    def keys(batches):
        for batch in batches:
            for size, part in batch.groupby(batch["q"].map(len)):
                m = _matrix(part["q"], np.int8).astype(np.float32)
                for t in range(TABLES):
                    plane = np.random.default_rng(t).standard_normal((m.shape[1], max(bits, 1))).astype(np.float32)
                    sign = (m @ plane > 0)[:, :bits].astype(U64)
                    key = (sign << np.arange(bits, dtype=U64)[None, :]).sum(axis=1, dtype=U64) if bits else np.zeros(len(m), U64)
                    yield pd.DataFrame({"key": mix(key + U64(size << 45), t).view(np.int64), "node": part["node"], "q": part["q"]})

    keyed = small.select("node", "q").mapInPandas(keys, "key long, node long, q binary")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / LEAF).alias("parts"))
    leaf = keyed.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64("node", "key"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("node", "q")).alias("members"))

    def compare(batches):
        for batch in batches:
            for members in batch["members"]:
                ids = np.array([m["node"] for m in members], np.int64)
                if len(ids) > 1:
                    a, b, s = _near(ids, _matrix([m["q"] for m in members], np.int8), np.full(len(ids), -2.0), np.ones(len(ids), bool), DEGREE)
                    yield pd.DataFrame({"a": a, "b": b, "s": s.astype(float), "fresh": True})

    return _best(leaf.select("members").mapInPandas(compare, _EDGES), DEGREE)


def _round(graph: DataFrame, small: DataFrame) -> DataFrame:
    """One round: what meets at each node is compared, and each node keeps the nearest of old and new."""
    least = graph.groupBy("a").agg(F.when(F.count("*") >= DEGREE, F.min("s")).otherwise(-1.0).alias("least"))
    about = small.join(least.withColumnRenamed("a", "node"), "node", "left")
    both = graph.select(F.col("a").alias("at"), F.col("b").alias("node"), "fresh").unionByName(graph.select(F.col("b").alias("at"), F.col("a").alias("node"), "fresh"))
    both = both.groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    sizes = both.groupBy("at").agg(F.ceil(F.count("*") / MEET).alias("parts"), F.max("fresh").alias("any")).where("any").drop("any")
    met = both.join(sizes, "at").join(about, "node")
    met = met.groupBy("at", F.pmod(F.xxhash64("node", "at"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("node", "q", "fresh", F.coalesce("least", F.lit(-1.0)).alias("least"))).alias("members"))

    def compare(batches):
        for batch in batches:
            found = []
            for members in batch["members"]:
                fresh = np.array([m["fresh"] for m in members], bool)
                if len(fresh) > 1 and fresh.any():
                    ids = np.array([m["node"] for m in members], np.int64)
                    found.append(_near(ids, _matrix([m["q"] for m in members], np.int8), np.array([m["least"] for m in members]), fresh, LEARN))
            if found:
                a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pd.DataFrame({"a": a, "b": b, "s": s.astype(float), "fresh": True})

    old = graph.withColumn("fresh", F.lit(False))
    return _best(old.unionByName(met.select("members").mapInPandas(compare, _EDGES)), DEGREE)


def rounded_vectors(nodes: DataFrame) -> DataFrame:
    """node, q: vectors in 8-bit numbers. nodes: node, vector."""

    @F.pandas_udf("binary")
    def rounded(vectors: pd.Series) -> pd.Series:
        def one(v):
            x = np.frombuffer(v, np.float64)
            return np.rint(x / np.abs(x).max() * 127).astype(np.int8).tobytes()

        return vectors.map(one)

    return nodes.select("node", rounded(F.col("vector")).alias("q"))


def neighbour_graph(small: DataFrame) -> DataFrame:
    """a, b, s: for each node (node, q) those found nearest, with the similarity of their 8-bit vectors."""
    total = small.count()
    graph = materialise(_start(small, total), "graph")
    for _ in range(ROUNDS):
        graph = materialise(_round(graph, small), "graph")
        if graph.where("fresh").count() <= SETTLED * DEGREE * total:
            break
    else:
        raise RuntimeError(f"the graph did not settle in {ROUNDS} rounds")
    return graph.select("a", "b", "s")


def _scored(pairs: DataFrame, kind: str) -> DataFrame:
    """query, node, score: cosines, computed in double precision, of the columns x and y (bytes of vectors of a kind); those of two lengths have none."""

    def run(batches):
        for batch in batches:
            size = batch["x"].map(len)
            for n, part in batch[size == batch["y"].map(len)].groupby(size):
                a, b = (_matrix(part[c], kind).astype(np.float64) for c in ("x", "y"))
                score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pd.DataFrame({"query": part["query"], "node": part["node"], "score": score})

    return pairs.select("query", "node", "x", "y").mapInPandas(run, "query long, node long, score double")


def greedy_search(queries: DataFrame, graph: DataFrame, small: DataFrame, width: int = WIDTH) -> DataFrame:
    """query, node, score: the width nodes that a search from common entry points, and a query's own node, finds nearest by 8-bit vectors.

    queries: query, q, own (node of an equal vector in the graph, or null). Each round follows the links of a query's best nodes not
    yet followed, and never looks at a node twice; it ends when the best width nodes of every query have been followed, and passing STEPS rounds is an error.
    """
    edges = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(edges, "edges")
    length = F.octet_length("q").alias("length")
    first = Window.partitionBy("length", "part").orderBy("o", "node")
    drawn = small.select("node", length, F.xxhash64("node").alias("o")).withColumn("part", F.pmod("o", F.lit(256)))
    for parts in (F.col("part"), F.lit(0)):  # the first of each part, then the first of them all
        drawn = drawn.withColumn("part", parts).withColumn("k", F.row_number().over(first)).where(F.col("k") <= ENTRIES)
    begin = queries.select("query", length).join(drawn.select("length", "node"), "length").select("query", "node")
    begin = begin.unionByName(queries.where("own is not null").select("query", F.col("own").alias("node"))).distinct()

    def score(pairs):
        x = pairs.join(queries.select("query", F.col("q").alias("x")), "query").join(small.withColumnRenamed("q", "y"), "node")
        return materialise(_scored(x, "int8"), "scored")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")

    def kept(rows):
        top = rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= width)
        turn = F.sum((~F.col("followed")).cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))
        top = top.withColumn("now", ~F.col("followed") & (turn <= FOLLOW))
        return materialise(top.select("query", "node", "score", (F.col("followed") | F.col("now")).alias("followed"), "now"), "search")

    new = score(begin)
    seen = new.select("query", "node")
    top = kept(new.withColumn("followed", F.lit(False)))
    for _ in range(STEPS):
        follow = top.where("now").select("query", F.col("node").alias("a"))
        if follow.isEmpty():
            break
        ahead = follow.join(edges, "a").select("query", F.col("b").alias("node")).distinct()
        new = score(ahead.join(seen, ["query", "node"], "left_anti"))
        seen = seen.unionByName(new.select("query", "node"))
        top = kept(top.drop("now").unionByName(new.withColumn("followed", F.lit(False))))
    else:
        raise RuntimeError(f"the search did not end in {STEPS} rounds")
    return top.select("query", "node", "score")


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k nearest other rows; ties to the smaller id."""
    with scratch(vectors.sparkSession) as keep:
        return keep(materialise(_nearest(vectors, vec_id, embedding, every, k), "nearest"))


def _nearest(vectors: DataFrame, vec_id: str, embedding: str, every: int, k: int) -> DataFrame:
    members = materialise(nodes_of(vectors, vec_id, embedding), "nodes")
    nodes = spread(members.where("vec_id = node"), "node").dropDuplicates(["node"]).select("node", "vector")
    small = materialise(rounded_vectors(nodes), "small")
    graph = neighbour_graph(small)
    asked = members.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query"), F.col("vector").alias("x"), F.col("node").alias("own"))
    asked = materialise(asked.join(small.select(F.col("node").alias("own"), "q"), "own"), "queries")
    found = greedy_search(asked.select("query", "q", "own"), graph, small)
    exact = _scored(found.select("query", "node").join(asked.select("query", "x"), "query").join(nodes.withColumnRenamed("vector", "y"), "node"), "float64")
    best = exact.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("r") <= k + 1)
    # Of a node's members, the first k + 1 can be in an answer. Large nodes are ranked in parts first.
    part = members.select("node", "vec_id").distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("node", "part").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("node", "vec_id")
    answers = best.join(first, "node").where("vec_id != query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
