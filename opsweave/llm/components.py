"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component (smallest id reachable) for every id in edges (a long, b long).

    Loops, repeated and reversed edges are fine; null ends are left out; no edges, no rows. Each round is a
    grouped minimum and a join, so a node with very many edges is summed before it is shuffled. The number
    of rounds grows with the logarithm of the longest chain; most bounds it, and passing it is an error.
    """
    with scratch(edges.sparkSession) as keep:
        e = keep(_settled(edges, most))
    roots = e.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)


def _settled(edges: DataFrame, most: int) -> DataFrame:
    """a, b: each node b below the smallest one of its component."""
    e = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    for _ in range(most):
        for large in (True, False):
            turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
            both = e.unionByName(turned) if large else turned
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            joined = both.join(least, "a")
            if large:
                # Each larger neighbour of a hangs below the smallest node around a.
                e = joined.where("b > a").select(F.col("m").alias("a"), "b")
            else:
                # Each node hangs below its smallest neighbour, and so do its other smaller neighbours.
                e = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
            e = e.where("a != b").distinct()
        e = materialise(e, "edges")
        # Settled once each node hangs below one other at most, and none of those below a third.
        below = e.select(F.col("b").alias("id"), F.lit(1).alias("x"), F.lit(0).alias("y"))
        above = e.select(F.col("a").alias("id"), F.lit(0).alias("x"), F.lit(1).alias("y"))
        if below.unionByName(above).groupBy("id").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x + y > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e
