"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rank_linear, rank_near

RULES = {"near": rank_near, "linear": rank_linear}


def _cell(v: Column) -> Column:
    """A number that never falls as v grows: values of one cell are sorted together."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 64).cast("long")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], rule: str = "near") -> DataFrame:
    """keys, n and a column for each name in qs: the value at the rank of the rule, among the non-null values of a group.

    Counts by cell find the cell that holds each rank; only that cell's distinct values are ordered. Keys may be null.
    Groups without values are left out.
    """
    v = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *keys).alias("key"), F.col(value).cast("double").alias("v"))
    counts = v.groupBy("key", "v").agg(F.count("*").alias("c")).withColumn("cell", _cell(F.col("v")))
    cells = counts.groupBy("key", "cell").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("to", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("key")))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), RULES[rule](F.col("n"), q).alias("rank")) for name, q in qs.items()])
    held = cells.select("key", "cell", "n", (F.col("to") - F.col("c")).alias("before"), "to", F.explode(asked).alias("a"))
    held = held.where((F.col("a.rank") >= F.col("before")) & (F.col("a.rank") < F.col("to"))).select("key", "cell", "n", "a.name", (F.col("a.rank") - F.col("before")).alias("left"))
    inside = Window.partitionBy("key", "cell", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(held, ["key", "cell"]).withColumn("to", F.sum("c").over(inside)).where((F.col("left") < F.col("to")) & (F.col("left") >= F.col("to") - F.col("c")))
    out = found.groupBy("key").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in qs])
    return out.select(*[F.col(f"key.{k}").alias(k) for k in keys], "n", *qs)
