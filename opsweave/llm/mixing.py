"""Mixing sources to target weights by entropy balancing.

Rates of documents are as close to 1 as the targets allow, in relative entropy: rate = min(most, exp(lambda * size / scale)),
with one multiplier lambda for each source, scale its mean size. The multipliers minimise the convex dual; each
Newton step is one grouped sum over (source, size) cells. Rates are then rounded to copies: cell by cell, in order of
size, such that a source's rounding errors cancel, and a last correction uses cells no larger than what is missing.
Which documents of a cell get the extra copy follows from a hash of doc_id.

Only DataFrame functions are used. Null texts and texts without words have size 0 and take no part in targets;
null sources are a source of their own; an empty table gives no rows; targets of a mix without words are 0. Rows that repeat a document count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which a cell's documents are dealt to choose those with an extra copy: no cell is sorted in one task.
PARTS = 256
#: Newton steps between two looks at the remaining error, and looks at most: multipliers() raises beyond.
STEPS, LOOKS = 4, 15
TOLERANCE = 1e-9
#: Rounds of the last correction.
CORRECTIONS = 8
#: Columns of a mix, and those it works with.
MADE = {"doc_id", "source", "size", "source_size", "target", "copies", "taken", "t", "h", "part", "s", "base", "quota"}


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """s, source, docs, source_size, target from (source, docs, source_size): a row for each source.

    Weights repeat over the sources in code point order, null last. No target exceeds most times its source;
    what is above is shared among the others by weight: a level t with target = min(most * size, weight * t).
    The table has one row for each source, so it is sorted in one place.
    """
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("s", F.row_number().over(ordered))
    t = t.withColumn("weight", F.element_at(listed, F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1)).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    every = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(every))
    t = t.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.col("cap") / F.col("weight") > F.col("level")
    t = t.withColumn("t", F.coalesce(F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("weight"))).over(every), F.lit(0.0)))
    return t.select("s", "source", "docs", "source_size", F.least("cap", F.col("weight") * F.col("t")).alias("target"))


def _tilt(most: float) -> Column:
    """The rate of a cell under its source's multiplier."""
    return F.when(F.col("source_size") * most <= F.col("target"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("u"), F.lit(700.0)))))


def multipliers(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """s, lam: Newton's method on the dual of each source, kept inside a bracket; steps are taken on log(sum) - log(target)."""
    state = targets.select("s", "target", "source_size", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("off"))
    solved = (F.col("target") <= 0) | (F.col("source_size") * most <= F.col("target"))
    for _ in range(LOOKS):
        for _ in range(STEPS):
            rate = _tilt(most)
            tokens = F.col("n") * F.col("size")
            sums = cells.join(state, "s").groupBy("s").agg(F.sum(tokens * rate).alias("f"), F.sum(F.when(rate < most, tokens * rate * F.col("u")).otherwise(0.0)).alias("g"))
            d = F.log("f") - F.log("target")
            state = state.join(sums, "s", "left").withColumn("off", F.when(solved | F.col("f").isNull(), 0.0).otherwise(F.abs(d)))
            state = state.withColumn("lo", F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi")))
            newton = F.col("lam") - d * F.col("f") / F.col("g")
            inside = (F.col("g") > 0) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
            halved = F.when(F.col("lo").isNull(), F.col("lam") * 2 - 1).when(F.col("hi").isNull(), F.col("lam") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
            state = state.withColumn("lam", F.when(F.col("off") < TOLERANCE / 100, F.col("lam")).otherwise(F.when(inside, newton).otherwise(halved))).drop("f", "g")
        state = materialise(state, "multipliers")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    else:
        wide = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("hi") - F.col("lo") > 1e-9)  # less does not show in what is returned
        if not state.where((F.col("off") >= TOLERANCE) & wide).isEmpty():
            raise RuntimeError(f"multipliers not found in {LOOKS * STEPS} steps")
    # Rounded so that the order in which sums were taken does not show.
    return state.select("s", F.round("lam", 8).alias("lam"))


def _rounded(cells: DataFrame, most: int) -> DataFrame:
    """s, size, n, base, extra: each document of a cell gets base copies, extra of them one more."""
    c = cells.withColumn("rate", _tilt(most)).withColumn("base", F.floor("rate"))
    by_size = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("sum", F.sum(F.col("n") * (F.col("rate") - F.col("base"))).over(by_size))
    upto = F.floor(F.col("sum") + 0.5)
    c = c.withColumn("extra", upto - F.coalesce(F.lag(upto).over(Window.partitionBy("s").orderBy(F.desc("size"))), F.lit(0)))
    source = Window.partitionBy("s")
    for _ in range(CORRECTIONS):
        c = c.withColumn("left", F.floor(F.col("target") + 0.5) - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(source))
        room = F.when(F.col("left") > 0, F.when(F.col("base") < most, F.col("n") - F.col("extra")).otherwise(0)).otherwise(F.col("extra"))
        able = (room > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("left"))
        c = c.withColumn("room", room).withColumn("pick", F.max(F.when(able, F.col("size"))).over(source))
        step = F.least("room", F.floor(F.abs("left") / F.col("size")))
        c = c.withColumn("extra", F.when(F.col("size") == F.col("pick"), F.col("extra") + F.signum("left").cast("long") * step).otherwise(F.col("extra")))
    return c.select("s", "size", "n", F.col("base").cast("long").alias("base"), F.col("extra").cast("long").alias("extra"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the columns in keep: a row for each row of docs.

    size counts words; targets share all sizes among the sources by weights; taken is copies * size. Rows are decided on one by
    one: those that repeat a doc_id, or have none, count like others. keep may not name any of the other columns, nor those this
    works with (t, h, part, s, base, quota).
    """
    if clash := {c.lower() for c in keep} & MADE:
        raise ValueError(f"a mix has columns of these names: {sorted(clash)}")
    d = docs.select(
        *keep,
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text).cast("string")).alias("t"),
    )
    # Rows without an id differ by their texts.
    d = d.withColumn("h", F.xxhash64(F.coalesce("doc_id", "t"), F.lit(11)))
    with scratch(docs.sparkSession) as kept:
        d = kept(materialise(d.withColumn("part", F.pmod("h", F.lit(PARTS))), "sizes"))
        sums = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
        targets = kept(materialise(source_targets(sums, weights, most), "targets"))
        d = d.join(targets.select(F.col("source").alias("of"), "s"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        parts = materialise(d.groupBy("s", "size", "part").agg(F.count("*").alias("k")), "parts")
        cells = parts.groupBy("s", "size").agg(F.sum("k").alias("n")).join(targets.select("s", (F.col("source_size") / F.col("docs")).alias("scale")), "s")
        cells = materialise(cells.select("s", "size", "n", F.when(F.col("scale") > 0, F.col("size") / F.col("scale")).otherwise(0.0).alias("u")), "cells")
        lam = multipliers(cells, targets, most)
        rounded = _rounded(cells.join(targets.select("s", "source_size", "target"), "s").join(lam, "s"), most)
        before = F.coalesce(F.sum("k").over(Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        quota = parts.withColumn("before", before).join(rounded, ["s", "size"]).select("s", "size", "part", "base", (F.col("extra") - F.col("before")).alias("quota"))
        quota = kept(materialise(quota, "quota"))
    rank = F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("h", "doc_id", "t"))
    out = d.join(quota, ["s", "size", "part"]).withColumn("copies", F.col("base") + F.when(rank <= F.col("quota"), 1).otherwise(0))
    shown = targets.select("s", "source_size", "target")
    return out.join(shown, "s").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (left out at 0 copies), in the same columns."""
    row, times, copy = unused(docs, "__row", "__copies", "__copy")
    known = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = mixed(known, weights=weights, most=most, keep=(row,)).where("copies > 0").select(row, F.col("copies").cast("int").alias(times))
    return known.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
