"""State along an order within a source, without one task for a source: parts of the order are read apart, and what came before each part is added.

running() adds sums, maxima and minima. scan() carries a state whose steps are functions that compose: each part's function is found without
knowing the state it starts from, the functions are put together part after part, and each part is read again from its own start.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Span of seq that is scanned in one place; span of time in microseconds (about a minute), of which again so many are scanned in one place.
PART, SPAN = 1 << 16, 1 << 26
_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
_FAR = 1 << 62


def running(df: DataFrame, columns: dict[str, tuple[str, Column, bool]], key: str = "source", order: str = "seq", part: int | None = None, levels: int = 1) -> DataFrame:
    """df with running values by key: name -> (sum, max or min; value; whether the row itself counts). order is a whole number, unique within a key.

    levels: parts of parts, for an order with wide gaps such as a time, in which rows are few in a part and parts are many.
    """
    d = df.withColumn("__part", F.floor(F.col(order) / (part or PART))).withColumns({f"__{n}": v for n, (_, v, _) in columns.items()})
    totals = d.groupBy(key, "__part").agg(*[getattr(F, kind)(f"__{n}").alias(f"__{n}") for n, (kind, _, _) in columns.items()])
    if levels > 1:
        # Values get names of this level, as the next one makes columns of its own.
        upper = totals.select(key, F.col("__part").alias("at"), *[F.col(f"__{n}").alias(f"v{levels}_{n}") for n in columns])
        deeper = running(upper, {f"b{levels}_{n}": (kind, F.col(f"v{levels}_{n}"), False) for n, (kind, _, _) in columns.items()}, key, "at", part, levels - 1)
        before = deeper.select(key, F.col("at").alias("__part"), *[F.col(f"b{levels}_{n}").alias(f"__before_{n}") for n in columns])
    else:
        ahead = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(key, "__part", *[getattr(F, kind)(f"__{n}").over(ahead).alias(f"__before_{n}") for n, (kind, _, _) in columns.items()])
    inside = Window.partitionBy(key, "__part").orderBy(order)
    own = {n: getattr(F, kind)(f"__{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)) for n, (kind, _, itself) in columns.items()}
    out = d.withColumns({f"__own_{n}": c for n, c in own.items()}).join(before, [key, "__part"])
    out = out.withColumns({n: _MERGE[kind](F.col(f"__before_{n}"), F.col(f"__own_{n}")) for n, (kind, _, _) in columns.items()})
    return reduce(lambda x, n: x.drop(f"__{n}", f"__own_{n}", f"__before_{n}"), columns, out).drop("__part")


def asof(asks: DataFrame, marks: DataFrame, value: Column, name: str, key: str = "source", at: str = "at", by: str = "seq", part: int = SPAN, levels: int = 2) -> DataFrame:
    """asks (key, at, ...) with name: the value of the last of marks (key, at, by), in order of (at, by), whose time is not after the ask's; null if none.

    Times are whole numbers. Marks of one time become one before anything is ordered. part and levels are those of running().
    """
    last = marks.groupBy(key, at).agg(F.max(F.struct(F.col(at).alias("a"), F.col(by).alias("b"), value.alias("v"))).alias("__m"))
    points = last.unionByName(asks.select(key, at).distinct(), allowMissingColumns=True).groupBy(key, at).agg(F.max("__m").alias("__m"))
    found = running(points, {"__last": ("max", F.col("__m"), True)}, key, at, part, levels).select(key, at, F.col("__last.v").alias(name))
    return asks.join(found, [key, at])


class Rule(NamedTuple):
    """How a state is carried: summary of a part's rows, the state after a part (from its summary and the state before), and one step."""

    summary: Callable[[list[tuple]], list[int | None]]
    after: Callable[[list[int | None], int | None], int | None]
    step: Callable[[int | None, tuple], int | None]


def _held_step(x: int | None, row: tuple) -> int | None:
    low, high, value = row
    if value is None:
        return x
    return x if x is not None and low <= x <= high else value


def _held_summary(rows: list[tuple]) -> list[int | None]:
    """From the last row back: within [low, high] what the later rows make of a state, elsewhere what they make of value.

    Pieces (start, end, outcome; None: the state itself) lie between the bounds that all rows so far leave; outside is one outcome.
    """
    pieces: deque[tuple[int, int, int | None]] = deque([(-_FAR, _FAR, None)])
    outside: int | None = None
    some = False
    for low, high, value in reversed(rows):
        if value is None:
            continue
        some = True
        first, last = pieces[0][0], pieces[-1][1]
        if high < first or low > last:
            pieces = deque([(low, high, outside)])
        else:
            while pieces[0][1] < low:
                pieces.popleft()
            while pieces[-1][0] > high:
                pieces.pop()
            pieces[0] = (max(pieces[0][0], low), *pieces[0][1:])
            pieces[-1] = (pieces[-1][0], min(pieces[-1][1], high), pieces[-1][2])
            if low < first:
                joined = pieces.popleft() if pieces[0][2] == outside and outside is not None else None
                pieces.appendleft((low, joined[1] if joined else first - 1, outside))
            if high > last:
                joined = pieces.pop() if pieces[-1][2] == outside and outside is not None else None
                pieces.append((joined[0] if joined else last + 1, high, outside))
        found = next(p for p in (pieces if value - low <= high - value else reversed(pieces)) if p[0] <= value <= p[1])
        outside = value if found[2] is None else found[2]
    return [outside, *[x for p in pieces for x in p]] if some else []


def _held_after(summary: list[int | None], x: int | None) -> int | None:
    if not summary or x is None:
        return summary[0] if summary else x
    low, high = 0, (len(summary) - 1) // 3  # the last piece that starts at x or before
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if summary[1 + 3 * middle] <= x else (low, middle)
    if low and x <= summary[3 * low - 1]:
        return x if summary[3 * low] is None else summary[3 * low]
    return summary[0]


def _clamp(x: int, low: int, high: int) -> int:
    return min(max(x, low), high)


def _clamped_summary(rows: list[tuple]) -> list[int | None]:
    least, most = -_FAR, _FAR
    for low, high in rows:
        least, most = _clamp(least, low, high), _clamp(most, low, high)
    return [least, most]


#: Columns low, high, value: the state stays if it lies within [low, high], else becomes value; a null value changes nothing.
HELD = Rule(_held_summary, _held_after, _held_step)
#: Columns low, high: the state is brought within [low, high].
CLAMPED = Rule(_clamped_summary, lambda s, x: _clamp(x, *s), lambda x, row: _clamp(x, *row))


def scan(df: DataFrame, rule: Rule, columns: list[Column], name: str, start: int | None = None, key: str = "source", order: str = "seq", part: int | None = None, before: bool = False) -> DataFrame:
    """df with name (long): the state after each row (before it, if before), by key and order, from start on.

    No task holds more than one part of a key, or one short summary of each of a key's parts.
    """
    given, own = [f"__c{i}" for i in range(len(columns))], list(df.columns)
    d = df.withColumns(dict(zip(given, [c.cast("long") for c in columns], strict=True))).withColumn("__part", F.floor(F.col(order) / (part or PART)))
    kind = df.schema[key].dataType.simpleString()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def laid(t: DataFrame, *by: str) -> DataFrame:
        """Rows of a group in one partition, in order, group after group.

        A hash of the columns places them: an exchange by the columns themselves is left out where a join below has made the same one,
        and when that join becomes a broadcast at run time, its shuffle is read by mapper, and groups come apart.
        """
        return t.repartition(tasks, F.xxhash64(*by)).sortWithinPartitions(*by, *([order] if order in t.columns else ["__part"]))

    def lists(batch: pa.RecordBatch, *names: str) -> list[list]:
        return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]

    def table(rows: list[tuple], *types: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[key, "__part", "__f"])

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, steps, done, type_ = None, [], [], None
        for batch in batches:
            type_ = batch.schema.field(key).type
            for k, p, *row in zip(*lists(batch, key, "__part", *given), strict=True):
                if now != (k, p):
                    if steps:
                        done.append((*now, rule.summary(steps)))
                    now, steps = (k, p), []
                steps.append(tuple(row))
            if len(done) > 1000:
                yield table(done, type_, pa.int64(), pa.list_(pa.int64()))
                done = []
        if steps:
            done.append((*now, rule.summary(steps)))
        if done:
            yield table(done, type_, pa.int64(), pa.list_(pa.int64()))

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, first = None, start, True
        for batch in batches:
            done = []
            for k, p, f in zip(*lists(batch, key, "__part", "__f"), strict=True):
                if first or k != now:
                    now, x, first = k, start, False
                done.append((k, p, x))
                x = rule.after(f, x)
            if done:
                yield table(done, batch.schema.field(key).type, pa.int64(), pa.int64())

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, None
        for batch in batches:
            out = []
            for k, p, begins, *row in zip(*lists(batch, key, "__part", "__x", *given), strict=True):
                if now != (k, p):
                    now, x = (k, p), begins
                y = rule.step(x, row)
                out.append(x if before else y)
                x = y
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(out, pa.int64())], names=[*own, name])

    narrow = d.select(key, "__part", *([order] if order not in (key, "__part") else []), *given)
    functions = laid(narrow, key, "__part").mapInArrow(summarise, f"{key} {kind}, __part long, __f array<long>")
    entries = laid(functions, key).mapInArrow(chain, f"{key} {kind}, __part long, __f long").withColumnRenamed("__f", "__x")
    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    return laid(d.join(entries, [key, "__part"]), key, "__part").mapInArrow(walk, schema)
