"""Repair of conversation structure by Knuth's lightest derivations.

A repair is a derivation over weighted hypergraph deductions. An item is a stretch of a conversation read from one state of the turn
grammar (s?(ua)+)? to another; its weight is (cost, rows, audit), audit being the initials of its edits. A deduction joins an item with
an edit of the next row, an insertion or the item of a block that follows: costs and rows add, audits are put together. Rows stand between
cost and audit so that the function is superior (a longer item never comes before its parts): two weights of one item have the same
rows, so they are compared by (cost, audit), and neither audit is a beginning of the other unless it costs less, so order survives joining.
The agenda pops the least item first; what is popped is final, and the first goal item popped is the answer.

Rows are ordered by ranges of (conversation, turn), not by conversation, and are cut into blocks. A conversation within one block is
repaired there. One that reaches over several has its blocks solved from each state to each, joined in rounds, and put together in a stream.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Fixed values of the contract: costs of edits and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after s, after u, after a; what an initial leads to; where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GOALS = (START, ASSISTANT)
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Rows of a block, and blocks joined at a time.
BLOCK, FAN = 512, 32

_SHOWN = re.compile(r"[^\x20\x09-\x0D]")
_ENDS = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
Weight = tuple[int, int, str]
#: At a position: what leads from which state to which, with its weight; 0 rows for insertions, which stay at the position.
Piece = tuple[int, int, Weight]


def lightest(pieces: list[list[Piece]], entry: int, final: bool) -> dict[int, Weight]:
    """The lightest way from entry through all positions to each state, or, if final, to the goal alone (under the key -1)."""
    n, goal = len(pieces), (-1, -1)
    insertions = [(p, q, (INSERT, 0, "I")) for c in "ua" for p, q in NEXT[c].items()]
    agenda: list[tuple[Weight, tuple[int, int]]] = [((0, 0, ""), (0, entry))]
    done: set[tuple[int, int]] = set()
    out: dict[int, Weight] = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in done:
            continue
        done.add(item)
        if item == goal:
            return {-1: weight}
        j, state = item
        cost, rows, audit = weight
        if j == n:
            if not final:
                out[state] = weight
            elif state in GOALS:
                heapq.heappush(agenda, ((cost, rows + 1, audit), goal))
        else:
            for p, q, (c, r, a) in pieces[j]:
                if p == state and (j + 1, q) not in done:
                    heapq.heappush(agenda, ((cost + c, rows + r, audit + a), (j + 1, q)))
        for p, q, (c, r, a) in insertions:
            if p == state and (j, q) not in done:
                heapq.heappush(agenda, ((cost + c, rows + r, audit + a), (j, q)))
    return out


def edits(role: str, fault: int) -> list[Piece]:
    """The edits of one row."""
    out = [(q, q, (DELETE, 1, "D")) for q in range(4)]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        out += [(p, q, (KEEP + more, 1, "K")) for p, q in NEXT.get(role[:1], {}).items()]
        out += [(p, q, (REROLE + more, 1, "R")) for c in "ua" for p, q in NEXT[c].items()]
    return out


def applied(messages: Iterable[tuple[str, str]], audit: str, state: int, at: int = 0, last: bool = True) -> Iterator[tuple[str, str] | tuple[int, int]]:
    """The repaired messages; at the end (state, place in the audit). Insertions behind the last message are made only if last."""
    for role, text in messages:
        while audit[at] == "I":
            state = _by_turn(state)
            yield ("user" if state == USER else "assistant"), ""
            at += 1
        edit, at = audit[at], at + 1
        if edit == "K":
            state = NEXT[role[:1]][state]
            yield role, text
        elif edit == "R":
            state = _by_turn(state)
            yield ("user" if state == USER else "assistant"), text
    while last and at < len(audit):
        state = _by_turn(state)
        yield ("user" if state == USER else "assistant"), ""
        at += 1
    yield state, at


def _by_turn(state: int) -> int:
    return ASSISTANT if state == USER else USER


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that crc32 of conv_id:turn tells; dropped ones stay as marks. Nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    d = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), (F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20).alias("k"))
    text_now = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"), (F.col("k") == 0).alias("dropped"), F.explode(copies).alias("copy"))


_BLOCK = "conv string, block long, turns array<long>, roles array<string>, texts array<string>, faults array<int>, firsts array<binary>"
_BLOCKS = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("firsts", pa.list_(pa.binary())),
])  # fmt: skip


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows in order, in blocks of one conversation each; block numbers follow the order. firsts has digests of messages seen first in the block, else null."""
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "tie", "copy"]
    named = rows.withColumn("conv", F.col("conv_id").cast("string")).withColumn("tie", F.md5("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "dropped", F.spark_partition_id().cast("long").alias("p"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held, size, total, seen, conv, n, p = None, 0, 0, set(), None, 0, 0

        def table() -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS).to_batches()

        for batch in batches:
            for c, turn, role, text, dropped, p in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held is None or c != conv or len(held[0]) >= BLOCK or size >= 1 << 20:
                    if held is not None:
                        done.append((conv, (p << 33) + n, *held))
                        n += 1
                        total += size
                    if len(done) >= 256 or total >= 1 << 22:
                        yield from table()
                        done, total = [], 0
                    held, size, seen, conv = ([], [], [], [], []), 0, set(), c
                if dropped:
                    continue
                fault, first = SOUND, None
                if not _SHOWN.search(text):
                    fault = BLANK
                else:
                    first = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
                    if first in seen:
                        fault, first = DUPLICATE, None
                    else:
                        seen.add(first)
                        fault = SOUND if _ENDS.search(text) else CUT
                for column, value in zip(held, (turn, role, text, fault, first), strict=True):
                    column.append(value)
                size += len(text)
        if held is not None:
            done.append((conv, (p << 33) + n, *held))
        if done:
            yield from table()

    return ordered.mapInArrow(cut, _BLOCK)


def _across(blocks: DataFrame, spread: DataFrame) -> DataFrame:
    """Blocks of conversations of several, with messages seen in an earlier block as duplicates."""
    own = blocks.join(spread.select(F.col("conv").alias("__c"), "first", "parts"), F.col("conv").eqNullSafe(F.col("__c"))).drop("__c")
    seen = own.select("conv", "block", F.posexplode("firsts").alias("pos", "digest")).where("digest is not null")
    earliest = seen.groupBy("conv", "digest").agg(F.min("block").alias("earliest"))
    # A block has a digest once, so that no key is hotter than a conversation has blocks.
    s, e = seen.alias("s"), earliest.alias("e")
    late = s.join(e, F.col("s.conv").eqNullSafe(F.col("e.conv")) & (F.col("s.digest") == F.col("e.digest"))).where("block > earliest").groupBy("block").agg(F.collect_set("pos").alias("late"))
    faults = F.transform("faults", lambda f, i: F.when(F.array_contains("late", i), DUPLICATE).otherwise(f))
    return own.join(late, "block", "left").withColumn("faults", F.when(F.col("late").isNull(), F.col("faults")).otherwise(faults)).drop("late")


_REPORT = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_MESSAGES = "array<struct<role: string, text: string>>"


class _Counts:
    """Counts of a conversation, block by block in order."""

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.initial = None

    def take(self, turns: list, roles: list, faults: list) -> None:
        self.rows += len(roles)
        for turn in turns:
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.distinct += 1
        for role in roles:
            self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        self.blank += faults.count(BLANK)
        self.duplicate += faults.count(DUPLICATE)
        self.truncated += faults.count(CUT)

    def report(self, cost: int, audit: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_OUT = f"conv string, part long, last boolean, messages {_MESSAGES}, {_REPORT}"
_REPORTS = [(n, pa.int64()) for n in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
_OUTS = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("last", pa.bool_()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), *_REPORTS])


def _out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUTS, strict=True)], schema=_OUTS).to_batches()


def _said(messages: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in messages]


def _within(blocks: DataFrame) -> DataFrame:
    """Conversations of one block."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for conv, turns, roles, texts, faults in zip(*(batch.column(c).to_pylist() for c in ("conv", "turns", "roles", "texts", "faults")), strict=True):
                cost, _, audit = lightest([edits(r, f) for r, f in zip(roles, faults, strict=True)], START, True)[-1]
                counts = _Counts()
                counts.take(turns, roles, faults)
                *messages, _ = applied(zip(roles, texts, strict=True), audit, START)
                done.append((conv, 0, True, _said(messages), *counts.report(cost, audit)))
            yield from _out(done)

    return blocks.select("conv", "turns", "roles", "texts", "faults").mapInArrow(solve, _OUT)


_ITEM = "conv string, block long, p int, q int, cost long, n_rows long, audit string"
_ITEMS = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("n_rows", pa.int64()), ("audit", pa.string())])


def _items(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_ITEMS), _ITEMS, strict=True)], schema=_ITEMS)


def _audits(blocks: DataFrame, keep) -> DataFrame:
    """conv, cost, audit of conversations of several blocks: items of blocks, FAN neighbours joined at a time until one is left."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for conv, block, first, roles, faults in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "first", "roles", "faults")), strict=True):
                pieces = [edits(r, f) for r, f in zip(roles, faults, strict=True)]
                for p in (START,) if block == first else range(4):
                    done += [(conv, block, p, q, *w) for q, w in lightest(pieces, p, False).items()]
            yield from _items(done).to_batches()

    def join(key: tuple, group: pa.Table, final: bool) -> pa.Table:
        by_block: dict[int, list[Piece]] = {}
        rows = zip(*(group.column(c).to_pylist() for c in ("block", "p", "q", "cost", "n_rows", "audit")), strict=True)
        for block, p, q, cost, n, audit in rows:
            by_block.setdefault(block, []).append((p, q, (cost, n, audit)))
        pieces = [by_block[b] for b in sorted(by_block)]
        conv, over = key[0].as_py(), key[1].as_py()
        if final:
            cost, n, audit = lightest(pieces, START, True)[-1]
            return _items([(conv, over, START, -1, cost, n - 1, audit)])
        starts = sorted({p for p, _, _ in pieces[0]})
        return _items([(conv, over, p, q, *w) for p in starts for q, w in lightest(pieces, p, False).items()])

    # Blocks are numbered within their conversation by their partition and place; ranks make the numbers dense for the rounds.
    numbers = blocks.groupBy("conv").agg(F.sort_array(F.collect_list("block")).alias("all"))
    dense = numbers.select("conv", F.posexplode("all").alias("rank", "block")).select("block", "rank")
    items = blocks.select("conv", "block", "first", "roles", "faults").mapInArrow(solve, _ITEM)
    items = items.join(dense, "block").drop("block").withColumnRenamed("rank", "block").withColumn("block", F.col("block").cast("long"))
    items = materialise(items, "items")
    while (items.agg(F.max("block")).first()[0] or 0) >= FAN:
        items = materialise(items.withColumn("over", F.floor(F.col("block") / FAN)).groupBy("conv", "over").applyInArrow(lambda k, g: join(k, g, False), _ITEM), "items")
    ended = items.withColumn("over", F.lit(0).cast("long")).groupBy("conv", "over").applyInArrow(lambda k, g: join(k, g, True), _ITEM)
    return keep(materialise(ended.select("conv", "cost", "audit"), "audits"))


def _streamed(blocks: DataFrame, audits: DataFrame) -> DataFrame:
    """Conversations of several blocks, put together block after block behind their audit; nothing but a block and the audit is held."""
    none = lambda kind: F.lit(None).cast(kind)  # noqa: E731
    heads = audits.select("conv", F.lit(-1).cast("long").alias("block"), "cost", "audit", *[none(k).alias(c) for c, k in (("turns", "array<long>"), ("roles", "array<string>"), ("texts", "array<string>"), ("faults", "array<int>"), ("parts", "long"))])
    body = blocks.select("conv", "block", none("long").alias("cost"), none("string").alias("audit"), "turns", "roles", "texts", "faults", F.col("parts").cast("long").alias("parts"))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.unionByName(body).repartition(parts, "conv").sortWithinPartitions(F.asc_nulls_first("conv"), "block")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cost, audit, state, at, part = _Counts(), 0, "", START, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                conv, block, c, a, turns, roles, texts, faults, total = (batch.column(i)[row].as_py() for i in range(9))
                if block < 0:
                    counts, cost, audit, state, at, part = _Counts(), c, a, START, 0, 0
                    continue
                last = part + 1 == total
                counts.take(turns, roles, faults)
                *messages, (state, at) = applied(zip(roles, texts, strict=True), audit, state, at, last)
                yield from _out([(conv, part, last, _said(messages), *(counts.report(cost, audit) if last else [None] * 8))])
                part += 1

    return rows.select("conv", "block", "cost", "audit", "turns", "roles", "texts", "faults", "parts").mapInArrow(put, _OUT)


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text; dropped and copy, as damaged() gives them) repaired: those of one block, and parts of the others.

    Both have conv (conv_id as text), part, last, messages (role, text) and, with the last part, n_rows, gaps, blank, duplicate,
    truncated, illegal, cost and audit. In the second, the parts of a conversation stand in one partition, in order.
    Rows go by turn, nulls first; those of one turn by role and md5 of the text. Roles go by their first character, so any but
    s, u and a must be changed or deleted. A conversation without rows has no messages, no cost and an empty audit. No rows, no conversations.
    """
    with scratch(rows.sparkSession) as keep:
        blocks = keep(materialise(_blocks(rows), "blocks"))
        spread = blocks.groupBy("conv").agg(F.min("block").alias("first"), F.count("*").alias("parts"))
        several = keep(materialise(spread.where("parts > 1"), "several"))
        over = keep(materialise(_across(blocks, several), "across"))
        audits = _audits(over, keep)
    alone = blocks.join(several.select(F.col("conv").alias("__c")), F.col("conv").eqNullSafe(F.col("__c")), "left_anti")
    return _within(alone), _streamed(over, audits)


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation of rows, as repaired() takes them.

    The digest is that of role:text of the repaired messages, joined by newlines. SHA-256 reads a text from its start, so a
    conversation of several parts is digested in a stream of its parts.
    """
    alone, parts = repaired(rows)
    shown = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    one = alone.withColumn("repaired_sha256", F.sha2(lines, 256)).select(*shown)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, any_ = hashlib.sha256(), False
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("part")[i].as_py() == 0:
                    h, any_ = hashlib.sha256(), False
                for m in batch.column("messages")[i].as_py():
                    h.update(f"{chr(10) if any_ else ''}{m['role']}:{m['text']}".encode())
                    any_ = True
                if batch.column("last")[i].as_py():
                    row = batch.slice(i, 1).select(list(shown[:-1]))
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([h.hexdigest()])], names=list(shown))

    several = parts.mapInArrow(digest, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return one.unionByName(several).select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *shown[1:])


def damage_report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged, then repaired: see damaged() and repair_report(). Every conv_id has a row, null among them; other columns are not read."""
    return repair_report(damaged(rows, conv_id, turn, role, text))


def _oracle() -> str:
    """The same in DuckDB: a recursive query carries, for each state, the least (cost and audit, repaired text) row by row."""

    def edit(x: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{x}.t" if line is None else f"{x}.t || chr(10) || {line}"
        key = f"lpad(cast(cast(left({x}.k, 9) as bigint) + {cost} as varchar), 9, '0') || substr({x}.k, 10) || '{letter}'"
        return f"case when {x} is not null then {{'k': {key}, 't': {text}}} end"

    stays = "fault in (0, 3)"
    more = "case when fault = 3 then 3 else 0 end"
    kept = lambda x, i: f"case when {stays} and initial = '{i}' then {edit(x, more, 'K', 'line')} end"  # noqa: E731
    turned = lambda x, r: f"case when {stays} then {edit(x, '3 + ' + more, 'R', chr(39) + r + ':' + chr(39) + ' || text')} end"  # noqa: E731
    gone = lambda x: edit(x, "4", "D", None)  # noqa: E731
    put = lambda x, r: edit(x, "3", "I", f"'{r}:'")  # noqa: E731
    to_user = ", ".join(f"{kept(x, 'u')}, {turned(x, 'user')}" for x in ("s0", "s1", "s3"))
    step = f"""select r.c, r.n, {gone('s0')} as t0, least({gone('s1')}, {kept('s0', 's')}) as t1, least({gone('s2')}, {to_user}) as t2, least({gone('s3')}, {kept('s2', 'a')}, {turned('s2', 'assistant')}) as t3
   from w join r on r.c = w.c and r.n = w.n + 1"""
    closed = f"""select c, n, t0 as s0, t1 as s1, least(t2, {put('t0', 'user')}, {put('t1', 'user')}, {put('t3', 'user')}) as s2, least(t3, {put('u', 'assistant')}) as s3
   from (select *, least(t2, {put('t0', 'user')}, {put('t1', 'user')}) as u from (X) y) z"""
    none = "cast(null as struct(k varchar, t varchar))"
    first = f"select c, 0 as n, {{'k': '000000000', 't': ''}} as t0, {none} as t1, {none} as t2, {none} as t3 from (select distinct c from o) i"
    return rf"""with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
 o as (select conv_id, coalesce(cast(conv_id as varchar), ' ') as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as s from conversations),
 k as (select o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda h: cast(ord(h) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as k from o, crc),
 d as (select c, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
   from k, (select 0 as copy union all select 1) x where k <> 0 and (copy = 0 or k = 3)),
 e as (select *, row_number() over (partition by c order by turn nulls first, role, md5(text), copy) as n from d),
 r as (select *, left(role, 1) as initial, role || ':' || text as line, case when not regexp_matches(text, '[^ 	-]') then 1 when row_number() over (partition by c, role, text order by n) > 1 then 2
   when not regexp_matches(text, '[.!?][ 	-]*$') then 3 else 0 end as fault from e),
 w as ({closed.replace('X', first)} union all {closed.replace('X', step)}),
 g as (select c, arg_max(least(s0, s3), n) as g from w group by 1),
 p as (select *, lag(initial) over (partition by c order by n) as before from r),
 f as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
   count(*) filter (where n > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from p group by 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 cast(left(g.k, 9) as bigint) as cost, substr(g.k, 10) as audit, sha256(substr(g.t, 2)) as repaired_sha256
from (select distinct conv_id, c from o) o join g using (c) left join f using (c)"""


ORACLE = _oracle()
