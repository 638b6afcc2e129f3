"""Exact deduplication by an index of live digests: cuckoo filters, in shards, before stored keys.

A text's digest is the SHA-256 of its UTF-8 after each run of white space became one space; null counts as empty. Digests are dealt to
shards. A shard has a cuckoo filter (16-bit fingerprints in buckets of four) and its keys by home bucket: what the filter does not know is
new, unread; what it knows is compared with the keys of that bucket; a filter that overflows is built again, doubled, from the stored keys.

Equal texts within one part of the input become one entry before anything is shuffled, and decisions return by (part, digest): a group of
copies of any size is at most one row of a part in its shard, and no more than its rows of one part meet in a join.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Fingerprints of a bucket, moves before a filter counts as full, buckets of a new filter.
SLOTS, KICKS, SMALLEST = 4, 500, 64
#: Digests of a shard that are aimed at; digests that a task holds before it hands them on.
SHARD_KEYS, HELD = 1 << 18, 1 << 17

_ENTRY = "shard int, part long, digest binary, n long, first_id long, first_row long"
_STATE = f"{_ENTRY}, buckets int, slots binary, full boolean"


class CuckooFilter:
    """A set of digests that may say yes wrongly, never no; what was added can be taken out again."""

    def __init__(self, buckets: int = SMALLEST, slots: bytes | None = None):
        self.mask = buckets - 1
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))
        self.step = 1

    @property
    def buckets(self) -> int:
        return self.mask + 1

    def home(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little") & self.mask

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = self.home(digest)
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def _put(self, at: int, mark: int) -> bool:
        for i in range(SLOTS * at, SLOTS * at + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[SLOTS * a : SLOTS * a + SLOTS] or mark in self.slots[SLOTS * b : SLOTS * b + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False: full. A fingerprint is then lost, and the filter must be built again from the keys."""
        mark, a, b = self._places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        at = b
        for _ in range(KICKS):
            self.step = (self.step * 69069 + 1) & 0xFFFFFFFF
            i = SLOTS * at + (self.step >> 16) % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            at ^= mark * 0x5BD1E995 & self.mask
            if self._put(at, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Take out one fingerprint of a digest that is in the set."""
        mark, a, b = self._places(digest)
        for at in (a, b):
            for i in range(SLOTS * at, SLOTS * at + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        return False


class LiveDigests:
    """A filter before keys that lie by home bucket; a key's value is [n, (no id, first id, first row)].

    complete: all keys of the filter are here, so that it can grow. Otherwise only those that were asked for are, and full tells that it must.
    """

    def __init__(self, filter: CuckooFilter | None = None, complete: bool = True):
        self.filter, self.complete, self.full = filter or CuckooFilter(), complete, False
        self.content: dict[int, dict[bytes, list]] = {}

    def __len__(self) -> int:
        return sum(map(len, self.content.values()))

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content.values():
            yield from bucket.items()

    def get(self, digest: bytes) -> list | None:
        if digest not in self.filter:
            return None
        return self.content.get(self.filter.home(digest), {}).get(digest)

    def load(self, digest: bytes, value: list) -> None:
        """A stored key, which the filter knows."""
        self.content.setdefault(self.filter.home(digest), {})[digest] = value

    def add(self, digest: bytes, n: int, first: tuple) -> list:
        known = self.get(digest)
        if known is not None:
            known[0] += n
            known[1] = min(known[1], first)
            return known
        value = [n, first]
        self.load(digest, value)
        if not self.full and not self.filter.insert(digest):
            if self.complete:
                self._grow()
            else:
                self.full = True
        return value

    def discard(self, digest: bytes) -> bool:
        """Take a live digest out; one that is not live, though the filter may know its fingerprint, changes nothing."""
        if self.get(digest) is None:
            return False
        del self.content[self.filter.home(digest)][digest]
        return self.filter.delete(digest)

    def _grow(self) -> None:
        keys, buckets = list(self.items()), self.filter.buckets
        while True:
            buckets *= 2
            self.filter, self.content = CuckooFilter(buckets), {}
            for digest, value in keys:
                self.load(digest, value)
            if all(self.filter.insert(digest) for digest, _ in keys):
                return


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "), 256))


def _first(doc_id: int | None, row: int) -> tuple:
    return (doc_id is None, doc_id or 0, row)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


_ENTRIES = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("first_id", pa.int64()), ("first_row", pa.int64())])
_STATES = pa.schema([*_ENTRIES, ("buckets", pa.int32()), ("slots", pa.binary()), ("full", pa.bool_())])


def _entry(shard: int, part: int | None, digest: bytes, value: list) -> tuple:
    n, (no_id, doc_id, row) = value
    return shard, part, digest, n, None if no_id else doc_id, row


def entries(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (row, part, doc_id, digest) to one entry for each digest of a part (of a stretch of it, if it has very many)."""

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, held, now = LiveDigests(), 0, None

        def handed() -> Iterator[pa.RecordBatch]:
            done = [_entry(int.from_bytes(d[16:20], "little") % shards, now, d, v) for d, v in live.items()]
            yield from _table(done, _ENTRIES).to_batches(1 << 14)

        for batch in batches:
            for row, part, doc_id, digest in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "doc_id", "digest")), strict=True):
                if part != now or held >= HELD:
                    yield from handed()
                    live, held, now = LiveDigests(), 0, part
                held += live.add(digest, 1, _first(doc_id, row))[0] == 1
        yield from handed()

    return rows.select("row", "part", "doc_id", "digest").mapInArrow(combine, _ENTRY)


def _folded(new: pa.Table, stored: pa.Table, complete: bool) -> pa.Table:
    """One shard: entries taken into its filter and keys. Rows of a part are decisions, rows without are keys, the row with slots is the filter."""
    old = {c: stored.column(c).to_pylist() for c in stored.column_names}
    given = {c: new.column(c).to_pylist() for c in new.column_names}
    shard = (given["shard"] or old["shard"])[0]
    at = next((i for i, s in enumerate(old["slots"]) if s is not None), None)
    # Without a filter to start from, one is built from the keys.
    live = LiveDigests(CuckooFilter(old["buckets"][at], old["slots"][at]) if at is not None else None, complete)
    for digest, n, doc_id, row in zip(old["digest"], old["n"], old["first_id"], old["first_row"], strict=True):
        if digest is not None:
            (live.load(digest, [n, _first(doc_id, row)]) if at is not None else live.add(digest, n, _first(doc_id, row)))
    asked = {}
    for part, digest, n, doc_id, row in zip(given["part"], given["digest"], given["n"], given["first_id"], given["first_row"], strict=True):
        asked[part, digest] = live.add(digest, n, _first(doc_id, row))
    rest = (None, None, None)
    out = [(*_entry(shard, part, digest, v), *rest) for (part, digest), v in asked.items()]
    out += [(*_entry(shard, None, digest, v), *rest) for digest, v in {d: v for (_, d), v in asked.items()}.items()]
    out.append((shard, None, None, None, None, None, live.filter.buckets, live.filter.slots.tobytes(), live.full))
    return _table(out, _STATES)


class CuckooIndex:
    """Live documents by digest, in tables of the shared folder: members (digest, doc_id, row), keys and filters of shards.

    insert() and delete() write new tables beside those they read, so a lost executor or a stopped call leaves the index as it was.
    Rows without an id can be inserted; only rows with one can be deleted.
    """

    def __init__(self, spark: SparkSession, shards: int | None = None):
        self.spark = spark
        self.shards = shards
        self.members: DataFrame | None = None
        self.keys: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.batches = 0

    def _numbered(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        row = F.monotonically_increasing_id()
        digested = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"))
        rows = digested.select("doc_id", "digest", row.alias("row"), F.shiftright(row, 33).alias("part"))
        rows = materialise(rows, "digests")
        if self.shards is None:
            self.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_KEYS))
        return rows

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Take docs in; doc_id, keep_id, group_size, kept, digest of each of their rows, as the index stands then.

        keep_id is the smallest doc_id of equal texts, group_size their number; of rows that repeat it, the one taken in first is kept,
        and so is the first of rows that all have no id.
        """
        with scratch(self.spark) as keep:
            rows = keep(self._numbered(docs, doc_id, text))
            # Rows of later batches come after those before.
            rows = rows.withColumn("row", F.col("row") + F.lit(self.batches << 56))
            new = entries(rows, self.shards)
            state = self._taken(new, keep)
        self.batches += 1
        decided = state.where("part is not null").select("part", "digest", F.col("n").alias("group_size"), F.col("first_id").alias("keep_id"), F.col("first_row").alias("keep_row"))
        stored = rows.select("digest", "doc_id", "row")
        self.members = stored if self.members is None else self.members.unionByName(stored)
        out = rows.join(decided, ["part", "digest"])
        return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")

    def _taken(self, new: DataFrame, keep) -> DataFrame:
        empty = self.spark.createDataFrame([], _STATE)
        if self.filters is None:
            state = keep(materialise(_fold(new, empty, True), "index"))
            self.keys, self.filters = _keys(state), _filters(state)
            return state
        new = materialise(new, "entries")
        known = self.keys.join(self._maybe(new), "digest", "left_semi")
        state = materialise(_fold(new, known.unionByName(self.filters), False), "index")
        over = state.where("full").select("shard")
        if not over.isEmpty():
            # Filters that overflowed are built from all keys of their shards.
            again = _fold(new.join(over, "shard", "left_semi"), self.keys.join(over, "shard", "left_semi"), True)
            state = state.join(over, "shard", "left_anti").unionByName(again)
        state = keep(materialise(state, "index"))
        own, filters = _keys(state), _filters(state)
        self.keys = keep(materialise(self.keys.join(own.select("digest"), "digest", "left_anti").unionByName(own), "keys"))
        self.filters = keep(materialise(self.filters.join(filters.select("shard"), "shard", "left_anti").unionByName(filters), "filters"))
        return state

    def _maybe(self, asked: DataFrame) -> DataFrame:
        """The digests (shard, digest) that the filters know, wrongly or not."""

        def look(new: pa.Table, filters: pa.Table) -> pa.Table:
            found: list[bytes] = []
            if filters.num_rows:
                f = CuckooFilter(filters.column("buckets")[0].as_py(), filters.column("slots")[0].as_py())
                found = [d for d in set(new.column("digest").to_pylist()) if d in f]
            return pa.table({"digest": pa.array(found, pa.binary())})

        return asked.select("shard", "digest").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(look, "digest binary")

    def lookup(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, live, keep_id, group_size: whether texts equal to a row's are in the index. Only hits of the filters are compared with keys."""
        with scratch(self.spark) as keep:
            rows = keep(self._numbered(docs, doc_id, text))
            if self.filters is None:
                return rows.select("doc_id", F.lit(False).alias("live"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
            new = materialise(entries(rows, self.shards).select("shard", "part", "digest").distinct(), "entries")
            hits = self.keys.join(self._maybe(new), "digest", "left_semi").select("digest", "n", "first_id")
            found = keep(materialise(new.join(hits, "digest"), "found"))
        j = rows.join(found.select("part", "digest", "n", "first_id"), ["part", "digest"], "left")
        return j.select("doc_id", F.col("n").isNotNull().alias("live"), F.col("first_id").alias("keep_id"), F.coalesce("n", F.lit(0)).cast("long").alias("group_size"))

    def delete(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Take the rows of docs (id and text) out of the index; rows that are not in it change nothing."""
        if self.filters is None:
            return
        with scratch(self.spark) as keep:
            rows = self._numbered(docs, doc_id, text)
            asked = rows.where("doc_id is not null").select("digest", "doc_id").distinct()
            members = keep(materialise(self.members.join(asked, ["digest", "doc_id"], "left_anti"), "members"))
            touched = materialise(self.members.join(asked, ["digest", "doc_id"], "left_semi").select("digest").distinct(), "touched")
            live = members.join(touched, "digest", "left_semi")
            first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c")))
            left = live.groupBy("digest").agg(F.count("*").alias("n"), first.alias("f"))
            old = self.keys.join(touched, "digest", "left_semi").select("shard", "digest")
            now = materialise(old.join(left, "digest", "left").select("shard", "digest", "n", F.col("f.b").alias("first_id"), F.col("f.c").alias("first_row")), "now")
            gone = now.where("n is null").select("shard", "digest")

            def take(dead: pa.Table, filters: pa.Table) -> pa.Table:
                f = CuckooFilter(filters.column("buckets")[0].as_py(), filters.column("slots")[0].as_py())
                for digest in dead.column("digest").to_pylist():
                    f.delete(digest)
                return filters.set_column(filters.column_names.index("slots"), "slots", pa.array([f.slots.tobytes()], pa.binary()))

            changed = gone.groupBy("shard").cogroup(self.filters.join(gone.select("shard").distinct(), "shard", "left_semi").groupBy("shard")).applyInArrow(take, self.filters.schema)
            own = now.where("n is not null").select("shard", F.lit(None).cast("long").alias("part"), "digest", "n", "first_id", "first_row", F.lit(None).cast("int").alias("buckets"), F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("boolean").alias("full"))
            keys = keep(materialise(self.keys.join(touched, "digest", "left_anti").unionByName(own), "keys"))
            filters = keep(materialise(self.filters.join(gone.select("shard").distinct(), "shard", "left_anti").unionByName(changed), "filters"))
        self.members, self.keys, self.filters = members, keys, filters


def _keys(state: DataFrame) -> DataFrame:
    return state.where("digest is not null and part is null")


def _filters(state: DataFrame) -> DataFrame:
    return state.where("slots is not null").withColumn("full", F.lit(False))


def _fold(new: DataFrame, stored: DataFrame, complete: bool) -> DataFrame:
    return new.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(lambda a, b: _folded(a, b, complete), _STATE)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs; of equal texts one is kept, that of the smallest doc_id.

    Null texts are empty ones. Rows without an id come after those with one; of rows that repeat a group's smallest id, or of a group
    without any, one is kept. An empty table gives no rows; other columns are not read.
    """
    decided = CuckooIndex(docs.sparkSession).insert(docs, doc_id, text)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents) d"""
