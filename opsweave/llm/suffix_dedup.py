"""Removal of repeated strings by prefix-free parsing.

A text is a sequence of symbols: its bytes, or its words. A rolling hash over a few symbols sets triggers: in each stretch
of `reach` starts, the least hash is one. Triggers depend on the symbols around them only, so equal strings of `length`
symbols are cut alike wherever they lie, and start equally far before their trigger.

- The parse suffix of a trigger is the text from it on; its first part, which the strings of all its starts cover, is the core.
- A phrase is the run of starts that belong to one trigger. The dictionary holds the distinct phrases with all that
  their strings cover, so copies are one entry, however many there are.

Suffixes of the corpus lie in the order of (dictionary suffix before the trigger, parse suffix from it on), and strings that
occur twice are neighbours whose common prefix has `length` symbols. Only suffixes with a partner are put in order:
those whose core occurs elsewhere. Entries that occur twice are repeated as a whole. For the others, the entries of one core
are sorted twice, by the symbols before the trigger, read backwards (dictionary suffixes), and by those after the core
(parse suffixes), with the common prefixes of neighbours. A start l symbols before its trigger is
repeated if another entry agrees with it in l symbols of the first order and in the rest of the string in the second.

Phrases are the same if two hashes are, of their symbols and of their core's (xxh3, 64 bits each); cores whose entries are sorted, by
128 bits more. What is sorted is compared symbol by symbol.
Rows are phrases, not bytes. No group is gathered in one place: counts are partial sums, and the entries of a core are
dealt out by the thousand, where what stays single meets again by its string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, kept_id, materialise, mix, packed, powers, prefix_hash, scratch, slice_digests, slice_hash, spread, unpacked, unused, word_spans

_LOCAL = 20
#: Dictionary entries of one core that are sorted in one place; more are dealt out.
TOGETHER = 4096


def reach_of(length: int) -> tuple[int, int]:
    """Starts that share a trigger at most, and symbols of the rolling hash."""
    return max(1, length * 7 // 10), max(1, min(16, length // 25))


def symbols(data: bytes, unit: str) -> np.ndarray:
    """The text as an array of bytes, or of 64-bit hashes of its words, most significant byte first."""
    if unit == "bytes":
        return np.frombuffer(data, np.uint8)
    raw = np.frombuffer(data, np.uint8)
    return slice_digests(raw, *word_spans(raw)).astype(">u8")


def _chunks(n: int, length: int, step: int = 1 << 19):
    """(first start, end of starts) of a text of n symbols, in parts."""
    starts = n - length + 1
    for at in range(0, max(starts, 0), step):
        yield at, min(at + step, starts)


def phrases(x: np.ndarray, length: int):
    """For each trigger: the first start that belongs to it, the number of those starts, and its own place."""
    reach, gram = reach_of(length)
    for low, high in _chunks(len(x), length):
        part = x[low : high - 1 + length]
        h = prefix_hash(part) if part.dtype == np.uint8 else np.append(U64(0), np.cumsum(mix(part.astype(U64)) * powers(_BASE, len(part))[:-1]))
        at = np.arange(len(part) - gram + 1)
        r = mix(slice_hash(h, at, at + gram) if part.dtype == np.uint8 else (h[at + gram] - h[at]) * powers(_INVERSE, len(part))[at])
        m = high - low
        need = m + reach - 1  # hashes that the starts look at
        size = -(-need // reach) * reach
        v = np.full(size, 0xFFFFFFFFFFFFFFFF, U64)
        v[:need] = (r[:need] >> U64(_LOCAL) << U64(_LOCAL)) | np.arange(need, dtype=U64)
        blocks = v.reshape(-1, reach)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        trigger = (np.minimum(behind[:m], ahead[reach - 1 : reach - 1 + m]) & U64((1 << _LOCAL) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
        last = np.append(first[1:], m) - 1
        yield first + low, last - first + 1, trigger[first] + low


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def parse(texts: DataFrame, length: int, unit: str) -> DataFrame:
    """row, start, n, ahead (from the first start to the trigger), core, whole (their hashes): a row for each phrase of each text."""
    covers = length - reach_of(length)[0] + 1

    def run(batches):
        for batch in batches:
            ids, places, hashes = [], [], []
            for row, text in zip(batch["row"].tolist(), batch["packed"].tolist(), strict=True):
                x = symbols(unpacked(text), unit)
                if len(x) < length:
                    continue
                w, raw = x.itemsize, x.tobytes()
                for start, n, at in phrases(x, length):
                    ids.append(np.full(len(start), row, np.int64))
                    places.append(np.column_stack([start, n, at - start]).astype(np.int32))
                    cores = [xxhash.xxh3_64_intdigest(raw[a : a + w * covers]) for a in (at * w).tolist()]
                    whole = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((start * w).tolist(), ((start + n - 1 + length) * w).tolist(), strict=True)]
                    # Equal phrases have their trigger at the same place, too.
                    hashes.append(np.column_stack([np.array(cores, U64), np.array(whole, U64) ^ mix((at - start).astype(U64), 7)]))
                if sum(map(len, ids)) > 1 << 18:
                    yield _phrase_frame(ids, places, hashes)
                    ids, places, hashes = [], [], []
            if ids:
                yield _phrase_frame(ids, places, hashes)

    return texts.mapInPandas(run, "row long, start int, n int, ahead int, core long, whole long")


def _phrase_frame(ids: list, places: list, hashes: list) -> pd.DataFrame:
    p, h = np.concatenate(places), np.concatenate(hashes).view(np.int64)
    return pd.DataFrame({"row": np.concatenate(ids), "start": p[:, 0], "n": p[:, 1], "ahead": p[:, 2], "core": h[:, 0], "whole": h[:, 1]})


def _order(keys: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the parts in order within equal keys, and how many bytes each has in common with the one before it (-1 across keys)."""
    head = np.ascontiguousarray(keys.astype(">u4")).view(np.uint8).reshape(-1, 4)
    body = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)
    table = np.hstack([head, body])
    order = np.argsort(table.view(f"S{4 + width}").reshape(-1), kind="stable")
    table = table[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + width) - 4
    return order, np.maximum(common, -1)


def repeated_starts(entries: pd.DataFrame, reach: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry and each distance l to the trigger: whether a start is there, whether it is repeated, whether it is the first of its kind.

    before and after are what lies before the trigger, backwards, and after the core; width: bytes of a symbol.
    """
    m = len(entries)
    key = pd.factorize(pd.MultiIndex.from_frame(entries[["core", "chunk", "k1", "k2"]]))[0]
    orders = []
    for column in ("before", "after"):
        order, common = _order(key, entries[column].tolist(), width * (reach - 1))
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        orders.append((place, np.where(common < 0, -1, common // width)))
    most = entries["ahead"].to_numpy(np.int64)
    least = most - entries["n"].to_numpy(np.int64) + 1
    is_start, twice, first = (np.zeros((m, reach), bool) for _ in range(3))
    for l in range(reach):
        here = np.flatnonzero((least <= l) & (l <= most))
        if not len(here):
            continue
        is_start[here, l] = True
        classes = [np.append(0, np.cumsum(common < depth))[place[here]] for (place, common), depth in zip(orders, (l, reach - 1 - l), strict=True)]
        _, at, kind, count = np.unique(classes[0] * m + classes[1], return_index=True, return_inverse=True, return_counts=True)
        twice[here, l] = count[kind] > 1
        first[here[at], l] = True
    return is_start, twice, first


def _combined(entries: pd.DataFrame, length: int, width: int) -> pd.DataFrame:
    """Repeated strings among the entries of whole cores (or chunks of them).

    Returns spans (row, start, stop) of starts found repeated, for entries that occur once; and for entries of cores that
    are dealt out (many), hashes of the strings that can still meet an equal: single ones, and one of each repeated string.
    """
    entries = entries.reset_index(drop=True)
    reach = reach_of(length)[0]
    is_start, twice, first = repeated_starts(entries, reach, width)
    row, start, ahead = (entries[c].to_numpy(np.int64) for c in ("row", "start", "ahead"))
    alone, many = entries["alone"].to_numpy(bool), entries["many"].to_numpy(bool)
    # Places before the trigger count backwards: turned round, runs of starts go forwards.
    hit = (twice & alone[:, None])[:, ::-1]
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (e, begins), (_, ends) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    trigger = (start + ahead)[e]
    spans = pd.DataFrame({"row": row[e], "start": trigger - (reach - 1 - begins), "stop": trigger - (reach - ends) + length})
    e, l = np.nonzero(is_start & many[:, None] & (first & (twice | ~alone[:, None]) | ~twice & alone[:, None]))
    parts = entries[["before", "after", "k1", "k2"]].to_numpy()
    strings = []
    for i, depth in zip(e.tolist(), l.tolist(), strict=True):
        before, after, k1, k2 = parts[i]
        strings.append(xxhash.xxh3_128_digest(b"%d %d %d %b%b" % (depth, k1, k2, before[: depth * width], after[: (reach - 1 - depth) * width])))
    r = np.frombuffer(b"".join(strings), np.int64).reshape(-1, 2) if strings else np.empty((0, 2), np.int64)
    rest = pd.DataFrame({"row": row[e], "start": (start + ahead)[e] - l, "alone": alone[e] & ~twice[e, l], "r1": r[:, 0], "r2": r[:, 1]})
    return pd.concat([spans, rest]).astype({"alone": "boolean", "stop": "Int64", "r1": "Int64", "r2": "Int64"})


def repeated_spans(texts: DataFrame, length: int, unit: str = "bytes") -> DataFrame:
    """row, spans: array of (start, stop) ranges of symbols that repeated strings cover, a row for each row of texts (row, packed) that has any."""
    reach, width = reach_of(length)[0], 1 if unit == "bytes" else 8
    covers = length - reach + 1
    with scratch(texts.sparkSession) as keep:
        parsed = materialise(parse(texts, length, unit), "phrases")
        shared = materialise(parsed.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), "cores")
        parsed = keep(materialise(parsed.join(shared, "core", "left_semi"), "shared"))

        # The dictionary: an entry for each distinct phrase.
        entry = parsed.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "n", "ahead")).alias("at"))
        entry = keep(materialise(entry, "dictionary"))
        some = entry.groupBy("core").agg(F.count("*").alias("entries"), F.min("times").alias("rarest"))
        some = materialise(some.where("entries > 1 and rarest = 1").select("core", F.ceil(F.col("entries") / TOGETHER).alias("chunks")), "contested")
        # Cores of several entries, of which one occurs once: suffix by suffix.
        chunk = F.pmod(F.xxhash64("whole"), F.col("chunks"))
        apart = entry.join(some, "core").select("at.row", F.struct("at.start", "at.n", "at.ahead", (F.col("times") == 1).alias("alone"), "core", chunk.alias("chunk"), (F.col("chunks") > 1).alias("many")).alias("part"))
        listed = apart.groupBy("row").agg(F.collect_list("part").alias("parts"))

        def contexts(batches):
            for batch in batches:
                rows = []
                for row, text, parts in zip(batch["row"].tolist(), batch["packed"].tolist(), batch["parts"].tolist(), strict=True):
                    x = symbols(unpacked(text), unit)
                    for p in parts:
                        at = p["start"] + p["ahead"]
                        core = xxhash.xxh3_128_digest(x[at : at + covers].tobytes())
                        # After the core come as many symbols as the last start's string has there.
                        after = x[at + covers : p["start"] + p["n"] - 1 + length]
                        rows.append((row, p["start"], p["n"], p["ahead"], p["alone"], p["many"], p["core"], p["chunk"], int.from_bytes(core[:8], "little", signed=True), int.from_bytes(core[8:], "little", signed=True), x[p["start"] : at][::-1].tobytes(), after.tobytes()))
                yield pd.DataFrame(rows, columns=["row", "start", "n", "ahead", "alone", "many", "core", "chunk", "k1", "k2", "before", "after"])

        def ordered(batches):
            held = None
            for batch in batches:
                if held is not None:
                    batch = pd.concat([held, batch], ignore_index=True)
                key = batch[["core", "chunk"]].to_numpy()
                cut = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1 if len(batch) else 0
                held = batch.iloc[cut:]
                if cut:
                    yield _combined(batch.iloc[:cut], length, width)
            if held is not None and len(held):
                yield _combined(held, length, width)

        schema = "row long, start long, n long, ahead long, alone boolean, many boolean, core long, chunk long, k1 long, k2 long, before binary, after binary"
        dictionary = texts.join(listed, "row").select("row", "packed", "parts").mapInPandas(contexts, schema)
        dealt = spread(dictionary, "core", "chunk").sortWithinPartitions("core", "chunk")
        ranked = keep(materialise(dealt.mapInPandas(ordered, "row long, start long, stop long, alone boolean, r1 long, r2 long"), "suffixes"))

    whole = parsed.join(entry.where("times > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    spans = whole.select("row", "start", (F.col("start") + F.col("n") - 1 + length).cast("long").alias("stop"))
    open_ = ranked.where("r1 is not null")
    twice = open_.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1").select("r1", "r2")
    single = open_.where("alone").join(twice, ["r1", "r2"], "left_semi")
    spans = spans.unionByName(ranked.where("r1 is null").select("row", "start", "stop")).unionByName(single.select("row", "start", (F.col("start") + length).alias("stop")))
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> np.ndarray:
    """Sorted, disjoint (start, stop) rows from any number of overlapping or touching ones."""
    if spans is None or not len(spans):
        return np.empty((0, 2), np.int64)
    a = np.array([(s["start"], s["stop"]) for s in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.append(True, a[1:, 0] > reach[:-1])
    return np.column_stack([a[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])])


def without(data: bytes, spans: np.ndarray) -> bytes:
    """data without the spans."""
    cuts = [0, *spans.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def removal_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, words: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages: a row for each row of docs, by its whole text as UTF-8 bytes.

    A byte goes if a string of length bytes that also starts anywhere else covers it, judged on the input. n_passages counts,
    without removing anything, the passages of words or more that also stand elsewhere, word by word.
    Null texts are empty. Rows are searched one by one: without a doc_id, or with one that repeats, they count like others.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("doc_id"), packed(F.col(text)).alias("packed"))
    texts = materialise(texts, "texts")
    found = repeated_spans(texts, length).withColumnRenamed("spans", "cut")
    passages = repeated_spans(texts, words, "words").withColumnRenamed("spans", "passages")
    joined = texts.join(found, "row", "left").join(passages, "row", "left")

    def run(batches):
        for batch in batches:
            out = []
            for doc, t, s, p in zip(batch["doc_id"], batch["packed"].tolist(), batch["cut"].tolist(), batch["passages"].tolist(), strict=True):
                data, cut = unpacked(t), merged(s)
                kept = without(data, cut)
                out.append((doc, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), len(merged(p))))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    joined = joined.select("doc_id", "packed", "cut", "passages")
    return kept_id(joined.mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"))


def _whole_characters(data: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without characters of which a byte lies outside."""
    inside = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80  # bytes that continue a character
    out = []
    for a, b in spans.tolist():
        while a < b and inside[a]:
            a += 1
        while b > a and b < len(data) and inside[b]:
            b -= 1
        if b > a:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, unit: str = "bytes") -> DataFrame:
    """docs with repeated strings taken out of the text, in the same columns.

    unit bytes: as removal_digests(), but a character of which a byte stays is kept. unit words: passages of length words
    or more that also stand elsewhere go, from their first word to their last. Null texts stay null.
    """
    row, bytes_, cuts = unused(docs, "__row", "__packed", "__spans")
    known = materialise(docs.withColumns({row: F.monotonically_increasing_id(), bytes_: packed(F.col(text))}), "rows")
    texts = known.select(F.col(row).alias("row"), F.col(bytes_).alias("packed"))
    spans = repeated_spans(texts, length, unit).select(F.col("row").alias(row), F.col("spans").alias(cuts))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or s is None:
                return t
            data, cut = t.encode(), merged(s)
            if unit == "words":
                start, stop = word_spans(np.frombuffer(data, np.uint8))
                cut = np.column_stack([start[cut[:, 0]], stop[cut[:, 1] - 1]])
            return without(data, _whole_characters(data, cut)).decode()

        return pd.Series([one(t, s) for t, s in zip(texts.tolist(), spans.tolist(), strict=True)], dtype=object)

    return known.drop(bytes_).join(spans, row, "left").withColumn(text, kept(F.col(text), F.col(cuts))).select(*docs.columns)
