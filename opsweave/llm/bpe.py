"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary; what it misses is
merged with a heap over linked bytes. Pre-tokens are split with numpy, on whole texts.

Null texts count as empty. Ids follow the ranks of the vocabulary file; there are no special tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, in_slices, kept_id, mix, prefix_hash, slice_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Pre-tokens of earlier batches whose merges a Python worker keeps.
KEEP = 400_000


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point; the pattern library's own Unicode tables decide, whatever their version."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def token_starts(cps: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where the matches of the pre-token pattern start; doc_start: positions at which texts start."""
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    cls = char_classes()[cps]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    fresh = np.zeros(n, bool)
    fresh[doc_start[doc_start < n]] = True
    new |= fresh
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    kind = cls[run]
    follows = np.append(~fresh[run[1:]], False)  # the next run is of the same text
    start = np.zeros(n, bool)
    start[run] = True
    # White space before other text: its last character goes its own way, a blank with what follows.
    split = (kind == SPACE) & follows
    start[end[split] - 1] = True
    bound = split & (cps[end - 1] == 32)
    start[end[bound]] = False
    # Contractions: an apostrophe that starts a match, then s, t, m, d, re, ve or ll.
    before = np.append(False, bound[:-1])
    mark = np.flatnonzero((kind == OTHER) & (end - run == 1) & (cps[run] == 39) & ~before & follows)
    if len(mark):
        mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        at, stop = end[mark], end[mark + 1]
        a, b = cps[at], np.where(at + 1 < stop, cps[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        take = np.where(one, 1, np.where(two, 2, 0))
        hit = take > 0
        start[at[hit]] = False
        rest = (at + take)[hit & (at + take < stop)]
        start[rest] = True
    return np.flatnonzero(start)


class PerfectHash:
    """Minimal perfect hash over 64-bit keys: levels of bits without collisions (Limasset et al., 2017)."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, seed, base = keys, 1, 0
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = (mix(left, seed) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((alone, rank, size))
            base += int(alone.sum())
            left, seed = left[~alone[at]], seed + 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, from 0; of a key that wasn't there, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for seed, (alone, rank, size) in enumerate(self.levels, 1):
            at = (mix(keys[todo], seed) % U64(size)).astype(np.int64)
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def heap_merge(token: list[int], heap: list[int], get) -> list[int]:
    """Merge the bytes of one pre-token: the pair of lowest rank first, ties from the left.

    token: ids of the single bytes; heap: rank << 32 | position of the pairs that have a rank, in heap order;
    get: the rank of a pair of ids, or None.
    """
    n = len(token)
    prev, following = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        entry = heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        if (t := token[i]) < 0 or (j := following[i]) >= n or get(t << 24 | token[j]) != rank:
            continue  # one of the two has been merged since
        token[i], token[j] = rank, -1
        following[i] = k = following[j]
        if k < n:
            prev[k] = i
            if (r := get(rank << 24 | token[k])) is not None:
                heappush(heap, r << 32 | i)
        if (p := prev[i]) >= 0 and (r := get(token[p] << 24 | rank)) is not None:
            heappush(heap, r << 32 | p)
    return [t for t in token if t >= 0]


def _gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the slices offsets[i] : offsets[i] + lengths[i], one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(offsets - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Coder:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words = list(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.first = np.full(1 << 16, -1, np.int64)  # ranks of the pairs of single bytes
        for w, r in ranks.items():
            if len(w) == 2:
                self.first[w[0] << 8 | w[1]] = r
        # Every way in which two entries make up a third one.
        self.pairs = {a << 24 | b: r for w, r in ranks.items() for i in range(1, len(w)) if (a := ranks.get(w[:i])) is not None and (b := ranks.get(w[i:])) is not None}
        self.size = np.array([len(w) for w in words])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.key = slice_hash(prefix_hash(self.data), self.start, self.start + self.size) + self.size.astype(U64)
        self.find = PerfectHash(self.key)
        self.slot = np.empty(len(words), np.int64)
        self.slot[self.find(self.key)] = np.arange(len(words))
        self.id = np.array(list(ranks.values()), np.uint32)
        by_id = np.zeros(int(self.id.max()) + 1, np.int64)
        by_id[self.id] = np.arange(len(words))
        self.by_id = by_id
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def _whole(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
        """First tier: the vocabulary entry that equals each pre-token, or -1; equality is of the bytes."""
        number = self.find(key)
        entry = np.where(number >= 0, self.slot[np.maximum(number, 0)], -1)
        ok = (entry >= 0) & (self.key[entry] == key) & (self.size[entry] == size)
        hit = np.flatnonzero(ok)
        same = data[_gather(start[hit], size[hit])] == self.data[_gather(self.start[entry[hit]], size[hit])]
        if len(hit):
            ok[hit] = np.logical_and.reduceat(same, np.cumsum(size[hit]) - size[hit])
        return np.where(ok, entry, -1)

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Second tier: the ids of each pre-token. The pairs that each heap starts with are looked up together."""
        flat = data[_gather(start, size)]
        end = np.cumsum(size)
        rank = np.full(len(flat), -1, np.int64)
        if len(flat):
            rank[:-1] = self.first[flat[:-1].astype(np.int64) << 8 | flat[1:]]
            rank[end - 1] = -1
        at = np.flatnonzero(rank >= 0)
        piece = np.repeat(np.arange(len(size)), size)[at]
        entry = rank[at] << 32 | (at - (end - size)[piece])
        heaps = entry[np.lexsort((entry, piece))].tolist()  # in order, so a heap for each pre-token
        token = self.single[flat].tolist()
        bound = np.cumsum(np.bincount(piece, minlength=len(size))).tolist()
        get, x, y = self.pairs.get, 0, 0
        for end_token, end_heap in zip(end.tolist(), bound, strict=True):
            yield tuple(heap_merge(token[x:end_token], heaps[y:end_heap], get))
            x, y = end_token, end_heap

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end."""
        whole = "".join(texts)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        raw = whole.encode()
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not len(cps):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        start = token_starts(cps, (ends - sizes)[sizes > 0])
        text_at = np.searchsorted(start, ends)  # tokens before each text's end
        if len(data) > len(cps):
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            start = (np.cumsum(width) - width)[start]
        size = np.diff(np.append(start, len(data)))
        key = slice_hash(prefix_hash(data), start, start + size) + size.astype(U64)
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        at, n, key = start[first], size[first], key[first]
        entry = self._whole(data, at, n, key)
        missed = np.flatnonzero(entry < 0)
        count = np.ones(len(first), np.int64)
        merged, kept = [], self.kept
        found = [kept.get(raw[a:b]) for a, b in zip(at[missed].tolist(), (at + n)[missed].tolist(), strict=True)]
        fresh = missed[np.array([x is None for x in found], bool)]
        done = self._merge(data, at[fresh], n[fresh])
        for i, a, size, ids in zip(missed.tolist(), at[missed].tolist(), n[missed].tolist(), found, strict=True):
            if ids is None:
                ids = next(done)
                if size <= 32:
                    if len(kept) >= KEEP:
                        kept.clear()
                    kept[raw[a : a + size]] = ids
            count[i] = len(ids)
            merged.append(ids)
        offset = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        hit = np.flatnonzero(entry >= 0)
        flat[offset[hit]] = self.id[entry[hit]]
        if merged:
            flat[_gather(offset[missed], count[missed])] = np.fromiter((x for ids in merged for x in ids), np.uint32)
        per = count[code]
        ids = flat[_gather(offset[code], per)]
        return ids, np.append(0, np.cumsum(per))[text_at]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        entry = self.by_id[ids]
        return self.data[_gather(self.start[entry], self.size[entry])]


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(text: str, most: int) -> Iterator[str]:
    """A long text in parts, cut only before white space that follows something else: no match crosses that."""
    at = 0
    while len(text) - at > most:
        end = at + most
        cls = char_classes()[np.frombuffer(text[at:end].encode("utf-32-le"), np.uint32)]
        cut = np.flatnonzero((cls[1:] == SPACE) & (cls[:-1] != SPACE)) + 1
        if not len(cut):
            most *= 2
            continue
        yield text[at : at + int(cut[-1])]
        at += int(cut[-1])
    yield text[at:]


def encoded(texts: list[str], path: str, step: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(text's number, ids) in order; a long text's ids come in several parts."""
    code = coder(path)
    for a, b in in_slices([len(t) for t in texts], step):
        if b - a == 1 and len(texts[a]) > step:
            for part in pieces(texts[a], step):
                yield a, code.encode([part])[0]
        else:
            ids, ends = code.encode(texts[a:b])
            for i, (x, y) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True), a):
                yield i, ids[x:y]


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids (array of int); null text gives an empty array."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        got: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for i, ids in encoded(texts.fillna("").tolist(), path):
            got[i].append(ids.astype(np.int32))
        return pd.Series([np.concatenate(x) if x else np.empty(0, np.int32) for x in got])

    return docs.withColumn(out, ids_of(F.col(text)))


def decode_column(docs: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """docs with the bytes that the ids stand for; null ids give empty bytes."""

    @F.pandas_udf("binary")
    def bytes_of(column: pd.Series) -> pd.Series:
        code = coder(path)
        return column.map(lambda x: b"" if x is None else code.decode(np.asarray(x, np.int64)).tobytes())

    return docs.withColumn(out, bytes_of(F.col(ids)))


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, then decodes the ids.

    One row for each row of docs, repeated ids included; null text is empty; other columns are left out.
    """

    def run(batches):
        code = coder(path)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            count = np.zeros(len(texts), np.int64)
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            for i, ids in encoded(texts, path):
                count[i] += len(ids)
                sums[i][0].update(ids.astype("<u4").tobytes())
                sums[i][1].update(code.decode(ids).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": count, "ids_sha256": [a.hexdigest() for a, _ in sums], "decoded_sha256": [b.hexdigest() for _, b in sums]})

    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept_id(source.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text (null: 0)."""

    @F.pandas_udf("long")
    def count_of(texts: pd.Series) -> pd.Series:
        count = np.zeros(len(texts), np.int64)
        for i, ids in encoded(texts.fillna("").tolist(), path):
            count[i] += len(ids)
        return pd.Series(count)

    return docs.withColumn(out, count_of(F.col(text)))
