"""What the operators share: cut lineage, vectorised hashes of byte slices, batching of texts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="opsweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/opsweave-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialised inside are deleted at the end, but for those given to keep(), which the result still reads.

    with scratch(spark) as keep: ...; return keep(materialise(result, "name"))
    """
    kept: list[str] = []

    def keep(*tables: DataFrame):
        kept.extend(t._written for t in tables)
        return tables[0] if len(tables) == 1 else tables

    _scopes.append([])
    try:
        yield keep
    finally:
        written = _scopes.pop()
        for path in set(written) - set(kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if _scopes:
            _scopes[-1].extend(kept)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own: those given, with more underscores before them where df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal rows out by key over as many partitions as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def packed(text: Column) -> Column:
    """Texts as compressed UTF-8, as they travel between executors; null ones are empty."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: c.compress((t or "").encode()))

    return pack(text.cast("string"))


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def kept_id(out: DataFrame, column: str = "doc_id") -> DataFrame:
    """out with an id that went through Python as text (null ids would make it a float there) as a number again."""
    return out.withColumn(column, out[column].cast("long"))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), on unsigned 64-bit arrays."""
    h = h + U64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of a byte array; slice_hash() takes any slice's hash from them."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_BYTE_VALUES[data] * powers(BASE, len(data))[:-1], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of data[start:end]."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix) - 1)[start]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def slice_digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, long: int = 256) -> np.ndarray:
    """A 64-bit hash for each non-empty slice, eight bytes mixed after eight; slices over long bytes by xxh3."""
    size = stop - start
    eights = np.ndarray((len(data),), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    h = mix(size.astype(U64), 41)
    short = np.flatnonzero(size <= long)
    for at in range(0, int(size[short].max(initial=0)), 8):
        short = short[size[short] > at]
        rest = np.minimum(size[short] - at, 8).astype(U64)
        h[short] = mix(h[short] ^ (eights[start[short] + at] << (U64(64) - U64(8) * rest)))
    for i in np.flatnonzero(size > long).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]].tobytes())
    return h


def word_hashes(text: bytes, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each word, in order; long texts go in slices that end between words."""
    out, at = [], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data):
            space = np.flatnonzero((data[at:end] == 32) | ((data[at:end] >= 9) & (data[at:end] <= 13)))
            if len(space):
                end = at + int(space[-1]) + 1
                break
            end = min(end + step, len(data))
        part = data[at:end]
        start, stop = word_spans(part)
        if len(start):
            out.append(slice_digests(part, start, stop))
        at = end
    return np.concatenate(out) if out else np.empty(0, U64)


def in_slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with a total size of about most, a larger item alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
