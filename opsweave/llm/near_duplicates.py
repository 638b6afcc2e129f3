"""Near-duplicates: MinHash bands propose pairs, sequential Bayesian tests prune them, full sets decide.

1. Each text becomes a set of word shingles, a fingerprint of that set and a MinHash signature. Documents
   with equal sets form one class; only the smallest doc_id of a class goes on.
2. Classes that share a band of the signature meet in a bucket. First a bucket pairs its members with one leader, the one
   that meets most others in all its buckets (the original of a group of copies, if it is there). Of its leaders, a member
   is compared with the most similar and the most met one.
3. Pairs are compared one batch of signature values after another. A pair goes as soon as the posterior probability that
   its similarity reaches the threshold is below miss (BayesLSH; uniform prior). Survivors are confirmed on the full sets.
4. Buckets whose members still lie in several components are compared wholly. Open buckets that hang together are one
   group if that makes fewer pairs than one bucket after another. Groups are dealt out in blocks, and two blocks at a time meet,
   first to test signatures, then, for members with a surviving partner, to confirm on full sets. Pairs of one component
   are skipped, and only links that join two components are returned: fewer than there are members. No bucket is capped, and no
   task holds more than two blocks.

Texts: A-Z are lower-cased, words are runs of [^\\x20\\x09-\\x0D]. Null and empty texts have the empty set and are
linked with nothing. Rows that repeat a doc_id are one document: what any of them is linked with, that document is.
A row without a doc_id has its set counted, is linked with nothing (component_id null) and is kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, kept_id, materialise, mix, packed, scratch, spread, unpacked, word_hashes
from .components import connected_components

#: Signature values compared at a time by the Bayesian test.
BATCH = 16
#: Values of which the first test compares one bit each.
BITS = 128
#: Members of a block, and shingles in it: what is over goes to more blocks.
BLOCK, SHINGLES = 1024, 1 << 20
#: Columns of a table of members and shingles that are multiplied at a time.
COLUMNS = 1024

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of size words; fewer words count as one shingle."""
    words = word_hashes(text.encode().translate(_LOWER))
    n = len(words) - size + 1
    if not len(words):
        return words
    if n < 1:
        n, size = 1, len(words)
    h = np.full(n, size, U64)
    for i in range(size):
        h = mix(h * U64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(h)


@functools.cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.arange(2 * count, dtype=U64), 77)
    return (h[:count] >> U64(32)).astype(np.uint32) | np.uint32(1), (h[count:] >> U64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, count: int, step: int = 4096) -> np.ndarray:
    """count MinHash values of a set of 64-bit hashes."""
    a, b = _functions(count)
    h = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), step):
        values = h[None, at : at + step] * a[:, None]
        values += b[:, None]
        values ^= values >> np.uint32(15)
        np.minimum(out, values.min(axis=1), out=out)
    return out


@functools.cache
def least_matches(threshold: float, count: int, miss: float, batch: int = BATCH, values: int = 256) -> np.ndarray:
    """For each number n of compared values, the fewest matches at which P(similarity >= threshold) >= miss.

    Signature values are compared by a hash of them to `values` values, so different ones agree once in so many.
    """
    s = (np.arange(4000) + 0.5) / 4000
    agree = s + (1 - s) / values
    out = np.zeros(count + 1, np.int64)
    for n in range(batch, count + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(logs - logs.max())
            if weight[s >= threshold].sum() >= miss * weight.sum():
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of byte signatures the sequential test keeps: of rows of a and b, or of rows x of a with rows y of b."""
    count = a.shape[1]
    x, y = (np.arange(len(a)) if i is None else i for i in (x, y))
    least = least_matches(threshold, count, miss)
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n in range(BATCH, count + 1, BATCH):
        part = slice(n - BATCH, n)
        matches = matches + (a[:, part][x[alive]] == b[:, part][y[alive]]).sum(axis=1)
        go = matches >= least[n]
        alive, matches = alive[go], matches[go]
    return alive


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sketches(source: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (low bytes of the signature), b1, b2 (a bit of each value), keys (of the bands)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, t in zip(batch["doc"].tolist(), batch["text"].tolist(), strict=True):
                s = shingle_set(t or "", size)
                if not len(s):
                    out.append((doc, 0, 0, 0, b"", 0, 0, []))
                    continue
                sig = signature(s, bands * rows)
                h = np.arange(bands, dtype=U64)
                for column in sig.reshape(bands, rows).T:
                    h = mix(h * U64(0x9E3779B97F4A7C15) + column)
                f1, f2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                b1, b2 = np.packbits((sig[:BITS] >> np.uint32(8)).astype(np.uint8) & 1).view(np.int64).tolist()
                out.append((doc, len(s), f1, f2, sig.astype(np.uint8).tobytes(), b1, b2, h.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "f1", "f2", "sig", "b1", "b2", "keys"])

    texts = source.select(F.col("doc_id").cast("string").alias("doc"), "text")
    return kept_id(texts.mapInPandas(run, "doc_id string, n_shingles long, f1 long, f2 long, sig binary, b1 long, b2 long, keys array<long>"))


def _able(percent: int, miss: float) -> Column:
    """Whether two members (id, n_shingles, b1, b2, component; o_ for the other) can be similar: sizes, and the first batch of the test."""
    differ = BITS - int(least_matches(percent / 100, BITS, miss, BITS, 2)[BITS])
    sizes = 100 * F.least("n_shingles", "o_n_shingles") >= percent * F.greatest("n_shingles", "o_n_shingles")
    bits = F.bit_count(F.col("b1").bitwiseXOR(F.col("o_b1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("o_b2")))
    return (F.col("component") != F.col("o_component")) & sizes & (bits <= differ)


def _star(members: DataFrame, able: Column) -> DataFrame:
    """Distinct pairs (a leader, b member) of each bucket's leader, the member that meets most others, with the members that can be similar."""
    mine = ("id", "component", "n_shingles", "b1", "b2")
    heads = members.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("id").alias("o"), *mine)).alias("h"))
    heads = heads.select("key", *[F.col(f"h.{c}").alias(f"o_{c}") for c in mine])
    return members.join(heads, "key").where(able).select(F.col("o_id").alias("a"), F.col("id").alias("b")).distinct()


def _groups(df: DataFrame, key: list[str], order: list[str], each, schema: str) -> DataFrame:
    """each(frame) for the rows of each key, sorted; a task holds one group and one batch at a time."""

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            k = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield from each(batch.iloc[x:y])
            held = batch.iloc[cuts[-1] :]
        if held is not None:
            yield from each(held)

    return spread(df, *key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def _as_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, U64)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _pruned(pairs: DataFrame, signatures: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of the pairs that the sequential test keeps, those of each member with its most similar leader and with its heaviest."""
    a = signatures.select(F.col("id").alias("a"), F.col("sig").alias("sa"), "weight")
    b = signatures.select(F.col("id").alias("b"), F.col("sig").alias("sb"))

    def run(batches):
        for p in batches:
            if len(p):
                sa, sb = _signatures(p["sa"]), _signatures(p["sb"])
                keep = surviving(sa, sb, percent / 100, miss)
                yield p.iloc[keep][["a", "b", "weight"]].assign(matches=(sa[keep] == sb[keep]).sum(axis=1))

    kept = pairs.join(a, "a").join(b, "b").select("a", "b", "weight", "sa", "sb").mapInPandas(run, "a long, b long, weight long, matches long")
    best = kept.groupBy("b").agg(F.max(F.struct("matches", "weight", "a")).alias("x"), F.max(F.struct("weight", "matches", "a")).alias("y"))
    return best.select(F.explode(F.array_distinct(F.array("x.a", "y.a"))).alias("a"), "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. A leader's set goes once to each part of its members, and members pass one after another."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    pairs = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    members = pairs.select("a", "part", F.lit(1).alias("second"), F.col("b").alias("id"))
    leaders = pairs.select("a", "part", F.lit(0).alias("second"), F.col("a").alias("id")).distinct()
    rows = members.unionByName(leaders).join(sets, "id").select("a", "part", "second", F.col("id").alias("b"), "shingles")

    def run(batches):
        at, lead = None, []
        for p in batches:
            keep = []
            for k, second, s in zip(zip(p["a"].tolist(), p["part"].tolist(), strict=True), p["second"].tolist(), p["shingles"].tolist(), strict=True):
                if k != at:
                    at, lead = k, []
                if not second:
                    lead.append(_as_set(s))
                keep.append(bool(second) and any(similar(x, _as_set(s), percent) for x in lead))
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    return spread(rows, "a", "part").sortWithinPartitions("a", "part", "second").mapInPandas(run, "a long, b long")


def _open(meeting: DataFrame, components: DataFrame) -> DataFrame:
    """key, id, component of the members of buckets whose members lie in more than one component."""
    m = meeting.select("key", "id").join(components, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    still = m.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return m.join(still, "key")


def _groups_of(members: DataFrame) -> DataFrame:
    """key, id, component: the members of open buckets, by bucket or by all buckets that hang together, whichever makes fewer pairs."""
    first = members.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    edges = members.join(first, "key").select("a", F.col("id").alias("b"))
    whole = connected_components(edges).withColumnRenamed("component", "whole")
    m = materialise(members.join(whole, "id"), "grouped")
    of_buckets = m.groupBy("whole", "key").agg(F.count("*").alias("n")).groupBy("whole").agg(F.sum(F.col("n") * F.col("n")).alias("bucketwise"))
    of_wholes = m.select("whole", "id").distinct().groupBy("whole").agg(F.count("*").alias("n"))
    fewer = materialise(of_buckets.join(of_wholes, "whole").select("whole", (F.col("n") * F.col("n") <= F.col("bucketwise")).alias("together")), "fewer")
    key = F.when(F.col("together"), F.xxhash64("whole", F.lit("whole"))).otherwise(F.xxhash64("key", F.lit("bucket")))
    return m.join(fewer, "whole").select(key.alias("key"), "id", "component").distinct()


def _in_blocks(members: DataFrame) -> DataFrame:
    """members (key, id, n_shingles, ...) with block and the two blocks (i <= j) of each group that they go to."""
    need = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / SHINGLES))
    blocks = members.groupBy("key").agg(need.alias("blocks"))
    m = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return m.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")


def _candidates(group: pd.DataFrame, percent: int, miss: float, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a group that the sequential test keeps: in different components, of its two blocks. A few rows at a time are held against all."""
    n, component, block = (group[c].to_numpy(np.int64) for c in ("n_shingles", "component", "block"))
    sig, across = _signatures(group["sig"]), group["i"].iat[0] != group["j"].iat[0]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(n), rows):
        some = slice(at, at + rows)
        able = 100 * np.minimum(n[some, None], n) >= percent * np.maximum(n[some, None], n)
        able &= component[some, None] != component
        if across:
            able &= block[some, None] != block
        x, y = np.nonzero(np.triu(able, at + 1))
        keep = surviving(sig, sig, percent / 100, miss, x + at, y)
        found.append((x[keep] + at, y[keep]))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return x, y


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of tables of members and shingles."""
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(place, minlength=len(every)) > 1  # a shingle of one member is in no intersection
    column = np.cumsum(often) - 1
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = often[place]
    member, column = member[use], column[place[use]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int32)
    for at in range(0, int(often.sum()), COLUMNS):
        x, y = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[member[x:y], column[x:y] - at] = 1
        np.add(out, held @ held.T, out=out, casting="unsafe")
    return out


def joining_links(group: pd.DataFrame, percent: int, miss: float) -> list[tuple[int, int]]:
    """Pairs of components that a link of the group joins; each joins two that no earlier one has joined."""
    x, y = _candidates(group, percent, miss)
    if not len(x):
        return []
    used = np.unique(np.concatenate([x, y]))
    sets = [_as_set(s) for s in group["shingles"].iloc[used]]
    p, q = np.searchsorted(used, x), np.searchsorted(used, y)
    n = np.array([len(s) for s in sets])
    if len(p) > 8 * len(used):
        both = shared_counts(sets)[p, q].astype(np.int64)
        ok = 100 * both >= percent * (n[p] + n[q] - both)
    else:
        ok = np.array([similar(sets[a], sets[b], percent) for a, b in zip(p.tolist(), q.tolist(), strict=True)])
    component = group["component"].to_numpy(np.int64)[used].tolist()
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    out = []
    for a, b in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
        ca, cb = find(component[a]), find(component[b])
        if ca != cb:
            root[max(ca, cb)] = min(ca, cb)
            out.append((ca, cb))
    return out


def _block_links(members: DataFrame, about: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """a, b: components that a link between members (key, id, component) of one group joins. about: id, n_shingles, sig."""
    known = _in_blocks(members.join(about, "id"))

    def partners(group: pd.DataFrame):
        x, y = _candidates(group, percent, miss)
        yield group.iloc[np.unique(np.concatenate([x, y]))][["key", "id", "component"]]

    columns = ["key", "i", "j", "id", "component", "n_shingles", "block", "sig"]
    left = _groups(known.select(*columns), ["key", "i", "j"], [], partners, "key long, id long, component long").distinct()
    left = materialise(left, "partners")
    # Of buckets with the same members, one.
    buckets = left.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("y"))
    left = left.join(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")

    def joined(group: pd.DataFrame):
        yield pd.DataFrame(joining_links(group, percent, miss), columns=["a", "b"], dtype=np.int64)

    dealt = _in_blocks(left.join(about, "id")).join(sets, "id")
    return _groups(dealt.select(*columns, "shingles"), ["key", "i", "j"], [], joined, "a long, b long").distinct()


def _classes(sketch: DataFrame) -> DataFrame:
    """f1, f2, n_shingles, rep: the classes of documents with equal sets, by their smallest doc_id."""
    return sketch.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))


def links(source: DataFrame, sketch: DataFrame, classes: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """id, component for the classes that are linked with others."""
    reps = sketch.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    reps = materialise(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sig", "b1", "b2", "keys"), "reps")
    every = reps.select(F.explode("keys").alias("key"), "id")
    met = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meeting = materialise(every.join(met, "key"), "meeting")
    weight = meeting.groupBy("id").agg(F.sum("n").alias("weight"))

    # What can be in a pair at all: signatures and sets of these are fetched once.
    about = materialise(reps.join(weight, "id").select("id", "n_shingles", "sig", "b1", "b2", "weight"), "about")
    near = source.where("doc_id is not null").select("doc_id", packed(F.col("text")).alias("packed"))
    near = near.join(about.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "packed"])

    def as_sets(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "shingles": [shingle_set(unpacked(t).decode(), size).tobytes() for t in batch["packed"].tolist()]})

    sets = materialise(near.mapInPandas(as_sets, "id long, shingles binary"), "sets")
    members = meeting.select("key", "id").join(about.drop("sig"), "id").withColumn("component", F.col("id"))
    about = about.select("id", "n_shingles", "sig", "weight")

    pairs = materialise(_pruned(_star(members, _able(percent, miss)), about, percent, miss), "pairs")
    components = connected_components(materialise(_confirmed(pairs, sets, percent), "links"))
    open_ = materialise(_open(meeting, components), "open")
    if open_.isEmpty():
        return components
    more = connected_components(materialise(_block_links(materialise(_groups_of(open_), "groups"), about.drop("weight"), sets, percent, miss), "joining"))
    return _relabelled(components, more)


def _relabelled(components: DataFrame, more: DataFrame) -> DataFrame:
    """components (id, component) after components were joined as more (id, component of a component) says."""
    above = more.select(F.col("id").alias("component"), F.col("component").alias("joined"))
    below = components.join(above, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
    return below.unionByName(more.join(components, "id", "left_anti").select("id", "component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 44, rows: int = 6, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    size: words in a shingle; percent: least similarity of a link; bands * rows: signature length. The chance
    that bands miss a pair at the threshold is (1 - t**rows)**bands: 2e-6 at 80 percent by default. bands * rows is BITS at least.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        sketch = materialise(sketches(source, size, bands, rows), "sketches")
        classes = materialise(_classes(sketch), "classes")
        found = links(source, sketch, classes, size, percent, miss)
        own = sketch.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left").drop("f1", "f2")
        own = own.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component"))
        own = keep(materialise(own, "own"))
    own = own.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))
    # Rows of one document that came into several components join them.
    several = own.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
    if not several.isEmpty():
        edges = own.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("component").alias("b"))
        more = connected_components(edges).select(F.col("id").alias("component"), F.col("component").alias("joined"))
        own = own.join(more, "component", "left").select("doc_id", "n_shingles", F.coalesce("joined", "component").alias("component"))
    return own.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
