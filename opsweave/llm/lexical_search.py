"""Ranked lexical search in FP-trees of documents.

Each document is restricted to the terms that the items ask for, its terms in the order of their document frequency: documents with the
same frequent terms share the first nodes of a trie. A node stands for the documents below it; it has the greatest tf of each term and the
least m among them, and no document below can score more than those together would. Each item searches a tree depth first, best node
first, and leaves a subtree whose bound is below the item's last place so far. Scores are whole numbers, so bounds and ties are exact.

Trees are built of the rows as they lie, some thousand at a time; a task keeps each item's best over all of its trees. Items are taken
in blocks of bounded size: what is broadcast and what a tree's tables hold depends on the block alone.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Terms and items of a block; (documents x terms) of a tree's table; documents of a leaf; rows of a first ranking.
TERMS, ITEMS, CELLS, LEAF, SALTS = 1 << 13, 2048, 1 << 23, 64, 64
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

#: Letters A-Z in lower case; of the other characters below 128, all but digits and letters part terms.
_AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists."""
    data = (text or "").encode().translate(_AS_TERMS)
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            space = data.rfind(b" ", at, end)
            space = space if space >= 0 else data.find(b" ", end)
            end = len(data) if space < 0 else space + 1
        yield data[at:end].split()
        at = end


def term_counts(text: str | None) -> tuple[int, Counter]:
    counts: Counter = Counter()
    for part in terms(text):
        counts.update(part)
    return counts.total(), counts


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n, ids, tfs: documents with terms, and how often they have those of the vocabulary. One pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids: list[int | None] = []
            ns, held, tfs = [], [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, counts = term_counts(value.as_py())
                if n:
                    own = counts.keys() & known.keys()
                    ids.append(i)
                    ns.append(n)
                    held.append([known[t] for t in own])
                    tfs.append([counts[t] for t in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gains(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms add to a score; grows with tf and falls with m, rounding included."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Tree:
    """The FP-tree of some documents. Nodes are ranges of documents in order of their paths; a leaf has up to LEAF documents."""

    def __init__(self, ids: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, ranks: np.ndarray):
        paths = []
        for t in ids:
            paths.append(np.sort(ranks[t]).astype(">u4").tobytes())
        self.order = sorted(range(len(paths)), key=paths.__getitem__)
        ordered = [paths[i] for i in self.order]
        self.m = m[self.order]
        self.tf = np.zeros((len(ordered), len(ranks)), np.int64 if any(len(t) and t.max() >= 1 << 31 for t in tfs) else np.int32)
        for row, i in enumerate(self.order):
            self.tf[row, ids[i]] = tfs[i]
        shared = [0] + [_shared(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]
        self.low, self.high, self.kids, self.most, self.least = [], [], [], [], []
        self._grow(shared)

    def _grow(self, shared: list[int]) -> None:
        """Nodes in the order of a walk from the root: a node is parted where its documents leave their common path, small neighbours stay together."""
        stack = [(0, len(shared), -1)]
        while stack:
            low, high, above = stack.pop()
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([])
            if above >= 0:
                self.kids[above].append(node)
            if high - low <= LEAF:
                self.most.append(self.tf[low:high].max(axis=0))
                self.least.append(self.m[low:high].min())
                continue
            self.most.append(None)
            self.least.append(None)
            common = min(shared[low + 1 : high])
            cuts = [i for i in range(low + 1, high) if shared[i] == common] + [high]
            at, begin, parts = low, low, []
            for cut in cuts:
                if cut - begin > LEAF and at > begin:
                    parts.append((begin, at))
                    begin = at
                at = cut
            parts.append((begin, high))
            if len(parts) == 1:
                # A path of its own, or copies: halves.
                middle = (low + high) // 2
                parts = [(low, middle), (middle, high)]
            stack += [(a, b, node) for a, b in reversed(parts)]
        for node in reversed(range(len(self.low))):
            if self.most[node] is None:
                self.most[node] = reduce(np.maximum, [self.most[k] for k in self.kids[node]])
                self.least[node] = min(self.least[k] for k in self.kids[node])
        self.kids = [np.array(k) for k in self.kids]
        self.most, self.least = np.array(self.most), np.array(self.least)

    def search(self, asked: np.ndarray, weights: np.ndarray, best: list, top: int, doc_ids: list) -> None:
        """Put the documents of the tree into best, a heap of (score, -doc_id); documents without an id come last among equals."""
        stack = [(_bound(self.most[:1, asked], self.least[:1], weights)[0], 0)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or len(best) == top and bound < best[0][0]:
                continue
            if len(self.kids[node]):
                kids = self.kids[node]
                bounds = _bound(self.most[np.ix_(kids, asked)], self.least[kids], weights)
                stack += sorted(zip(bounds.tolist(), kids.tolist(), strict=True))
                continue
            low, high = self.low[node], self.high[node]
            scores = _bound(self.tf[low:high, asked], self.m[low:high], weights)
            least = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(scores >= max(least, 1)).tolist():
                doc_id = doc_ids[self.order[low + i]]
                entry = (int(scores[i]), -math.inf if doc_id is None else -doc_id)
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _bound(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return gains(weights, tf.astype(np.int64), m[:, None]).sum(axis=1)


def _shared(a: bytes, b: bytes) -> int:
    """Terms that two paths share from the root."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common beginning, by halves
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low // 4


def _found(rows: DataFrame, asked: list[np.ndarray], weights: np.ndarray, ranks: np.ndarray, top: int) -> DataFrame:
    """item (its place in asked), doc_id, score: the best of each task."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, weights, ranks))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, ranks = shared.value
        most = max(LEAF, CELLS // max(1, len(ranks)))
        best: list[list] = [[] for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                split = lambda c: [np.asarray(v.values) for v in part.column(c)]  # noqa: E731, B023
                tree = Tree(split("ids"), split("tfs"), np.asarray(part.column("m")), ranks)
                doc_ids = part.column("doc_id").to_pylist()
                for heap, terms in zip(best, asked, strict=True):
                    if len(terms):
                        tree.search(terms, weights[terms], heap, top, doc_ids)
        out = [(i, None if d == -math.inf else -d, s) for i, heap in enumerate(best) for s, d in heap]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield from pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"]).to_batches()

    return rows.select("doc_id", "ids", "tfs", "m").mapInArrow(search, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items with their terms, in blocks; rows that repeat an item_id are one item with the terms of all. Items are questions: one block at a time is held."""
    block: list[tuple[int | None, set[bytes]]] = []
    size = 0
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).groupBy("i").agg(F.concat_ws(" ", F.collect_list("t")).alias("t")).sort("i")
    for i, t in rows.toLocalIterator():
        own = set().union(*terms(t))
        if block and (len(block) >= ITEMS or size + len(own) > TERMS):
            yield block
            block, size = [], 0
        block.append((i, own))
        size += len(own)
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item with a score above 0, equal scores by doc_id.

    Null texts have no terms; documents without any count nowhere. Documents without an id come last among equals; rows that repeat an
    id count each. Items without terms, or whose terms no document has, have no rows; nor has any if a table is empty.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        results = [keep(materialise(_searched(spark, docs, block, top, doc_id, doc_text), "ranks")) for block in _item_blocks(items, item_id, item_text)]
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)


def _searched(spark: SparkSession, docs: DataFrame, block: list[tuple[int | None, set[bytes]]], top: int, doc_id: str, text: str) -> DataFrame:
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(own for _, own in block))))}
    rows = materialise(vectors(docs, vocabulary, doc_id, text), "vectors")
    totals = rows.agg(F.count("*"), F.sum("n")).first()
    n_docs, length = totals[0], int(totals[1] or 0)
    frequency = np.zeros(len(vocabulary), np.int64)
    for k, df in rows.select(F.explode("ids").alias("k")).groupBy("k").agg(F.count("*")).collect():  # terms of a block, at most
        frequency[k] = df
    weights = np.array([term_weight(n_docs, int(df)) for df in frequency], np.int64)
    ranks = np.empty(len(vocabulary), np.int64)
    ranks[np.argsort(-frequency, kind="stable")] = np.arange(len(vocabulary))
    asked = [np.array(sorted(vocabulary[t] for t in own if frequency[vocabulary[t]]), np.int64) for _, own in block]
    if not length:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    m = F.expr(f"50 + cast(50 as decimal(20,0)) * n * {n_docs} div {length}").cast("long")
    found = _found(rows.where(F.size("ids") > 0).withColumn("m", m), asked, weights, ranks, top)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = F.array(*[F.lit(i).cast("long") for i, _ in block])
    return best.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")


ORACLE = r"""with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
 b as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
 s as (select count(*) as n_docs, cast(sum(len(t)) as bigint) as l from d where len(t) > 0),
 p as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) x where term in (select term from b) group by 1, 2),
 w as (select term, cast(floor(1000*ln((2*any_value(n_docs)+2)/(2*count(*)+1))) as bigint) as w from p, s group by 1),
 c as (select item_id, r, cast(sum(w*((1000000000*tf)//(1000*tf+20*(50+(50*len(t)*n_docs)//l)))) as bigint) as score from b join p using (term) join w using (term) join d using (r), s group by 1, 2),
 k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from c join d using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 50"""
