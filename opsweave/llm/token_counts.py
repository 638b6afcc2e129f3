"""Exact histogram of encoded lengths, and what suffix sums of it answer for every context limit.

Each document is encoded once; the rest is arithmetic on (length, documents). A null text has length 0, so
it counts as an empty document. Between two lengths that occur, truncated totals are linear in the limit:
the table holds every limit at which an answer changes its slope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_counts
from .common import materialise

#: Lengths in one block of the two-level suffix sums.
BLOCK = 256


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. An empty table gives no rows."""
    counted = token_counts(docs.select(F.col(text).cast("string").alias("text")), path).select("n_tokens")
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length in the histogram, taken as a context limit:

    n_docs (of that length), docs_within (not longer), docs_over, total_tokens (of all documents),
    tokens_within (of the documents not longer), truncated_total (sum of min(length, limit)) and
    quantile (share of documents not longer). Suffix sums run within blocks of lengths; only one row
    for each block is summed in one place, so the work is bounded by the longest text, not by the documents.
    """
    h = materialise(histogram, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = (
        h.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
            F.sum("d").over(every).alias("all_docs"),
            F.sum("t").over(every).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    over_tokens = F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    s = h.select("*", over.alias("o"), over_tokens.alias("ot")).join(blocks, "block")
    s = s.withColumn("docs_over", F.col("o") + F.col("docs_after")).withColumn("tokens_over", F.col("ot") + F.col("tokens_after"))
    return s.select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        "docs_over",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(limits: DataFrame, context: DataFrame) -> DataFrame:
    """context_limit, truncated_total, docs_over for each limit in context (column context_limit, any integers).

    The answer at a limit between two lengths follows from the next shorter one; limits below the
    shortest length truncate every document. Limits are few: a table of questions.
    """
    c = context.select(F.col("context_limit").cast("long").alias("context_limit")).where("context_limit >= 0").distinct()
    below = c.join(limits, F.col("n_tokens") <= F.col("context_limit"), "left").groupBy("context_limit").agg(F.max(F.struct("n_tokens", "docs_over", "truncated_total")).alias("b"))
    every = limits.agg(F.sum("n_docs").alias("all_docs"))
    over = F.coalesce("b.docs_over", "all_docs", F.lit(0))
    return below.crossJoin(F.broadcast(every)).select(
        "context_limit",
        (F.coalesce("b.truncated_total", F.lit(0)) + over * (F.col("context_limit") - F.coalesce("b.n_tokens", F.lit(0)))).alias("truncated_total"),
        over.alias("docs_over"),
    )


def length_quantile(limits: DataFrame, q: float) -> DataFrame:
    """n_tokens: the smallest length that at least the share q of the documents don't exceed (null if none)."""
    return limits.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
