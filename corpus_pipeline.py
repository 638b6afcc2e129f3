"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.llm.bpe import encode_digests
from opsweave.llm.common import materialise
from opsweave.llm.mixing import mix_documents
from opsweave.llm.near_duplicates import near_duplicates
from opsweave.llm.suffix_dedup import remove_repeats
from opsweave.llm.toxicity import without_toxic

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a similarity of 0.8: that of the smallest doc_id.

    Rows without a doc_id stay; rows that repeat a doc_id are one document and stay or go together.
    """
    kept = near_duplicates(docs, size=5).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, docs["doc_id"].cast("long") == F.col("__kept"), "left_semi")
    return named.unionByName(docs.where(docs["doc_id"].cast("long").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand anywhere else, too, leave the texts; n_chars follows.

    Passages are measured in words: of those of just over 50 words, many have fewer than the 400 bytes of op1's contract.
    """
    return remove_repeats(docs, length=50, unit="words").withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the mix of sources takes them."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return encode_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicate_groups),
    ("repeated passages", repeated_passages),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
