"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversations, cuckoo_index, lexical_search, warc
from .audio import audio_digests
from .bpe import encode_digests
from .conversations import damage_report
from .cuckoo_index import exact_dedup
from .html_text import page_texts
from .lexical_search import ranked_search
from .mixing import mixed
from .near_duplicates import near_duplicates
from .neighbours import nearest
from .suffix_dedup import removal_digests
from .token_counts import context_limits, length_histogram
from .toxicity import toxicity_scores

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op10_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_report(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands beside the package and imports from it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_audio": op6_audio,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_html_text": op9_html_text,
    "op10_token_lengths": op10_token_lengths,
    "op11_cuckoo_dedup": op11_cuckoo_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op11_cuckoo_dedup": cuckoo_index.ORACLE,
    "op12_conversation_repair": conversations.ORACLE,
    "op13_ranked_search": lexical_search.ORACLE,
}
