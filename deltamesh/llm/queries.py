"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltamesh.llm.chat import CHAT_SQL, format_conversations
from deltamesh.llm.common import table
from deltamesh.llm.ctw import score_texts
from deltamesh.llm.mixing import MIXING_SQL, mix_sources
from deltamesh.llm.ngram_join import near_duplicates
from deltamesh.llm.packing import pack_documents
from deltamesh.llm.quality import QUALITY_SQL, judge_quality
from deltamesh.llm.tokens import token_counts
from deltamesh.llm.toxicity import score_toxicity
from deltamesh.llm.topk import TOPK_SQL, top_k
from deltamesh.llm.warc import WARC_SQL, archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_exact_top_k, op2_warc, op3_ngram_jaccard, op4_toxicity, op5_mixing, op6_quality_rules, op7_lm_scoring, op8_packing, op9_chat_formatting, op10_token_counts, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": TOPK_SQL, "op2_warc": WARC_SQL, "op9_chat_formatting": CHAT_SQL, "op5_mixing": MIXING_SQL, "op6_quality_rules": QUALITY_SQL}
