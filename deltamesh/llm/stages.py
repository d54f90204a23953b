"""The corpus pipeline's stages: each takes (spark, docs, sf_dir) and decides over all of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltamesh.llm.common import table
from deltamesh.llm.mixing import emit_mixed
from deltamesh.llm.ngram_join import one_per_group
from deltamesh.llm.packing import pack_documents
from deltamesh.llm.quality import keep_rows
from deltamesh.llm.toxicity import THRESHOLD, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay."""
    return keep_clean(docs, table(spark, sf_dir, "labels"), THRESHOLD)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy passes stay."""
    return keep_rows(docs, "standard-1")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest id; documents without words are no group.

    A null id is never the smallest, but a group of null ids alone keeps one row. Rows that share
    an id are decided each by its own text.
    """
    return one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return emit_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("packing", packing)]
