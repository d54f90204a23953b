"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltamesh.llm.common import cut, table
from deltamesh.llm.stages import STAGES

#: Toxicity scores come from a trained model, which SQL can't express; tests/llm/test_toxicity_and_pipeline.py holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
