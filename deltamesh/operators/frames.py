"""Cutting lineage in loops: reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="deltamesh-"))


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the checkpoint folder: its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
