"""Shared pieces of the training-data operators: scratch tables, table reading, byte helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a Python worker, so that its memory doesn't depend on the batch Spark sends.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            root = kept.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="deltamesh-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{scratch_root(spark)}/deltamesh/{label}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone before; its owner clears the shared folder
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that `cut` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        discard(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished queries are deleted when the JVM drops their plans: have it do so now."""
    spark.sparkContext._jvm.System.gc()


def bucket_crc(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(values: list, size=len):
    """Consecutive runs of a list holding about SLICE_BYTES each."""
    start, held = 0, 0
    for i, v in enumerate(values):
        held += size(v) + 64
        if held >= SLICE_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)
