"""Graph snapshots from event streams: late-tolerant windowed edges, and the change of each against the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.plans.series import churn


def windowed_edges(events: DataFrame, source: str, target: str, kind: str, ts: str = "ts", width: str = "6 days", lateness: str = "1 day") -> DataFrame:
    """Edges (window_start, source, type, target, weight) per tumbling window; works on batches and, with a watermark, on streams."""
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(source).cast("string").alias("source"), F.col(kind).cast("string").alias("type"), F.col(target).cast("string").alias("target"))
    own = rows.withWatermark("ts", lateness) if events.isStreaming else rows
    return own.groupBy(F.window("ts", width), "source", "type", "target").agg(F.count(F.lit(1)).alias("weight")).select(F.col("window.start").alias("window_start"), "source", "type", "target", "weight")


def churn_of_windows(edges: DataFrame) -> DataFrame:
    """Step-by-step churn of a table of windowed edges; windows are numbered in order of time."""
    starts = edges.select("window_start").distinct().orderBy("window_start").collect()
    # one number per window: a handful of rows
    numbered = edges.sparkSession.createDataFrame([(r["window_start"], i) for i, r in enumerate(starts)], "window_start timestamp, idx int")
    return churn(edges.join(F.broadcast(numbered), "window_start").drop("window_start"))


def stream_to_table(events: DataFrame, path: str, checkpoint: str, **columns):
    """Run windowed_edges over a stream and append closed windows to a Parquet table; returns the query."""
    return windowed_edges(events, **columns).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
