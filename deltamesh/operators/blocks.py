"""Edges of numbered nodes in blocks of whole nodes, for loops whose driver holds only arrays as long as the nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.operators.frames import settled

#: Edges a block holds, plus those of its last node.
BLOCK = 500_000
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def numbered(adj: DataFrame, labels: list[str]) -> DataFrame:
    """Rows (u, v, w): both ends by their place in `labels`, weight 1."""
    ids = adj.sparkSession.createDataFrame(pd.DataFrame({"label": labels, "id": np.arange(len(labels))}), "label string, id long")
    one = adj.join(ids.select(F.col("label").alias("u"), F.col("id").alias("iu")), "u")
    return one.join(ids.select(F.col("label").alias("v"), F.col("id").alias("iv")), "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"), F.lit(1.0).alias("w"))


def in_blocks(edges: DataFrame, size: int | None = None) -> DataFrame:
    """Rows (u, v, w) packed, settled and in ascending order of u; no node's edges lie in two rows."""
    edges = settled(edges)
    size = size or BLOCK
    parts = max(1, -(-edges.count() // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]

        def passed(u, v, w) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (u, v, w)], ["u", "v", "w"])

        for batch in batches:
            for h, c in zip(held, batch.columns, strict=True):
                h.append(np.asarray(c))
            if sum(map(len, held[0])) >= size:
                whole = [np.concatenate(h) for h in held]
                last = int(np.searchsorted(whole[0], whole[0][-1]))
                if last:
                    yield passed(*(x[:last] for x in whole))
                held = [[x[last:]] for x in whole]
        if sum(map(len, held[0])):
            yield passed(*(np.concatenate(h) for h in held))

    return settled(edges.repartitionByRange(parts, "u").sortWithinPartitions("u").mapInArrow(pack, "u binary, v binary, w binary"))


def unpacked(row) -> Block:
    return np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.float64)


def reader(packed: DataFrame) -> Callable[[], Iterator[Block]]:
    """The blocks in order, one partition in the driver at a time."""
    return lambda: (unpacked(r) for r in packed.toLocalIterator(prefetchPartitions=True))


def merged(edges: DataFrame, own: np.ndarray) -> DataFrame:
    """Edges (u, v, w) between the groups of their ends, weights added up."""
    sent = edges.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (sent.value[np.asarray(batch.column(k))] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), batch.column(2)], ["u", "v", "w"])

    return settled(edges.mapInArrow(run, "u long, v long, w double").groupBy("u", "v").agg(F.sum("w").alias("w")))


def product(packed: DataFrame, x: np.ndarray) -> np.ndarray:
    """The symmetric matrix of the edges times x; each block gives the sums of its nodes."""
    sent = packed.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v, w = unpacked(row)
                start = np.flatnonzero(np.r_[True, np.diff(u) != 0])
                yield pa.RecordBatch.from_arrays([pa.array(u[start]), pa.array(np.add.reduceat(w * sent.value[v], start))], ["u", "y"])

    got = packed.mapInArrow(run, "u long, y double").toArrow()
    out = np.zeros_like(x)
    out[got["u"].to_numpy()] = got["y"].to_numpy()
    sent.destroy()
    return out
