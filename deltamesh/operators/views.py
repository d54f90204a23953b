"""What a reader looks at: the focus around differences, ego networks, layouts, similarity matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.model import A_ONLY, B_ONLY, CHANGED, DIFFERING, PropertyGraph, endpoints
from deltamesh.operators.counts import union_degree
from deltamesh.operators.union import UnionDiff


def focus_nodes(u: UnionDiff, most: int = 2000, hops: int = 1) -> DataFrame:
    """(label, is_seed): nodes that differ or touch a differing edge, grown by hops while fewer than
    `most`; over the cap seeds stay first, in label order, then context by degree. Without any
    difference the nodes of highest degree."""
    differ = F.col("status").isin(*DIFFERING)
    known = u.nodes.select("label")
    seeds = u.nodes.where(differ).select("label").unionByName(endpoints(u.edges.where(differ))).distinct().join(known, "label", "left_semi").persist()
    degree = union_degree(u)
    if seeds.isEmpty():
        return degree.orderBy(F.col("degree").desc(), "label").limit(most).select("label", F.lit(False).alias("is_seed"))
    grown = seeds
    for _ in range(max(hops, 0)):
        if grown.limit(most).count() >= most:
            break
        ends = u.edges.select("source", "target")
        near = ends.join(grown.withColumnRenamed("label", "source"), "source", "left_semi").unionByName(ends.join(grown.withColumnRenamed("label", "target"), "target", "left_semi"))
        grown = grown.unionByName(endpoints(near).distinct().join(known, "label", "left_semi")).distinct()
    flagged = grown.join(seeds.withColumn("is_seed", F.lit(True)), "label", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    first = F.when(F.col("is_seed"), 0).otherwise(-F.col("degree"))
    # limit over an order: each partition keeps its best `most`
    return flagged.join(degree, "label").orderBy(F.col("is_seed").desc(), first, "label").limit(most).select("label", "is_seed")


def focus_edges(u: UnionDiff, focus: DataFrame) -> DataFrame:
    """Union edges with both ends in the focus."""
    own = focus.select("label")
    return u.edges.join(own.withColumnRenamed("label", "source"), "source", "left_semi").join(own.withColumnRenamed("label", "target"), "target", "left_semi").select(u.edges.columns)


def ego_networks(u: UnionDiff, labels: DataFrame, most: int = 24) -> DataFrame:
    """(ego, neighbor, status, outgoing, n_hidden): one row per neighbour kept. Parallel edges show
    their most telling status (only in B, only in A, changed, shared), differences stay first."""
    want = labels.select(F.col("label").alias("ego")).distinct()
    telling = F.when(F.col("status") == B_ONLY, 3).when(F.col("status") == A_ONLY, 2).when(F.col("status") == CHANGED, 1).otherwise(0)
    out = u.edges.select(F.col("source").alias("ego"), F.col("target").alias("neighbor"), "status", F.lit(True).alias("outgoing"))
    back = u.edges.select(F.col("target").alias("ego"), F.col("source").alias("neighbor"), "status", F.lit(False).alias("outgoing"))
    pairs = out.unionByName(back).join(want, "ego", "left_semi").where("ego <> neighbor").withColumn("r", telling)
    one = pairs.groupBy("ego", "neighbor").agg(F.max_by(F.struct("status", "outgoing", "r"), F.struct("r", "outgoing")).alias("x")).select("ego", "neighbor", "x.*")
    order = Window.partitionBy("ego").orderBy(F.col("r").desc(), F.col("neighbor").asc())
    placed = one.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("ego"))})
    return placed.where(F.col("place") <= most).select("ego", "neighbor", "status", "outgoing", F.greatest(F.col("n") - most, F.lit(0)).alias("n_hidden"))


def ego_counts(egos: DataFrame) -> DataFrame:
    return egos.groupBy("ego", "status").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class LayoutParams:
    steps: int = 120
    dimensions: int = 2
    seed: int = 3
    cooling: float = 0.95


def layout(nodes: list[str], edges: list[tuple[str, str]], params: LayoutParams = LayoutParams()) -> dict[str, list[float]]:
    """Spring positions in [0, 1] for a focus graph, which is capped: nodes repel within a grid's cells, edges pull."""
    n, d = len(nodes), params.dimensions
    if n == 0:
        return {}
    rng = np.random.default_rng(params.seed)
    x = rng.random((n, d))
    at = {v: i for i, v in enumerate(nodes)}
    e = np.array([(at[a], at[b]) for a, b in edges if a in at and b in at and a != b], np.int64).reshape(-1, 2)
    k = (1.0 / n) ** (1.0 / d)
    heat = 0.1
    for _ in range(params.steps):
        push = np.zeros_like(x)
        cell = np.floor(x / (2 * k)).astype(np.int64)
        key = cell @ (np.array([1, 73856093, 19349663])[:d])
        for own in np.split(np.argsort(key, kind="stable"), np.flatnonzero(np.diff(np.sort(key))) + 1):
            delta = x[own][:, None] - x[own][None]
            dist = np.maximum(np.sqrt((delta**2).sum(-1)), 1e-3)
            push[own] += (delta / dist[..., None] * (k * k / dist)[..., None]).sum(1)
        if len(e):
            delta = x[e[:, 0]] - x[e[:, 1]]
            pull = delta * (np.sqrt((delta**2).sum(1)) / k)[:, None]
            np.add.at(push, e[:, 0], -pull)
            np.add.at(push, e[:, 1], pull)
        size = np.maximum(np.sqrt((push**2).sum(1)), 1e-9)
        x = x + push / size[:, None] * np.minimum(size, heat)[:, None]
        heat *= params.cooling
    low, high = x.min(0), x.max(0)
    x = (x - low) / np.where(high > low, high - low, 1)
    return {v: x[i].tolist() for v, i in at.items()}


def similarity_matrix(pairs: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Long pairs (graph_a, graph_b, value) as a square table with ones on the diagonal."""
    both = pairs.select("graph_a", "graph_b", value).unionByName(pairs.select(F.col("graph_b").alias("graph_a"), F.col("graph_a").alias("graph_b"), value))
    wide = both.groupBy("graph_a").pivot("graph_b", names).agg(F.first(value))
    return wide.select("graph_a", *[F.when(F.col("graph_a") == n, 1.0).otherwise(F.col(f"`{n}`")).alias(n) for n in names])


def degree_histogram(g: PropertyGraph) -> DataFrame:
    """(degree, fraction) of nodes with an edge."""
    counted = g.degrees().where("degree > 0").groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("degree", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("fraction"))
