"""How surprising each node's change is, and how central the node."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.functions.stats import surprise
from deltamesh.model import PropertyGraph
from deltamesh.operators.cells import Projection
from deltamesh.operators.counts import background_rates, incident_counts
from deltamesh.operators.frames import settled
from deltamesh.operators.structure import adjacency
from deltamesh.operators.union import UnionDiff

DAMPING = 0.85


def pagerank_steps(g: PropertyGraph, steps: int, damping: float = DAMPING, tolerance: float | None = None, every: int = 5) -> DataFrame:
    """(label, pagerank) by power iteration over the undirected simple graph, as DataFrames.

    Isolated nodes are dangling: their mass goes to all nodes alike. A checkpoint ends the lineage
    every few steps; with a tolerance it also ends the loop once the change is below.
    """
    if g.cells is not None:
        return _pagerank_of_cells(Projection(g), steps, damping, tolerance)
    adj = settled(adjacency(g))
    degree = adj.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    nodes = settled(g.nodes.select(F.col("label").alias("u")).join(degree, "u", "left").na.fill(0))
    n = nodes.count()
    if n == 0:
        return nodes.select(F.col("u").alias("label"), F.lit(None).cast("double").alias("pagerank"))
    # nodes without a neighbour all hold one and the same rank, so what they pass on is a number
    alone = nodes.where("d = 0").count()
    single = 1.0 / n
    ranks = nodes.withColumn("r", F.lit(1.0 / n))
    before = None
    for i in range(1, steps + 1):
        sent = adj.join(ranks.where("d > 0").select("u", (F.col("r") / F.col("d")).alias("s")), "u")
        got = sent.groupBy("v").agg(F.sum("s").alias("s")).withColumnRenamed("v", "u")
        base = (1 - damping) / n + damping * alone * single / n
        single = base
        ranks = nodes.join(got, "u", "left").select("u", "d", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("r"))
        if i % every == 0:
            ranks = settled(ranks)
            if tolerance is not None:
                if before is not None:
                    gap = ranks.join(before.select("u", F.col("r").alias("was")), "u").agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0]
                    if gap < tolerance:
                        break
                before = ranks
    return ranks.select(F.col("u").alias("label"), F.col("r").alias("pagerank"))


def _pagerank_of_cells(p: Projection, steps: int, damping: float, tolerance: float | None) -> DataFrame:
    """The same with each step's sums taken from the cells; the driver holds a few arrays as long as the nodes."""
    if p.n == 0:
        return p.frame(pagerank=np.zeros(0))
    degree = p.degrees()
    r = np.full(p.n, 1.0 / p.n)
    for _ in range(steps):
        new = (1 - damping) / p.n + damping * (p.sums(r / np.maximum(degree, 1))[0] + r[degree == 0].sum() / p.n)
        gap, r = np.abs(new - r).sum(), new
        if tolerance is not None and gap < tolerance:
            break
    return p.frame(pagerank=r)


def pagerank(g: PropertyGraph, local_edges: int = 3_000_000, local_nodes: int = 2_000_000, tolerance: float = 1e-10) -> DataFrame:
    """(label, pagerank) to convergence: arrays in the driver where the counted graph is below the bounds, DataFrames beyond."""
    if g.cells is not None:
        return pagerank_steps(g, 400, tolerance=tolerance)
    adj = adjacency(g).persist()
    n, m = g.nodes.count(), adj.count()
    if n > local_nodes or m > 2 * local_edges:
        return pagerank_steps(g, 200, tolerance=tolerance)
    labels = g.nodes.select("label").toArrow()["label"].combine_chunks()
    if n == 0:
        return g.nodes.select("label", F.lit(None).cast("double").alias("pagerank"))
    index = pd.Index(labels.to_pandas())
    e = adj.toArrow()
    u, v = index.get_indexer(e["u"].to_pandas()), index.get_indexer(e["v"].to_pandas())
    degree = np.bincount(u, minlength=n).astype(float)
    r = np.full(n, 1.0 / n)
    give = 1 / np.maximum(degree, 1)
    for _ in range(400):
        new = (1 - DAMPING) / n + DAMPING * (np.bincount(v, (r * give)[u], minlength=n) + r[degree == 0].sum() / n)
        gap = np.abs(new - r).sum()
        r = new
        if gap < tolerance:
            break
    adj.unpersist()
    return g.nodes.sparkSession.createDataFrame(pd.DataFrame({"label": index, "pagerank": r}))


def surprises(u: UnionDiff) -> DataFrame:
    """Per node: incident changes, degrees and the surprise of each kind of change and of all."""
    t = incident_counts(u).crossJoin(F.broadcast(background_rates(u).select("removed", "added", "changed", "edges_a", "edges_b", "edges_both")))  # one row
    deg_a = F.col("n_shared") + F.col("n_changed") + F.col("n_removed")
    deg_b = F.col("n_shared") + F.col("n_changed") + F.col("n_added")
    t = t.withColumns({"degree_a": deg_a, "degree_b": deg_b})
    t = t.withColumns({
        "surprise_removed": surprise(F.col("n_removed"), F.col("degree_a"), F.col("removed"), F.col("edges_a")),
        "surprise_added": surprise(F.col("n_added"), F.col("degree_b"), F.col("added"), F.col("edges_b")),
        "surprise_changed": surprise(F.col("n_changed"), F.col("n_shared") + F.col("n_changed"), F.col("changed"), F.col("edges_both")),
    })
    magnitude = F.col("n_removed") + F.col("n_added") + 0.5 * F.col("n_changed")
    t = t.withColumns({"surprise": F.col("surprise_removed") + F.col("surprise_added") + F.col("surprise_changed"), "magnitude": magnitude.cast("double")})
    score = F.when(F.col("magnitude") > 0, (1 + F.col("surprise")) * F.log2(2 + F.col("magnitude"))).otherwise(0.0)
    return t.select("label", "status", score.alias("significance"), "surprise", "magnitude", "surprise_removed", "surprise_added", "surprise_changed", "n_removed", "n_added", "n_changed", "degree_a", "degree_b")


def node_significance(u: UnionDiff, jaccard: DataFrame | None = None, rank=pagerank) -> DataFrame:
    """The full table per node; order by significance, impact (both falling) and label. rank: a function graph -> (label, pagerank)."""
    whole = PropertyGraph(u.nodes.select("label"), u.edges.select("source", "type", "target"), u.a.directed)
    of = {k: rank(g).withColumnRenamed("pagerank", k) for k, g in (("pagerank", whole), ("pagerank_a", u.a), ("pagerank_b", u.b))}
    top = of["pagerank"].agg(F.max("pagerank").alias("top"))
    t = surprises(u).join(of["pagerank"], "label", "left").join(of["pagerank_a"], "label", "left").join(of["pagerank_b"], "label", "left").crossJoin(F.broadcast(top))  # one row
    t = t.withColumns({"impact": F.col("magnitude") * F.coalesce(F.try_divide("pagerank", "top"), F.col("pagerank")), "centrality_shift": F.col("pagerank_b") - F.col("pagerank_a")}).drop("pagerank_b", "top")
    if jaccard is None:
        return t.withColumn("jaccard", F.lit(None).cast("double"))
    return t.join(jaccard.select("label", "jaccard"), "label", "left")


def ranked(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("significance").desc(), F.col("impact").desc(), F.col("label").asc())
