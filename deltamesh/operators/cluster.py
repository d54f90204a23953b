"""Clusters of the union graph: memberships and how much each part changed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.model import DIFFERING, STATUSES, PropertyGraph, ratio
from deltamesh.operators.blocks import Block, in_blocks, merged, numbered, reader
from deltamesh.operators.cells import Projection
from deltamesh.operators.counts import union_degree
from deltamesh.operators.frames import settled
from deltamesh.operators.structure import adjacency
from deltamesh.operators.union import UnionDiff

#: Links from which a node's are added up as arrays.
MANY = 64
NONE, OTHER = "(none)", "(other)"


def by_attribute(u: UnionDiff, attribute: str) -> DataFrame:
    """(label, cluster) from a node attribute: A's value, else B's."""
    have = [c for c in (f"a_{attribute}", f"b_{attribute}") if c in u.nodes.columns]
    if not have:
        raise KeyError(attribute)
    return u.nodes.select("label", F.coalesce(*[F.col(c).cast("string") for c in have], F.lit(NONE)).alias("cluster"))


def by_membership(u: UnionDiff, membership: DataFrame) -> DataFrame:
    return u.nodes.select("label").join(membership.select("label", F.col("cluster").cast("string").alias("cluster")), "label", "left").na.fill(NONE, ["cluster"])


def communities(g: PropertyGraph, resolution: float = 1.0, local_edges: int = 3_000_000, local_nodes: int = 2_000_000, rounds: int = 20) -> tuple[DataFrame, str]:
    """(label, cluster) and the method's name.

    Greedy modularity moves with aggregation and a split into connected parts, in label order
    (deterministic), with at most `rounds` passes a level. Above the counted bounds the edges stay
    in Spark and come to the driver in blocks, once a pass; it holds only arrays as long as the
    nodes, and the result is the same. Graphs with cells need no table of edges: the driver makes
    each node's neighbours when it comes to it. Graphs without edges give singletons.
    """
    if g.cells is not None:
        p = Projection(g)
        member = modularity_of_cells(p, resolution, rounds, local_edges)
        return p.frame(cluster=[f"c{m}" for m in member.tolist()]), "modularity"
    adj = adjacency(g).persist()
    labels = sorted(g.nodes.select("label").toArrow()["label"].to_pylist())
    if len(labels) <= local_nodes and adj.count() <= 2 * local_edges:
        index = pd.Index(labels)
        e = adj.toArrow()
        u, v = index.get_indexer(e["u"].to_pandas()), index.get_indexer(e["v"].to_pandas())
        member = modularity(u, v, np.ones(len(u)), len(labels), resolution, rounds)
    else:
        member = modularity_in_blocks(settled(numbered(adj, labels)), len(labels), resolution, rounds, local_edges)
    out = g.nodes.sparkSession.createDataFrame(pd.DataFrame({"label": labels, "cluster": [f"c{m}" for m in member.tolist()]}), "label string, cluster string")
    return out, "modularity"


def modularity(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, resolution: float, rounds: int = 20) -> np.ndarray:
    """Communities of a symmetric edge list by local moves and aggregation; numbered by first node."""
    member = levels(u, v, w, np.arange(n), n, resolution, rounds)
    return connected_parts(lambda: [(u, v, w)], member)


def modularity_in_blocks(edges: DataFrame, n: int, resolution: float, rounds: int, local_edges: int) -> np.ndarray:
    """The same over a table of edges (u, v, w): levels of too many edges are read in blocks."""
    first = reader(in_blocks(edges))
    own = local_moves(first, n, resolution, rounds)
    member = np.arange(n) if own is None else further_levels(merged(edges, own), own, resolution, rounds, local_edges)
    return connected_parts(first, member)


def modularity_of_cells(p: Projection, resolution: float, rounds: int, local_edges: int) -> np.ndarray:
    """The same of a graph given by its cells."""
    own = local_moves(p.blocks, p.n, resolution, rounds, p.degrees().astype(float))
    member = np.arange(p.n) if own is None else further_levels(p.merged(own), own, resolution, rounds, local_edges)
    return p.components(member)


def further_levels(edges: DataFrame, member: np.ndarray, resolution: float, rounds: int, local_edges: int) -> np.ndarray:
    """The members' communities after the levels that follow on the edges between them."""
    k = int(member.max()) + 1
    while edges.count() > 2 * local_edges:
        own = local_moves(reader(in_blocks(edges)), k, resolution, rounds)
        if own is None:
            return member
        member = own[member]
        k = int(own.max()) + 1
        edges = merged(edges, own)
    e = edges.toArrow()
    return levels(*(e[c].to_numpy() for c in ("u", "v", "w")), member, k, resolution, rounds)


def levels(cu: np.ndarray, cv: np.ndarray, cw: np.ndarray, member: np.ndarray, k: int, resolution: float, rounds: int) -> np.ndarray:
    """The members' communities after moves and aggregation, as long as any node moves."""
    while True:
        order = np.argsort(cu, kind="stable")
        cu, cv, cw = cu[order], cv[order], cw[order]
        own = local_moves(lambda: [(cu, cv, cw)], k, resolution, rounds)  # noqa: B023
        if own is None:
            return member
        member = own[member]
        k = int(own.max()) + 1
        key = own[cu].astype(np.int64) * k + own[cv]
        pair, back = np.unique(key, return_inverse=True)
        cw = np.bincount(back, cw)
        cu, cv = pair // k, pair % k


def local_moves(blocks: Callable[[], Iterable[Block]], k: int, resolution: float, rounds: int, degree: np.ndarray | None = None) -> np.ndarray | None:
    """Communities of k nodes after passes over the edges, which come in order of their first node; null if none moved.

    degree: each node's weight, if it is known. Communities are numbered anew, in their order, now and
    then, so that arrays as long as they are stay short; whatever has many links is taken as arrays.
    """
    if degree is None:
        degree = np.zeros(k)
        for u, _, w in blocks():
            degree += np.bincount(u, w, minlength=k)
    total = degree.sum()
    if total == 0:
        return None
    dg, com, ins = degree.tolist(), np.arange(k), degree.copy()
    moved_any, seen = False, 0
    for _ in range(rounds):
        moved = 0
        for u, v, w in blocks():
            start = np.flatnonzero(np.r_[True, np.diff(u) != 0]) if len(u) else np.zeros(0, np.int64)
            nodes, st = u[start].tolist(), [*start.tolist(), len(u)]
            seen += len(nodes)
            if 64 * seen > k:
                held, com = np.unique(com, return_inverse=True)
                ins, seen = ins[held], 0
            for at, x in enumerate(nodes):
                here = int(com[x])
                ins[here] -= dg[x]
                step = resolution * dg[x]
                if st[at + 1] - st[at] < MANY:
                    best = _best_of_few(v[st[at] : st[at + 1]], w[st[at] : st[at + 1]], x, here, com, ins, step, total)
                else:
                    best = _best_of_many(v[st[at] : st[at + 1]], w[st[at] : st[at + 1]], x, here, com, ins, step, total)
                ins[best] += dg[x]
                if best != here:
                    com[x] = best
                    moved += 1
        moved_any |= moved > 0
        if moved <= k // 1000:
            break
    return np.unique(com, return_inverse=True)[1] if moved_any else None


def _best_of_few(near: np.ndarray, weight: np.ndarray, x: int, here: int, com: np.ndarray, ins: np.ndarray, step: float, total: float) -> int:
    links: dict[int, float] = {}
    for y, c, w in zip(near.tolist(), com[near].tolist(), weight.tolist(), strict=True):
        if y != x:
            links[c] = links.get(c, 0.0) + w
    best, gain = here, links.get(here, 0.0) - step * ins[here] / total
    for c in sorted(links):
        value = links[c] - step * ins[c] / total
        if value > gain + 1e-12:
            best, gain = c, value
    return best


def _best_of_many(near: np.ndarray, weight: np.ndarray, x: int, here: int, com: np.ndarray, ins: np.ndarray, step: float, total: float) -> int:
    """The same for whole weights, whose sums don't depend on their order."""
    other = near != x
    if not other.all():
        near, weight = near[other], weight[other]
    links = np.bincount(com[near], weight, minlength=here + 1)
    gain = links[here] - step * ins[here] / total
    value = links - step * ins[: len(links)] / total
    rising = np.flatnonzero((value > gain + 1e-12) & (links > 0))
    best = here
    while len(rising):
        best = int(rising[0])
        gain = value[best]
        rising = rising[1:][value[rising[1:]] > gain + 1e-12]
    return best


def connected_parts(blocks: Callable[[], Iterable[Block]], member: np.ndarray) -> np.ndarray:
    """A community that fell apart is split: the least member of each connected part names it."""
    label = np.arange(len(member))
    while True:
        new = label.copy()
        for u, v, _ in blocks():
            same = member[u] == member[v]
            np.minimum.at(new, u[same], label[v[same]])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@dataclass(frozen=True)
class ClusterMap:
    """clusters: one row each, with rank; links: one row per pair of clusters; membership: (label, cluster)."""

    clusters: DataFrame
    links: DataFrame
    membership: DataFrame
    method: str


def folded(membership: DataFrame, most: int) -> DataFrame:
    """The `most` largest clusters keep their names (ties by name), the others become one."""
    sizes = membership.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("n").desc(), F.col("cluster").asc())
    kept = sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("cluster", F.lit(True).alias("keep"))
    return membership.join(kept, "cluster", "left").select("label", F.when(F.col("keep"), F.col("cluster")).otherwise(OTHER).alias("cluster"))


def cluster_map(u: UnionDiff, membership: DataFrame, method: str, most: int = 60) -> ClusterMap:
    """Sizes, statuses, hub, inner edges and change density per cluster, and the edges between clusters."""
    own = folded(membership, most)
    s = F.col("status")
    counts = lambda prefix: [F.count_if(s == x).alias(f"{prefix}_{x.lower()}") for x in STATUSES]
    names = [f"edges_{x.lower()}" for x in STATUSES]
    if u.cells is not None:
        own = settled(own)
        per_node = _changes_of_cells(u, own)
        degree = per_node.select("label", "degree")
    else:
        degree = union_degree(u)
    nodes = u.nodes.select("label", "status").join(own, "label").join(degree, "label")
    hub = F.min_by("label", F.struct(-F.col("degree"), "label")).alias("name")
    sized = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), hub, *counts("nodes"))
    placed = u.edges.select("source", "target", "status").join(own.select(F.col("label").alias("source"), F.col("cluster").alias("ca")), "source").join(own.select(F.col("label").alias("target"), F.col("cluster").alias("cb")), "target")
    if u.cells is not None:
        # both ends of an inner edge count it
        inner = per_node.join(own, "label").groupBy("cluster").agg(*[F.expr(f"sum({x}) div 2").alias(c) for x, c in zip(STATUSES, names, strict=True)])
    else:
        inner = placed.where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(*counts("edges"))
    links = placed.where("ca <> cb").groupBy(F.least("ca", "cb").alias("cluster_a"), F.greatest("ca", "cb").alias("cluster_b")).agg(*counts("edges"))
    full = sized.join(inner, "cluster", "left").na.fill(0, names)
    changed = sum((F.col(f"{p}_{x.lower()}") for p in ("nodes", "edges") for x in DIFFERING), F.lit(0))
    total = F.col("size") + sum((F.col(c) for c in names), F.lit(0))
    full = full.withColumns({"n_changed": changed, "change_density": F.coalesce(ratio(changed, total), F.lit(0.0))})
    order = Window.orderBy(F.col("change_density").desc(), F.col("size").desc(), F.col("cluster").asc())
    return ClusterMap(full.withColumn("rank", F.row_number().over(order)), links, own, method)


def _changes_of_cells(u: UnionDiff, own: DataFrame) -> DataFrame:
    """(label, degree, and by status the edges to the same cluster) of every node of the union."""
    p = Projection(_union_of(u))
    found = own.toArrow()
    at = pc.index_in(p.labels, value_set=found["label"].combine_chunks())
    group = np.unique(found["cluster"].to_numpy().astype(str), return_inverse=True)[1][at.to_numpy()]
    return p.frame(**p.changes(group))


def _union_of(u: UnionDiff) -> PropertyGraph:
    return PropertyGraph(u.nodes.select("label"), u.edges.select("source", "type", "target"), u.a.directed, cells=u.cells)


def concentration(clusters: DataFrame, share: float = 0.8) -> DataFrame:
    """One row (n_clusters, n_changed, k): the fewest clusters that hold the share of all change."""
    order = Window.orderBy(F.col("n_changed").desc(), F.col("cluster").asc())
    t = clusters.select("cluster", "n_changed").withColumns({"place": F.row_number().over(order), "reach": F.sum("n_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n_changed").over(Window.partitionBy())})
    return t.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.max("total"), F.lit(0)).alias("n_changed"), F.min(F.when(F.col("reach") >= share * F.col("total"), F.col("place"))).alias("k"))


def clusters_of(u: UnionDiff, membership: DataFrame | None = None, attribute: str | None = None, resolution: float = 1.0, most: int = 60) -> ClusterMap:
    if membership is not None:
        return cluster_map(u, by_membership(u, membership), "supplied", most)
    if attribute is not None:
        return cluster_map(u, by_attribute(u, attribute), f"attribute:{attribute}", most)
    own, method = communities(_union_of(u), resolution)
    return cluster_map(u, own, method, most)
