"""Metrics that count: set overlap, edit distance, weight agreement, neighbourhood change, incident changes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltamesh.functions.stats import correlation, with_average_ranks
from deltamesh.model import A_ONLY, B_ONLY, CHANGED, SHARED, PropertyGraph, endpoints, is_numeric, ratio
from deltamesh.operators.union import UnionDiff

SCOPES = ("raw", "shared")


def in_a(status: Column) -> Column:
    return status != B_ONLY


def in_b(status: Column) -> Column:
    return status != A_ONLY


def in_both(status: Column) -> Column:
    return status.isin(SHARED, CHANGED)


def coefficients(n_a: Column, n_b: Column, both: Column) -> list[Column]:
    """Jaccard, overlap and Dice coefficients; two empty sets are alike, an empty one overlaps nothing."""
    union, small = n_a + n_b - both, F.least(n_a, n_b)
    none = union == 0
    return [
        union.alias("n_union"),
        F.when(none, 1.0).otherwise(ratio(both, union)).alias("jaccard"),
        F.when(none, 1.0).when(small == 0, 0.0).otherwise(ratio(both, small)).alias("overlap"),
        F.when(none, 1.0).otherwise(ratio(2 * both, n_a + n_b)).alias("dice"),
    ]


def _sizes(where: Column | None = None) -> list[Column]:
    s = F.col("status")
    on = F.lit(True) if where is None else where
    return [F.count_if(in_a(s) & on).alias("n_a"), F.count_if(in_b(s) & on).alias("n_b"), F.count_if(in_both(s) & on).alias("n_both")]


def _scored(frame: DataFrame, *keep: str) -> DataFrame:
    return frame.select(*keep, "n_a", "n_b", "n_both", *coefficients(F.col("n_a"), F.col("n_b"), F.col("n_both")))


def node_overlap(u: UnionDiff) -> DataFrame:
    """Rows (scope, n_a, n_b, n_both, n_union, jaccard, overlap, dice)."""
    one = u.nodes.agg(*_sizes())
    both = one.select(F.inline(F.array(F.struct(F.lit("raw").alias("scope"), "n_a", "n_b", "n_both"), F.struct(F.lit("shared").alias("scope"), F.col("n_both").alias("n_a"), F.col("n_both").alias("n_b"), "n_both"))))
    return _scored(both, "scope")


def _by_scope(edges: DataFrame, *keys: str) -> DataFrame:
    """Sizes per scope and key in one aggregation."""
    shared = F.col("in_shared")
    raw = [c.alias(f"{s}_{n}") for s, on in (("raw", None), ("shared", shared)) for c, n in zip(_sizes(on), ("n_a", "n_b", "n_both"), strict=True)]
    wide = edges.groupBy(*keys).agg(*raw) if keys else edges.agg(*raw)
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), *[F.col(f"{s}_{n}").alias(n) for n in ("n_a", "n_b", "n_both")]) for s in SCOPES])
    return wide.select(*keys, F.inline(rows))


def typed_edge_overlap(u: UnionDiff) -> DataFrame:
    return _scored(_by_scope(u.scoped_edges()), "scope")


def per_type_overlap(u: UnionDiff) -> DataFrame:
    return _scored(_by_scope(u.scoped_edges(), "type").where("n_a + n_b > 0"), "scope", "type")


def untyped_edge_overlap(u: UnionDiff) -> DataFrame:
    """Edges as (source, target) pairs: in A if any type is, in B if any type is."""
    s = F.col("status")
    pairs = u.scoped_edges().groupBy("source", "target").agg(F.bool_or(in_a(s)).alias("a"), F.bool_or(in_b(s)).alias("b"), F.first("in_shared").alias("in_shared"))
    status = F.when(F.col("a") & F.col("b"), SHARED).when(F.col("a"), A_ONLY).otherwise(B_ONLY)
    return _scored(_by_scope(pairs.withColumn("status", status)), "scope")


@dataclass(frozen=True)
class EditCosts:
    """Costs of deleting, inserting and substituting, for nodes and edges; edge costs are scaled by type."""

    node_delete: float = 1.0
    node_insert: float = 1.0
    node_substitute: float = 1.0
    edge_delete: float = 1.0
    edge_insert: float = 1.0
    edge_substitute: float = 1.0
    type_factors: Mapping[str, float] = field(default_factory=dict)
    other_types: float = 1.0

    def factor(self, kind: Column) -> Column:
        if not self.type_factors:
            return F.lit(float(self.other_types))
        pairs = [F.lit(x) for k, v in self.type_factors.items() for x in (k, float(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(float(self.other_types)))


def edit_distance(u: UnionDiff, costs: EditCosts = EditCosts()) -> DataFrame:
    """Rows (scope, cost, worst, distance, similarity): the exact distance under identity of labels, and against deleting all of A and inserting all of B."""
    s, shared = F.col("status"), F.col("in_shared")

    def totals(frame: DataFrame, delete: float, insert: float, substitute: float, factor: Column, scoped: bool) -> DataFrame:
        cost = factor * F.when(s == A_ONLY, delete).when(s == B_ONLY, insert).when(s == CHANGED, substitute).otherwise(0.0)
        worst = factor * (F.when(in_a(s), delete).otherwise(0.0) + F.when(in_b(s), insert).otherwise(0.0))
        cols = []
        for scope in SCOPES:
            on = F.lit(True) if scope == "raw" else shared if scoped else in_both(s)
            cols += [F.coalesce(F.sum(F.when(on, cost)), F.lit(0.0)).alias(f"{scope}_cost"), F.coalesce(F.sum(F.when(on, worst)), F.lit(0.0)).alias(f"{scope}_worst")]
        wide = frame.agg(*cols)
        return wide.select(F.inline(F.array(*[F.struct(F.lit(x).alias("scope"), F.col(f"{x}_cost").alias("cost"), F.col(f"{x}_worst").alias("worst")) for x in SCOPES])))

    parts = totals(u.nodes, costs.node_delete, costs.node_insert, costs.node_substitute, F.lit(1.0), False).unionByName(totals(u.scoped_edges(), costs.edge_delete, costs.edge_insert, costs.edge_substitute, costs.factor(F.col("type")), True))
    both = parts.groupBy("scope").agg(F.sum("cost").alias("cost"), F.sum("worst").alias("worst"))
    distance = F.when(F.col("worst") > 0, F.least(F.lit(1.0), ratio(F.col("cost"), F.col("worst")))).otherwise(F.when(F.col("cost") > 0, 1.0).otherwise(0.0))
    return both.select("scope", "cost", "worst", distance.alias("distance"), (1 - distance).alias("similarity"))


def weight_agreement(u: UnionDiff, attribute: str = "weight") -> DataFrame:
    """One row (n_compared, spearman, pearson, mean_abs_diff) over edges of both graphs with numbers on both sides.

    A constant side leaves a correlation undefined (null), except that identical sides give 1.
    """
    a, b = f"a_{attribute}", f"b_{attribute}"
    types = dict(u.edges.dtypes)
    if a not in types or b not in types or not all(is_numeric(u.edges.schema[c].dataType) for c in (a, b)):
        return u.edges.sparkSession.createDataFrame([(0, None, None, None)], "n_compared long, spearman double, pearson double, mean_abs_diff double")
    xy = u.edges.where(in_both(F.col("status"))).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ranked = with_average_ranks(with_average_ranks(xy, "x", "rx"), "y", "ry")
    same = (F.count(F.lit(1)) >= 2) & F.coalesce(F.bool_and(F.col("x") == F.col("y")), F.lit(False))
    return ranked.agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.coalesce(correlation("rx", "ry"), F.when(same, 1.0)).alias("spearman"),
        F.coalesce(correlation("x", "y"), F.when(same, 1.0)).alias("pearson"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"),
    )


def neighborhood_delta(u: UnionDiff, direction: str = "both") -> DataFrame:
    """Per node of both graphs: jaccard of its neighbour sets, their sizes, and neighbours shared, added, removed."""
    a = u.a.neighbors(direction).withColumn("__a", F.lit(1))
    b = u.b.neighbors(direction).withColumn("__b", F.lit(1))
    pairs = a.join(b, ["label", "neighbor"], "full_outer")
    x, y = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    per = pairs.groupBy("label").agg(F.count_if(x).alias("na"), F.count_if(y).alias("nb"), F.count_if(x & y).alias("ns"))
    full = u.shared_labels().join(per, "label", "left").na.fill(0, ["na", "nb", "ns"])
    union = F.col("na") + F.col("nb") - F.col("ns")
    return full.select("label", F.when(union == 0, 1.0).otherwise(ratio(F.col("ns"), union)).alias("jaccard"), F.col("na").alias("n_neighbors_a"), F.col("nb").alias("n_neighbors_b"), F.col("ns").alias("n_shared"), (F.col("nb") - F.col("ns")).alias("n_added"), (F.col("na") - F.col("ns")).alias("n_removed"))


def neighborhood_summary(delta: DataFrame) -> DataFrame:
    return delta.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("jaccard").alias("mean_jaccard"), F.percentile("jaccard", 0.5).alias("median_jaccard"), F.count_if(F.col("jaccard") == 1.0).alias("n_unchanged"))


def most_changed(delta: DataFrame, n: int) -> DataFrame:
    return delta.orderBy(F.col("jaccard").asc(), F.col("n_added").desc(), F.col("n_removed").desc(), F.col("label").asc()).limit(n)


def incident_counts(u: UnionDiff) -> DataFrame:
    """Per node of the union, incident edge rows by status; a self-loop counts twice, edges to unknown nodes at their known end."""
    s = F.col("status")
    per = endpoints(u.edges, "status").groupBy("label").agg(*[F.count_if(s == x).alias(n) for x, n in ((SHARED, "n_shared"), (CHANGED, "n_changed"), (A_ONLY, "n_removed"), (B_ONLY, "n_added"))])
    names = ["n_shared", "n_changed", "n_removed", "n_added"]
    return u.nodes.select("label", "status").join(per, "label", "left").na.fill(0, names).select("label", "status", *names)


def background_rates(u: UnionDiff) -> DataFrame:
    """One row: edges in A, in B, in both, and the shares removed, added, reweighted."""
    s = F.col("status")
    t = u.edges.agg(F.count_if(s == A_ONLY).alias("removed"), F.count_if(s == B_ONLY).alias("added"), F.count_if(s == CHANGED).alias("changed"), F.count_if(in_a(s)).alias("edges_a"), F.count_if(in_b(s)).alias("edges_b"), F.count_if(in_both(s)).alias("edges_both"))
    rate = lambda a, b, n: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0)).alias(n)
    return t.select("*", rate("removed", "edges_a", "removal"), rate("added", "edges_b", "addition"), rate("changed", "edges_both", "reweight"))


def union_degree(u: UnionDiff) -> DataFrame:
    return PropertyGraph(u.nodes.select("label"), u.edges.select("source", "type", "target")).degrees()
