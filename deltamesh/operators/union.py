"""The union diff: two graphs laid over each other, with a status on every node and edge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltamesh.model import A_ONLY, B_ONLY, CHANGED, KEY, SHARED, STATUSES, GraphError, PropertyGraph, is_numeric


@dataclass(frozen=True)
class AttributeComparison:
    """Which attributes make an element CHANGED. None: all that both sides have; an empty list: none."""

    nodes: Sequence[str] | None = None
    edges: Sequence[str] | None = None
    rtol: float = 1e-9
    atol: float = 0.0

    def chosen(self, wanted: Sequence[str] | None, a: list[str], b: list[str]) -> list[str]:
        both = sorted(set(a) & set(b))
        return both if wanted is None else [c for c in wanted if c in both]


def differs(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType, rtol: float, atol: float) -> Column:
    """Whether two values differ. Numbers (booleans count as such) within |a - b| <= atol + rtol |b| agree,
    NaN is null, both null agree, one null differs; values of different kinds differ unless both are null."""
    one_null = a.isNull() != b.isNull()
    if is_numeric(kind_a) and is_numeric(kind_b):
        x, y = (F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in (a, b))
        near = (x == y) | ((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")) & (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)))
        return (x.isNull() != y.isNull()) | F.coalesce(~near, F.lit(False))
    if kind_a == kind_b:
        return ~a.eqNullSafe(b)
    return one_null | (a.isNotNull() & b.isNotNull())


def _diff(a: DataFrame, b: DataFrame, keys: list[str], attributes: list[str], comparison: AttributeComparison) -> DataFrame:
    """Full outer join on the keys: a_ and b_ columns, status, changed_attrs. Presence is a flag set before the join.

    A key that repeats on a side is an error of the job that reads the union: it would make pairs
    of unlike rows. The count that finds it uses the join's own partitioning and order.
    """
    once = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    present = F.when(once, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit(f"repeated {' '.join(keys)}:"), *keys)).cast("boolean"))
    left = a.select(*keys, present.alias("__a"), *[F.col(f"`{c}`").alias(f"a_{c}") for c in a.columns if c not in keys])
    right = b.select(*keys, present.alias("__b"), *[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns if c not in keys])
    joined = left.join(right, keys, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    flags = [(c, differs(F.col(f"a_{c}"), F.col(f"b_{c}"), a.schema[c].dataType, b.schema[c].dataType, comparison.rtol, comparison.atol)) for c in attributes]
    changed = F.lit(False)
    for _, f in flags:
        changed = changed | f
    text = lambda c: F.col(c).cast("string")
    detail = [F.when(f, F.struct(F.lit(c).alias("attr"), text(f"a_{c}").alias("a"), text(f"b_{c}").alias("b"))) for c, f in flags]
    empty = F.lit(None).cast("array<struct<attr:string,a:string,b:string>>")
    status = F.when(F.col("__b").isNull(), A_ONLY).when(F.col("__a").isNull(), B_ONLY).when(changed, CHANGED).otherwise(SHARED)
    details = F.when(both & changed, F.filter(F.array(*detail), lambda x: x.isNotNull())) if detail else empty
    rest = [c for c in joined.columns if c not in (*keys, "__a", "__b")]
    return joined.select(*keys, status.alias("status"), details.alias("changed_attrs"), *rest)


@dataclass(frozen=True)
class UnionDiff:
    """nodes: label, status, changed_attrs, match columns, a_*, b_*; edges: source, type, target, status, changed_attrs, a_*, b_*.

    cells: (label, cell, type, side a or b), where both graphs have typed cells and nothing but them makes the edges' statuses.
    """

    nodes: DataFrame
    edges: DataFrame
    a: PropertyGraph
    b: PropertyGraph
    alignment: DataFrame | None = None
    cells: DataFrame | None = None

    def persist(self) -> UnionDiff:
        return replace(self, nodes=self.nodes.persist(), edges=self.edges.persist())

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def status_counts(self, what: str = "edges") -> DataFrame:
        """One row (status, n) for each of the four statuses."""
        frame = self.nodes if what == "nodes" else self.edges
        counts = frame.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])))

    def with_status(self, *statuses: str, what: str = "edges") -> DataFrame:
        frame = self.nodes if what == "nodes" else self.edges
        return frame.where(F.col("status").isin(*statuses))

    def shared_labels(self) -> DataFrame:
        return self.nodes.where(F.col("status").isin(SHARED, CHANGED)).select("label")

    def scoped_edges(self) -> DataFrame:
        """Edges with in_shared: both ends are nodes of both graphs. Raw and shared metrics then take one pass."""
        own = self.shared_labels().withColumn("__in", F.lit(True))
        first = self.edges.join(own.select(F.col("label").alias("source"), F.col("__in").alias("__s")), "source", "left")
        both = first.join(own.select(F.col("label").alias("target"), F.col("__in").alias("__t")), "target", "left")
        return both.withColumn("in_shared", F.col("__s").isNotNull() & F.col("__t").isNotNull()).select(*self.edges.columns, "in_shared")

    def induced_shared(self) -> UnionDiff:
        """The comparison restricted to nodes of both graphs, with both inputs restricted alike."""
        labels = self.shared_labels()
        nodes = self.nodes.where(F.col("status").isin(SHARED, CHANGED))
        edges = self.scoped_edges().where("in_shared").drop("in_shared")
        return UnionDiff(nodes, edges, self.a.induced(labels), self.b.induced(labels), self.alignment)

    def as_graph(self) -> PropertyGraph:
        """The union as one graph; the status is the attribute diff_status and details are JSON text."""
        plain = lambda f: f.withColumnRenamed("status", "diff_status").withColumn("diff_attrs", F.to_json("changed_attrs")).drop("changed_attrs")
        return PropertyGraph(plain(self.nodes), plain(self.edges), self.a.directed, f"{self.a.name}|{self.b.name}")

    def changed_long(self, what: str = "edges") -> DataFrame:
        """One row per changed attribute of an element."""
        frame, keys = (self.nodes, ["label"]) if what == "nodes" else (self.edges, KEY)
        return frame.where(F.col("status") == CHANGED).select(*keys, F.inline("changed_attrs"))


def relabel(b: PropertyGraph, alignment: DataFrame) -> PropertyGraph:
    """B under A's labels. Edges that fall together keep the first by their old key."""
    names = alignment.select(F.col("label_b").alias("__old"), F.col("label_a").alias("__new"))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        out = df.join(names, df[column] == F.col("__old"), "left")
        return out.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")

    nodes = renamed(b.nodes, "label")
    kept = b.edges.withColumn("__was", F.struct(*KEY))
    edges = renamed(renamed(kept, "source"), "target")
    if not b.directed:
        edges = edges.withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})
    rest = [c for c in b.edges.columns if c not in KEY]
    edges = edges.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "__was").alias("__rest")).select(*KEY, *[F.col(f"__rest.`{c}`").alias(c) for c in rest]) if rest else edges.select(*KEY).distinct()
    return replace(b, nodes=nodes, edges=edges, cells=None, closed=False)


def build_union(a: PropertyGraph, b: PropertyGraph, comparison: AttributeComparison = AttributeComparison(), alignment: DataFrame | None = None) -> UnionDiff:
    """Lay b over a, after renaming b's matched labels if an alignment is given. Lazy."""
    if a.directed != b.directed:
        raise GraphError("one graph is directed and the other is not")
    own = relabel(b, alignment) if alignment is not None else b
    nodes = _diff(a.nodes, own.nodes, ["label"], comparison.chosen(comparison.nodes, a.node_attributes, own.node_attributes), comparison)
    if alignment is not None:
        matched = alignment.select(F.col("label_a").alias("label"), F.col("method").alias("__m"), F.col("confidence").alias("__c"), F.col("label_b").alias("__b"))
        nodes = nodes.join(matched, "label", "left")
        two = F.col("status").isin(SHARED, CHANGED)
        nodes = nodes.withColumns({"match_method": F.when(two, F.coalesce("__m", F.lit("exact"))).otherwise(""), "match_confidence": F.when(two, F.coalesce("__c", F.lit(1.0))), "label_b": F.when(two, F.coalesce("__b", "label")).when(F.col("status") == B_ONLY, F.col("label"))}).drop("__m", "__c", "__b")
    edges = _diff(a.edges, own.edges, KEY, comparison.chosen(comparison.edges, a.edge_attributes, own.edge_attributes), comparison)
    cells = None
    if comparison == AttributeComparison() and all(g.cells is not None and "type" in g.cells.columns and g.edge_attributes == ["weight"] for g in (a, own)):
        sides = [g.cells.select("label", F.struct(F.lit(s).alias("side"), "cell").alias("cell"), "type", F.lit(s).alias("side")) for s, g in (("a", a), ("b", own))]
        cells = sides[0].unionByName(sides[1]) if a.cells.schema == own.cells.schema else None
    return UnionDiff(nodes, edges, a, own, alignment, cells)
