"""Property graphs as pairs of DataFrames, and the statuses of their comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARED, CHANGED, A_ONLY, B_ONLY = "SHARED", "CHANGED", "A_ONLY", "B_ONLY"
STATUSES = (SHARED, CHANGED, A_ONLY, B_ONLY)
DIFFERING = (CHANGED, A_ONLY, B_ONLY)
KEY = ["source", "type", "target"]
RESERVED = {"source", "target", "type", "status", "changed_attrs"}


class GraphError(ValueError):
    """The tables don't form a graph: a missing column, a repeated label, a repeated edge."""


class DuplicateEdgeError(GraphError):
    """Edges repeat and the policy is to refuse them."""


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """Both endpoints of every edge as rows (label, ...); a self-loop gives two rows."""
    return edges.select(F.explode(F.array("source", "target")).alias("label"), *keep)


@dataclass(frozen=True)
class PropertyGraph:
    """Uniquely labelled nodes (label, ...) and typed edges (source, type, target, ...).

    Frames are lazy and already in canonical form; build graphs with `graph()`. Where edges come from
    cells whose members are all joined, `cells` may hold them as rows (label, cell), for what needs
    only who is adjacent to whom. Where they also have a column `type`, edges are by this type and the
    number of common cells of the type is their weight, their only attribute. `closed`: both ends of every edge are known to be nodes.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    name: str = "graph"
    cells: DataFrame | None = None
    closed: bool = False

    @property
    def node_attributes(self) -> list[str]:
        return [c for c in self.nodes.columns if c != "label"]

    @property
    def edge_attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in KEY]

    @cached_property
    def n_nodes(self) -> int:
        return self.nodes.count()

    @cached_property
    def n_edges(self) -> int:
        return self.edges.count()

    def edge_types(self) -> DataFrame:
        return self.edges.select("type").distinct().orderBy("type")

    def density(self) -> float:
        n, m = self.n_nodes, self.n_edges
        return 0.0 if n < 2 else m / (n * (n - 1) / (1 if self.directed else 2))

    def degrees(self) -> DataFrame:
        """(label, degree) for every node; each edge row counts at both ends."""
        counted = endpoints(self.edges).groupBy("label").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("label").join(counted, "label", "left").select("label", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def degree_stats(self) -> DataFrame:
        d = F.col("degree")
        return self.degrees().agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.percentile(d, 0.5).alias("median"), F.stddev_pop(d).alias("std"))

    def neighbors(self, direction: str = "both") -> DataFrame:
        """Distinct (label, neighbor) pairs."""
        out = self.edges.select(F.col("source").alias("label"), F.col("target").alias("neighbor"))
        back = self.edges.select(F.col("target").alias("label"), F.col("source").alias("neighbor"))
        pairs = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
        return pairs.distinct()

    def neighborhoods(self, direction: str = "both") -> DataFrame:
        """(label, neighbors) with the set of adjacent labels."""
        return self.neighbors(direction).groupBy("label").agg(F.sort_array(F.collect_set("neighbor")).alias("neighbors"))

    def induced(self, labels: DataFrame) -> PropertyGraph:
        """The subgraph on the labels (column `label`): edges with both ends in it."""
        own = self.nodes.join(labels.select("label").distinct(), "label", "left_semi")
        known = own.select("label")
        edges = self.edges.join(known.withColumnRenamed("label", "source"), "source", "left_semi").join(known.withColumnRenamed("label", "target"), "target", "left_semi")
        return replace(self, nodes=own, edges=edges.select(self.edges.columns), cells=None, closed=True)

    def inspect(self) -> dict:
        """Counts, the first fifty types, density, attributes and degree statistics."""
        types = [r["type"] for r in self.edge_types().limit(50).collect()]
        return {"name": self.name, "directed": self.directed, "n_nodes": self.n_nodes, "n_edges": self.n_edges, "edge_types": types, "density": self.density(), "node_attributes": self.node_attributes, "edge_attributes": self.edge_attributes, "degree": self.degree_stats().first().asDict()}

    def frames_view(self) -> tuple[DataFrame, DataFrame]:
        """Vertices (id, ...) and edges (src, dst, ...), the shape that graph-frame libraries take."""
        return self.nodes.withColumnRenamed("label", "id"), self.edges.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")

    def validate(self) -> PropertyGraph:
        """Raise if a label or an edge repeats, or a label is null; one job."""
        bad = self.nodes.groupBy("label").count().where("count > 1 or label is null").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("label"))
        many = self.edges.groupBy(*KEY).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).withColumn("what", F.lit("edge"))
        found = {r["what"]: r["n"] for r in bad.unionByName(many).collect()}
        if found["label"]:
            raise GraphError(f"{self.name}: {found['label']} labels are null or repeat")
        if found["edge"]:
            raise DuplicateEdgeError(f"{self.name}: {found['edge']} edge rows repeat a (source, type, target)")
        return self


def graph(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, name: str = "graph", on_duplicate_edge: str = "error") -> PropertyGraph:
    """A graph in canonical form.

    Labels and types become strings, a missing or null type the empty one, and edges without
    direction get their smaller end first. Without a node table the nodes are the edges' ends.
    on_duplicate_edge: `first` and `last` keep one row in ingest order; `error` leaves repeats for
    `validate()` to refuse.
    """
    if missing := {"source", "target"} - set(edges.columns):
        raise GraphError(f"edges lack {sorted(missing)}")
    if on_duplicate_edge not in ("error", "first", "last"):
        raise GraphError(f"unknown policy {on_duplicate_edge!r}")
    if taken := {c for c in edges.columns if c in RESERVED - set(KEY)}:
        raise GraphError(f"reserved edge attributes: {sorted(taken)}")
    kind = F.coalesce(F.col("type").cast("string"), F.lit("")) if "type" in edges.columns else F.lit("")
    attributes = [F.col(f"`{c}`") for c in edges.columns if c not in KEY]
    s, t = F.col("source").cast("string"), F.col("target").cast("string")
    if not directed:
        s, t = F.least(s, t), F.greatest(s, t)
    own = edges.select(s.alias("source"), kind.alias("type"), t.alias("target"), *attributes)
    if on_duplicate_edge != "error":
        row = own.withColumn("__row", F.monotonically_increasing_id())
        order = F.col("__row").asc() if on_duplicate_edge == "first" else F.col("__row").desc()
        own = row.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(order))).where("__n = 1").drop("__n", "__row")
    if nodes is None:
        named = endpoints(own).distinct()
    else:
        if "label" not in nodes.columns:
            raise GraphError("nodes lack a label")
        named = nodes.select(F.col("label").cast("string").alias("label"), *[F.col(f"`{c}`") for c in nodes.columns if c != "label"])
    return PropertyGraph(named, own, directed, name, closed=nodes is None)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))
