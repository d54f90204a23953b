"""Many graphs at once: all-pairs tables and timelines over stacked snapshots, each as one relational job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltamesh.model import A_ONLY, B_ONLY, CHANGED, KEY, SHARED, STATUSES, endpoints, is_numeric, ratio
from deltamesh.operators.counts import coefficients
from deltamesh.operators.union import differs

#: One attribute of a stacked element: whether its graph has it, and its value as a number or as its kind and text.
_VALUE = "struct<has:boolean,number:double,text:string>"


def valued(frame: DataFrame, keys: list[str], attributes: list[str] | None = None) -> DataFrame:
    """(keys, values): all other columns, or `attributes` where a list is given, in one struct that frames of different kinds share.

    A frame that has `values` already is returned as it is.
    """
    if "values" in frame.columns and isinstance(frame.schema["values"].dataType, T.StructType):
        return frame.select(*keys, "values")
    own = [c for c in frame.columns if c not in keys]

    def value(c: str) -> Column:
        if c not in own:
            return F.struct(F.lit(False).alias("has"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
        kind, x = frame.schema[c].dataType, F.col(f"`{c}`")
        number = x.cast("double") if is_numeric(kind) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_numeric(kind) else F.concat(F.lit(f"{kind.simpleString()} "), x.cast("string"))
        return F.struct(F.lit(True).alias("has"), number.alias("number"), text.alias("text"))

    names = sorted(own if attributes is None else attributes)
    # a struct needs a field
    return frame.select(*keys, F.struct(F.lit(0).alias("0"), *[value(c).cast(_VALUE).alias(c) for c in names]).alias("values"))


def changed(frame: DataFrame, x: str, y: str) -> Column:
    """Whether two `values` columns differ in an attribute that both graphs have, by the union's own rules."""
    out = F.lit(False)
    for f in frame.schema["values"].dataType.fieldNames():
        if f != "0":
            a, b = F.col(f"{x}.`{f}`"), F.col(f"{y}.`{f}`")
            number = differs(a["number"], b["number"], T.DoubleType(), T.DoubleType(), 1e-9, 0.0)
            out = out | (a["has"] & b["has"] & (number | ~a["text"].eqNullSafe(b["text"])))
    return F.coalesce(out, F.lit(False))


def _stack(graphs: dict, frame: str, key: str, keys: list[str]) -> DataFrame:
    names = sorted({c for g in graphs.values() for c in getattr(g, frame).columns if c not in keys})
    return reduce(DataFrame.unionByName, [valued(getattr(g, frame), keys, names).select(F.lit(n).alias(key), "*") for n, g in graphs.items()])


def stacked(graphs: dict, key: str = "graph_id") -> DataFrame:
    """Edges of several graphs as (graph_id, source, type, target, values)."""
    return _stack(graphs, "edges", key, KEY)


def stacked_labels(graphs: dict, key: str = "graph_id") -> DataFrame:
    """Nodes of several graphs as (graph_id, label, values)."""
    return _stack(graphs, "nodes", key, ["label"])


def stacked_nodes(edges: DataFrame) -> DataFrame:
    return endpoints(edges, "graph_id").distinct()


def _pairs(ids: DataFrame, include_self: bool) -> DataFrame:
    """Unordered pairs of graph ids; the table of ids is tiny."""
    x, y = ids.select(F.col("graph_id").alias("graph_a")), ids.select(F.col("graph_id").alias("graph_b"))
    return x.join(F.broadcast(y), F.col("graph_a") <= F.col("graph_b") if include_self else F.col("graph_a") < F.col("graph_b"))


def all_pairs(edges: DataFrame, nodes: DataFrame | None = None, include_self: bool = False) -> DataFrame:
    """Rows (graph_a, graph_b, scope, metric, value) of set and edit-distance metrics for every pair of stacked graphs.

    Edges are (graph_id, source, type, target) with attributes, nodes (graph_id, label) with
    attributes, or the edges' ends. Elements meet in one self-join per key, which makes a row per
    pair of graphs that have the key; sizes come from one count, unions by inclusion and exclusion.
    Elements of both graphs count as changed where an attribute that both graphs have differs. The
    shared scope counts the edges whose ends both graphs have as nodes.
    """
    edges = valued(edges, ["graph_id", *KEY])
    nodes = valued(stacked_nodes(edges) if nodes is None else nodes, ["graph_id", "label"])
    ids = nodes.select("graph_id").distinct()
    pairs = _pairs(ids, include_self)

    def meets(frame: DataFrame, keys: list[str]) -> DataFrame:
        x, y = frame.alias("x"), frame.alias("y")
        on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col("x.graph_id") <= F.col("y.graph_id") if include_self else F.col("x.graph_id") < F.col("y.graph_id")]
        return x.join(y, on)

    both = ["graph_a", "graph_b"]
    named = [F.col("x.graph_id").alias("graph_a"), F.col("y.graph_id").alias("graph_b")]
    node_sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    node_meet = meets(nodes, ["label"]).groupBy(*named).agg(F.count(F.lit(1)).alias("n_both"), F.count_if(changed(nodes, "x.values", "y.values")).alias("n_changed"))

    def sized(sizes: DataFrame, met: DataFrame) -> DataFrame:
        t = pairs.join(sizes.select(F.col("graph_id").alias("graph_a"), F.col("n").alias("n_a")), "graph_a", "left").join(sizes.select(F.col("graph_id").alias("graph_b"), F.col("n").alias("n_b")), "graph_b", "left")
        return t.join(met, both, "left").na.fill(0)

    edge_meet = meets(edges, KEY).groupBy(*named).agg(F.count(F.lit(1)).alias("n_both"), F.count_if(changed(edges, "x.values", "y.values")).alias("n_changed"))
    untyped = edges.select("graph_id", "source", "target").distinct()
    untyped_meet = meets(untyped, ["source", "target"]).groupBy(*named).agg(F.count(F.lit(1)).alias("n_both"))

    # shared scope: an edge of either graph counts for a pair where the other graph has both ends
    shared_nodes = meets(nodes, ["label"]).select(*named, F.col("x.label").alias("label"))
    sides = []
    for side in ("graph_a", "graph_b"):
        own = edges.withColumnRenamed("graph_id", side)
        ends = own.join(shared_nodes.select(*both, F.col("label").alias("source")), [side, "source"]).join(shared_nodes.select(*both, F.col("label").alias("target")), [*both, "target"])
        sides.append(ends.select(*both, *KEY, F.lit(side == "graph_a").alias("is_a")))
    inner = reduce(DataFrame.unionByName, sides)
    inner_sizes = inner.groupBy(*both).agg(F.count_if("is_a").alias("n_a"), F.count_if(~F.col("is_a")).alias("n_b"))
    inner_pairs = inner.select(*both, "source", "target", "is_a").distinct().groupBy(*both).agg(F.count_if("is_a").alias("n_a"), F.count_if(~F.col("is_a")).alias("n_b"))

    def rows(t: DataFrame, scope: str, what: str) -> DataFrame:
        c = t.select(*both, *coefficients(F.col("n_a"), F.col("n_b"), F.col("n_both")))
        return c.select(*both, F.lit(scope).alias("scope"), F.inline(F.array(*[F.struct(F.lit(f"{m}_{what}").alias("metric"), F.col(m).alias("value")) for m in ("jaccard", "overlap", "dice")])))

    raw_nodes, raw_edges, raw_pairs = sized(node_sizes, node_meet), sized(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), edge_meet), sized(untyped.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), untyped_meet)
    met = pairs.join(node_meet.withColumnRenamed("n_both", "m"), both, "left").na.fill(0)
    shared_n = met.select(*both, F.col("m").alias("n_a"), F.col("m").alias("n_b"), F.col("m").alias("n_both"), "n_changed")
    shared_e = pairs.join(inner_sizes, both, "left").join(edge_meet, both, "left").na.fill(0)
    shared_p = pairs.join(inner_pairs, both, "left").join(untyped_meet, both, "left").na.fill(0)

    def edits(n: DataFrame, e: DataFrame, scope: str) -> DataFrame:
        t = n.select(*both, (F.col("n_a") + F.col("n_b")).alias("nn"), F.col("n_both").alias("nm"), F.col("n_changed").alias("nc")).join(e.select(*both, (F.col("n_a") + F.col("n_b")).alias("ee"), F.col("n_both").alias("em"), "n_changed"), both)
        cost = F.col("nn") - 2 * F.col("nm") + F.col("ee") - 2 * F.col("em") + F.col("n_changed") + F.col("nc")
        worst = F.col("nn") + F.col("ee")
        distance = F.coalesce(F.least(F.lit(1.0), ratio(cost, worst)), F.lit(0.0))
        return t.select(*both, F.lit(scope).alias("scope"), F.inline(F.array(F.struct(F.lit("ged_cost").alias("metric"), cost.cast("double").alias("value")), F.struct(F.lit("ged_normalized_distance").alias("metric"), distance.alias("value")), F.struct(F.lit("ged_similarity").alias("metric"), (1 - distance).alias("value")))))

    parts = [rows(raw_nodes, "raw", "nodes"), rows(raw_pairs, "raw", "edges"), rows(raw_edges, "raw", "typed_edges"), rows(shared_n, "shared", "nodes"), rows(shared_p, "shared", "edges"), rows(shared_e, "shared", "typed_edges"), edits(raw_nodes, raw_edges, "raw"), edits(shared_n, shared_e, "shared")]
    return reduce(DataFrame.unionByName, parts)


def tidy(pairs: DataFrame) -> DataFrame:
    """(graph_a, graph_b, metric, raw_score, shared_subgraph_score)."""
    pick = lambda s: F.max(F.when(F.col("scope") == s, F.col("value")))
    return pairs.groupBy("graph_a", "graph_b", "metric").agg(pick("raw").alias("raw_score"), pick("shared").alias("shared_subgraph_score"))


def _steps(stack: DataFrame, keys: list[str]) -> DataFrame:
    """(step, keys, status) of all steps idx -> idx + 1 of a stack (idx, keys, attributes), in one join."""
    own = valued(stack, ["idx", *keys])
    top = own.agg(F.max("idx").alias("top"), F.min("idx").alias("low"))
    a = own.select(F.col("idx").alias("step"), *keys, F.col("values").alias("av"), F.lit(True).alias("__a"))
    b = own.select((F.col("idx") - 1).alias("step"), *keys, F.col("values").alias("bv"), F.lit(True).alias("__b"))
    j = a.join(b, ["step", *keys], "full_outer").crossJoin(F.broadcast(top)).where("step >= low and step < top")  # one row
    status = F.when(F.col("__b").isNull(), A_ONLY).when(F.col("__a").isNull(), B_ONLY).when(changed(own, "av", "bv"), CHANGED).otherwise(SHARED)
    return j.select("step", *keys, status.alias("status"))


def step_edges(snapshots: DataFrame) -> DataFrame:
    """(step, source, type, target, status) of all steps of stacked snapshots (idx, source, type, target, attributes)."""
    return _steps(snapshots, KEY)


def step_nodes(snapshots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(step, label, status) of all steps; nodes (idx, label, attributes), or the edges' ends."""
    return _steps(endpoints(snapshots, "idx").distinct() if nodes is None else nodes, ["label"])


def churn(snapshots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per step: nodes and edges removed and added, edges altered in any attribute, and the edit similarity."""
    s = F.col("status")
    count = lambda prefix: [F.count_if(s == x).alias(f"{prefix}_{x}") for x in STATUSES]
    n, e = step_nodes(snapshots, nodes).groupBy("step").agg(*count("n")), step_edges(snapshots).groupBy("step").agg(*count("e"))
    t = n.join(e, "step", "full_outer").na.fill(0)
    c = F.col
    cost = c("n_A_ONLY") + c("n_B_ONLY") + c("e_A_ONLY") + c("e_B_ONLY") + c("e_CHANGED") + c("n_CHANGED")
    worst = cost - c("e_CHANGED") - c("n_CHANGED") + 2 * (c("n_SHARED") + c("n_CHANGED") + c("e_SHARED") + c("e_CHANGED"))
    return t.select("step", c("n_A_ONLY").alias("nodes_removed"), c("n_B_ONLY").alias("nodes_added"), c("e_A_ONLY").alias("edges_removed"), c("e_B_ONLY").alias("edges_added"), c("e_CHANGED").alias("edges_reweighted"), (1 - F.coalesce(F.least(F.lit(1.0), ratio(cost, worst)), F.lit(0.0))).alias("similarity"))


def presence(snapshots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(label, pattern): one character per snapshot, 1 where the label is present; nodes (idx, label), or the edges' ends."""
    seen = endpoints(snapshots, "idx") if nodes is None else nodes
    span = seen.agg(F.min("idx").alias("low"), F.max("idx").alias("top"))
    seen = seen.groupBy("label").agg(F.collect_set("idx").alias("at")).crossJoin(F.broadcast(span))  # one row
    bits = F.transform(F.sequence("low", "top"), lambda i: F.when(F.array_contains("at", i), "1").otherwise("0"))
    return seen.select("label", F.array_join(bits, "").alias("pattern"))


def flickers(present: DataFrame) -> DataFrame:
    """(label, pattern, transitions) of labels whose presence changes at least twice."""
    turns = F.length("pattern") - 1 - F.size(F.filter(F.sequence(F.lit(1), F.length("pattern") - 1), lambda i: F.substring("pattern", i, F.lit(1)) == F.substring("pattern", i + 1, F.lit(1))))
    return present.where(F.length("pattern") > 1).withColumn("transitions", turns).where("transitions >= 2")


def node_history(scored: DataFrame, most: int = 50) -> DataFrame:
    """(label, step, significance) zero-filled over steps, for the labels with the highest totals among each step's best."""
    top = Window.partitionBy("step").orderBy(F.col("significance").desc(), F.col("label").asc())
    best = scored.where("significance > 0").withColumn("place", F.row_number().over(top)).where(F.col("place") <= most)
    total = best.groupBy("label").agg(F.sum("significance").alias("total")).orderBy(F.col("total").desc(), "label").limit(most)
    steps = scored.select("step").distinct()
    grid = total.select("label").join(F.broadcast(steps))  # the steps are a handful
    return grid.join(best.select("label", "step", "significance"), ["label", "step"], "left").na.fill(0.0)


def recurrent(scored: DataFrame, min_steps: int, most: int = 50) -> DataFrame:
    """(label, steps, total) of labels among the `most` best of at least min_steps steps."""
    top = Window.partitionBy("step").orderBy(F.col("significance").desc(), F.col("label").asc())
    best = scored.where("significance > 0").withColumn("place", F.row_number().over(top)).where(F.col("place") <= most)
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("steps"), F.sum("significance").alias("total")).where(F.col("steps") >= min_steps)


def trend(steps: DataFrame) -> DataFrame:
    """One row: number of steps, least-squares slope of similarity, largest step's share of adds and removes, drift's variation."""
    size = F.col("nodes_removed") + F.col("nodes_added") + F.col("edges_removed") + F.col("edges_added")
    t = steps.withColumn("size", size)
    return t.agg(F.count(F.lit(1)).alias("n_steps"), F.regr_slope("similarity", F.col("step").cast("double")).alias("slope"), F.coalesce(ratio(F.max("size"), F.sum("size")), F.lit(0.0)).alias("top_share"), F.max_by("step", F.struct("size", -F.col("step"))).alias("top_step"), F.coalesce(F.try_divide(F.stddev_samp("size"), F.avg("size")), F.lit(0.0)).alias("cv"))
