"""Graphs derived from the base tables, as DataFrames and as the SQL that defines the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltamesh.model import PropertyGraph, graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _halves(rows: DataFrame, first, weight, nodes=None, directed: bool = True) -> tuple[PropertyGraph, PropertyGraph]:
    out = []
    for name, own in (("a", rows.where(first)), ("b", rows.where(~first))):
        edges = own.groupBy("source", "type", "target").agg(weight.cast("long").alias("weight"))
        out.append(graph(edges, nodes(own) if nodes else None, directed=directed, name=name))
    return out[0], out[1]


def _whole(rows: DataFrame, weight, directed: bool = True) -> PropertyGraph:
    return graph(rows.groupBy("source", "type", "target").agg(weight.cast("long").alias("weight")), directed=directed, name="all")


def _before(column: str, day: str):
    return F.col(column) < F.expr(f"timestamp_ntz '{day} 00:00:00'")


def trade(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, PropertyGraph]:
    """Suppliers to customers' nations by return flag, quantity as weight; two halves of the orders."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    rows = joined.select(F.concat(F.lit("S#"), "l_suppkey").alias("source"), F.col("l_returnflag").alias("type"), F.concat(F.lit("N#"), "c_nationkey").alias("target"), "l_quantity", "o_orderdate")
    return _halves(rows, _before("o_orderdate", "1998-04-15"), F.sum("l_quantity"))


def priority(spark: SparkSession, sf_dir: str, attributes: bool = False) -> tuple[PropertyGraph, PropertyGraph]:
    """Customers to order priorities by status, number of orders as weight; two halves of the orders."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("C#"), "o_custkey").alias("source"), F.col("o_orderstatus").alias("type"), F.concat(F.lit("P#"), "o_orderpriority").alias("target"), "o_orderdate")
    if not attributes:
        return _halves(rows, _before("o_orderdate", "1998-04-15"), F.count(F.lit(1)))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C#"), "c_custkey").alias("label"), "c_mktsegment")

    def nodes(own: DataFrame) -> DataFrame:
        buyers = own.groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n_orders")).join(c, "label", "left")
        return buyers.unionByName(own.select(F.col("target").alias("label")).distinct(), allowMissingColumns=True)

    return _halves(rows, _before("o_orderdate", "1998-04-15"), F.count(F.lit(1)), nodes)


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.concat(F.lit("C#"), "o_custkey").alias("source"), F.col("l_returnflag").alias("type"), F.concat(F.lit("S#"), "l_suppkey").alias("target"), "l_quantity", "o_orderdate")


def purchase(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, PropertyGraph]:
    """Customers to suppliers by return flag, quantity as weight; two halves of the orders."""
    return _halves(_purchases(spark, sf_dir), _before("o_orderdate", "1998-04-15"), F.sum("l_quantity"))


def purchase_whole(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The same of all orders, as one graph."""
    return _whole(_purchases(spark, sf_dir), F.sum("l_quantity"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("U#"), "user_id").alias("u"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", _before("ts", "2024-01-16").alias("first")).distinct()


def _shared(cells: DataFrame) -> DataFrame:
    x, y = cells.alias("x"), cells.alias("y")
    keys = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("day", "k", "event_type", "first")]
    return x.join(y, keys).where("x.u < y.u").select(F.col("x.u").alias("source"), F.col("x.event_type").alias("type"), F.col("y.u").alias("target"), F.col("x.first").alias("first"))


def _with_cells(g: PropertyGraph, cells: DataFrame) -> PropertyGraph:
    """The graph with its cells, and its nodes from them: the members of cells of two or more."""
    keys = ["day", "k", "event_type", "first"]
    own = cells.dropna().select(F.col("u").alias("label"), F.struct(*keys).alias("cell"), F.col("event_type").alias("type"))
    many = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return replace(g, nodes=own.join(many, "cell", "left_semi").select("label").distinct(), cells=own)


def co_events(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, PropertyGraph]:
    """Users who share a day, key and event type, without direction; two halves of the month."""
    cells = _cells(spark, sf_dir)
    a, b = _halves(_shared(cells), F.col("first"), F.count(F.lit(1)), directed=False)
    return _with_cells(a, cells.where("first")), _with_cells(b, cells.where("not first"))


def co_events_whole(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The same of the whole month, as one graph."""
    cells = _cells(spark, sf_dir)
    return _with_cells(_whole(_shared(cells), F.count(F.lit(1)), directed=False), cells)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots (idx, source, type, target, weight): users to their key bands by event type, six days each."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = e.select(F.floor(day / 6).cast("int").alias("idx"), F.concat(F.lit("U#"), "user_id").alias("source"), F.col("event_type").alias("type"), F.concat(F.lit("U#"), "user_id", F.lit("-b"), F.floor(F.get_json_object("props", "$.k").cast("int") / 20).cast("string")).alias("target"))
    return rows.groupBy("idx", "source", "type", "target").agg(F.count(F.lit(1)).alias("weight"))


def activity_attributes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same snapshots with a second edge attribute, the highest key, and nodes (idx, label, n_events)."""
    e = table(spark, sf_dir, "events")
    day, k = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")), F.get_json_object("props", "$.k").cast("int")
    rows = e.select(F.floor(day / 6).cast("int").alias("idx"), F.concat(F.lit("U#"), "user_id").alias("source"), F.col("event_type").alias("type"), F.concat(F.lit("U#"), "user_id", F.lit("-b"), F.floor(k / 20).cast("string")).alias("target"), k.alias("k"))
    edges = rows.groupBy("idx", "source", "type", "target").agg(F.count(F.lit(1)).alias("weight"), F.max("k").alias("top_k"))
    return edges, edges.select("idx", F.explode(F.array("source", "target")).alias("label"), "weight").groupBy("idx", "label").agg(F.sum("weight").alias("n_events"))


def renamed_parts(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, PropertyGraph]:
    """Suppliers to the parts they sold; B has three of eight part labels rewritten lightly and one with a typo."""
    p = table(spark, sf_dir, "part")
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 8
    new = F.when(kind == 0, F.upper(label)).when(kind == 1, F.concat(label, F.lit(" Inc."))).when(kind == 2, F.replace(label, F.lit(" "), F.lit("-"))).when(kind == 3, F.concat(F.substring(label, 1, 2), F.lit("x"), F.expr("substring(concat_ws(' ', p_name, p_brand, p_type, cast(p_partkey as string)), 4)"))).otherwise(label)
    names = p.select("p_partkey", label.alias("old"), new.alias("new"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S#"), "l_suppkey").alias("source"), "l_partkey").distinct().join(names, F.col("l_partkey") == F.col("p_partkey"))
    out = []
    for name, column in (("a", "old"), ("b", "new")):
        out.append(graph(rows.select("source", F.lit("supplies").alias("type"), F.col(column).alias("target"), F.lit(1).cast("long").alias("weight")), name=name))
    return out[0], out[1]


_DAY = "TIMESTAMP '1998-04-15'"
#: Edge tables ae and be (source, type, target, weight) of each pair.
SQL = {
    "trade": f"""f AS (SELECT 'S#' || l_suppkey AS source, l_returnflag AS type, 'N#' || c_nationkey AS target, l_quantity AS q, o_orderdate < {_DAY} AS h
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    ae AS (SELECT source, type, target, sum(q)::BIGINT AS weight FROM f WHERE h GROUP BY ALL), be AS (SELECT source, type, target, sum(q)::BIGINT AS weight FROM f WHERE NOT h GROUP BY ALL)""",
    "priority": f"""f AS (SELECT 'C#' || o_custkey AS source, o_orderstatus AS type, 'P#' || o_orderpriority AS target, o_orderdate < {_DAY} AS h FROM orders),
    ae AS (SELECT source, type, target, count(*)::BIGINT AS weight FROM f WHERE h GROUP BY ALL), be AS (SELECT source, type, target, count(*)::BIGINT AS weight FROM f WHERE NOT h GROUP BY ALL)""",
    "purchase": f"""f AS (SELECT 'C#' || o_custkey AS source, l_returnflag AS type, 'S#' || l_suppkey AS target, l_quantity AS q, o_orderdate < {_DAY} AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ae AS (SELECT source, type, target, sum(q)::BIGINT AS weight FROM f WHERE h GROUP BY ALL), be AS (SELECT source, type, target, sum(q)::BIGINT AS weight FROM f WHERE NOT h GROUP BY ALL)""",
    "co_events": """cells AS (SELECT DISTINCT 'U#' || user_id AS u, ts::DATE AS day, (props->>'k')::INT AS k, event_type, ts < TIMESTAMP '2024-01-16' AS h FROM events),
    f AS (SELECT x.u AS source, x.event_type AS type, y.u AS target, x.h FROM cells x JOIN cells y ON x.day = y.day AND x.k = y.k AND x.event_type = y.event_type AND x.h = y.h AND x.u < y.u),
    ae AS (SELECT source, type, target, count(*)::BIGINT AS weight FROM f WHERE h GROUP BY ALL), be AS (SELECT source, type, target, count(*)::BIGINT AS weight FROM f WHERE NOT h GROUP BY ALL)""",
    "renamed_parts": """p AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_partkey AS old FROM part),
    n AS (SELECT p_partkey, old, CASE p_partkey % 8 WHEN 0 THEN upper(old) WHEN 1 THEN old || ' Inc.' WHEN 2 THEN replace(old, ' ', '-') WHEN 3 THEN substr(old, 1, 2) || 'x' || substr(old, 4) ELSE old END AS new FROM p),
    f AS (SELECT DISTINCT 'S#' || l_suppkey AS source, l_partkey FROM lineitem),
    ae AS (SELECT source, 'supplies' AS type, old AS target, 1::BIGINT AS weight FROM f JOIN n ON l_partkey = p_partkey), be AS (SELECT source, 'supplies' AS type, new AS target, 1::BIGINT AS weight FROM f JOIN n ON l_partkey = p_partkey)""",
}
#: Nodes an, bn, union nodes un and union edges ue, with scope flags.
UNION_SQL = """an AS (SELECT source AS label FROM ae UNION SELECT target FROM ae), bn AS (SELECT source AS label FROM be UNION SELECT target FROM be),
    un AS (SELECT coalesce(an.label, bn.label) AS label, CASE WHEN bn.label IS NULL THEN 'A_ONLY' WHEN an.label IS NULL THEN 'B_ONLY' ELSE 'SHARED' END AS status FROM an FULL JOIN bn ON an.label = bn.label),
    ue0 AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.type, b.type) AS type, coalesce(a.target, b.target) AS target, a.weight AS aw, b.weight AS bw,
      CASE WHEN b.source IS NULL THEN 'A_ONLY' WHEN a.source IS NULL THEN 'B_ONLY' WHEN a.weight = b.weight THEN 'SHARED' ELSE 'CHANGED' END AS status
      FROM ae a FULL JOIN be b ON a.source = b.source AND a.type = b.type AND a.target = b.target),
    sn AS (SELECT label FROM un WHERE status = 'SHARED'),
    ue AS (SELECT *, source IN (SELECT label FROM sn) AND target IN (SELECT label FROM sn) AS in_shared FROM ue0)"""
ACTIVITY_SQL = """s AS (SELECT ((ts::DATE - DATE '2024-01-01') // 6)::INT AS idx, 'U#' || user_id AS source, event_type AS type, 'U#' || user_id || '-b' || ((props->>'k')::INT // 20) AS target, count(*)::BIGINT AS weight FROM events GROUP BY ALL)"""
ATTRIBUTES_SQL = """s2 AS (SELECT ((ts::DATE - DATE '2024-01-01') // 6)::INT AS idx, 'U#' || user_id AS source, event_type AS type, 'U#' || user_id || '-b' || ((props->>'k')::INT // 20) AS target, count(*)::BIGINT AS weight, max((props->>'k')::INT) AS top_k FROM events GROUP BY ALL),
    n2 AS (SELECT idx, label, sum(weight) AS n_events FROM (SELECT idx, source AS label, weight FROM s2 UNION ALL SELECT idx, target, weight FROM s2) GROUP BY ALL)"""


def with_union(name: str) -> str:
    return f"WITH {SQL[name]}, {UNION_SQL}"


def with_whole(name: str) -> str:
    """The pair's rows as one graph: edges ae, nodes an."""
    edges = SQL[name].replace("FROM f WHERE h GROUP BY ALL", "FROM f GROUP BY ALL").split(", be AS (")[0]
    return f"WITH {edges}, an AS (SELECT source AS label FROM ae UNION SELECT target FROM ae)"
