"""The registered queries of the graph engine and the SQL that defines each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltamesh.functions.stats import surprise
from deltamesh.functions.text import normalized
from deltamesh.model import DIFFERING, KEY, PropertyGraph, graph
from deltamesh.operators import align as al
from deltamesh.operators import cluster, counts, significance, structure, views
from deltamesh.operators.union import UnionDiff, build_union
from deltamesh.plans import fixtures as fx
from deltamesh.plans import series

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def diff(pair: tuple[PropertyGraph, PropertyGraph]) -> UnionDiff:
    return build_union(*pair)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that two engines' sums agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-priority relationships by type and status between the two halves of the orders."""
    return diff(fx.priority(spark, sf_dir)).edges.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


_P, _F4, _F1, _F3 = (fx.with_union(n) for n in ("priority", "co_events", "trade", "purchase"))
_W4, _W3 = (fx.with_whole(n) for n in ("co_events", "purchase"))
_COEF = """n_a + n_b - n_both AS n_union, round(CASE WHEN n_a + n_b - n_both = 0 THEN 1 ELSE n_both / (n_a + n_b - n_both) END, 6) AS jaccard,
 round(CASE WHEN n_a + n_b - n_both = 0 THEN 1 WHEN least(n_a, n_b) = 0 THEN 0 ELSE n_both / least(n_a, n_b) END, 6) AS overlap,
 round(CASE WHEN n_a + n_b = 0 THEN 1 ELSE 2 * n_both / (n_a + n_b) END, 6) AS dice"""
_SIZES = "count(*) FILTER (status <> 'B_ONLY') AS n_a, count(*) FILTER (status <> 'A_ONLY') AS n_b, count(*) FILTER (status IN ('SHARED', 'CHANGED')) AS n_both"
_SCOPED = "sc AS (SELECT 'raw' AS scope, * FROM ue UNION ALL SELECT 'shared', * FROM ue WHERE in_shared)"


@query(f"{_P} SELECT type, status, count(*) AS n FROM ue GROUP BY ALL")
def union_edge_status(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"{_P} SELECT source, type, target, status, aw AS a_weight, bw AS b_weight, in_shared FROM ue")
def union_edges_full(spark, sf_dir):
    return diff(fx.priority(spark, sf_dir)).scoped_edges().drop("changed_attrs")


_NODES = """x AS (SELECT f.*, c_mktsegment AS seg FROM f LEFT JOIN customer ON f.source = 'C#' || c_custkey),
 na AS (SELECT source AS label, count(*) AS n, any_value(seg) AS seg FROM x WHERE h GROUP BY 1 UNION ALL SELECT DISTINCT target, NULL, NULL FROM x WHERE h),
 nb AS (SELECT source AS label, count(*) AS n, any_value(seg) AS seg FROM x WHERE NOT h GROUP BY 1 UNION ALL SELECT DISTINCT target, NULL, NULL FROM x WHERE NOT h),
 nu AS (SELECT coalesce(na.label, nb.label) AS label, na.n AS an, nb.n AS bn, na.seg AS aseg, nb.seg AS bseg,
   CASE WHEN nb.label IS NULL THEN 'A_ONLY' WHEN na.label IS NULL THEN 'B_ONLY' WHEN na.n IS NOT DISTINCT FROM nb.n AND na.seg IS NOT DISTINCT FROM nb.seg THEN 'SHARED' ELSE 'CHANGED' END AS status
   FROM na FULL JOIN nb ON na.label = nb.label)"""


@query(f"WITH {fx.SQL['priority']}, {_NODES} SELECT label, status, an AS a_n_orders, bn AS b_n_orders, aseg AS a_c_mktsegment, bseg AS b_c_mktsegment FROM nu")
def union_node_status(spark, sf_dir):
    return diff(fx.priority(spark, sf_dir, attributes=True)).nodes.drop("changed_attrs")


@query(f"WITH {fx.SQL['priority']}, {_NODES} SELECT label, 'n_orders' AS attr, an::VARCHAR AS a, bn::VARCHAR AS b FROM nu WHERE status = 'CHANGED' AND an IS DISTINCT FROM bn")
def changed_attrs_long(spark, sf_dir):
    return diff(fx.priority(spark, sf_dir, attributes=True)).changed_long("nodes")


@query(f"{_P} SELECT s.status, count(ue.status) AS n FROM (VALUES ('SHARED'), ('CHANGED'), ('A_ONLY'), ('B_ONLY')) s(status) LEFT JOIN ue ON ue.status = s.status GROUP BY ALL")
def status_counts(spark, sf_dir):
    return diff(fx.priority(spark, sf_dir)).status_counts()


@query(f"{_P}, t AS (SELECT {_SIZES} FROM un), z AS (SELECT 'raw' AS scope, n_a, n_b, n_both FROM t UNION ALL SELECT 'shared', n_both, n_both, n_both FROM t) SELECT scope, n_a, n_b, n_both, {_COEF} FROM z")
def set_scores_nodes(spark, sf_dir):
    return rounded(counts.node_overlap(diff(fx.priority(spark, sf_dir))))


@query(f"{_P}, {_SCOPED}, t AS (SELECT scope, {_SIZES} FROM sc GROUP BY scope) SELECT scope, n_a, n_b, n_both, {_COEF} FROM t")
def set_scores_edges_typed(spark, sf_dir):
    return rounded(counts.typed_edge_overlap(diff(fx.priority(spark, sf_dir))))


@query(f"{_P}, {_SCOPED}, p AS (SELECT scope, source, target, bool_or(status <> 'B_ONLY') AS a, bool_or(status <> 'A_ONLY') AS b FROM sc GROUP BY ALL), t AS (SELECT scope, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both FROM p GROUP BY scope) SELECT scope, n_a, n_b, n_both, {_COEF} FROM t")
def set_scores_edges_untyped(spark, sf_dir):
    return rounded(counts.untyped_edge_overlap(diff(fx.priority(spark, sf_dir))))


@query(f"{_P}, {_SCOPED}, t AS (SELECT scope, type, {_SIZES} FROM sc GROUP BY scope, type) SELECT scope, type, n_a, n_b, n_both, {_COEF} FROM t")
def set_scores_per_type(spark, sf_dir):
    return rounded(counts.per_type_overlap(diff(fx.priority(spark, sf_dir))))


def _ged_sql(factor: str) -> str:
    return f"""{_P}, {_SCOPED},
 x AS (SELECT scope, {factor} * (status <> 'SHARED')::INT AS cost, {factor} * ((status <> 'B_ONLY')::INT + (status <> 'A_ONLY')::INT) AS worst FROM sc
   UNION ALL SELECT 'raw', (status <> 'SHARED')::INT, (status <> 'B_ONLY')::INT + (status <> 'A_ONLY')::INT FROM un UNION ALL SELECT 'shared', 0, 2 FROM un WHERE status = 'SHARED')
 SELECT scope, round(sum(cost)::DOUBLE, 6) AS cost, round(sum(worst)::DOUBLE, 6) AS worst, round(least(1, sum(cost) / sum(worst)), 6) AS distance, round(1 - least(1, sum(cost) / sum(worst)), 6) AS similarity FROM x GROUP BY scope"""


@query(_ged_sql("1"))
def ged_unit(spark, sf_dir):
    return rounded(counts.edit_distance(diff(fx.priority(spark, sf_dir))))


@query(_ged_sql("CASE type WHEN 'F' THEN 10 WHEN 'O' THEN 2 ELSE 0.5 END"))
def ged_typed_costs(spark, sf_dir):
    return rounded(counts.edit_distance(diff(fx.priority(spark, sf_dir)), counts.EditCosts(type_factors={"F": 10, "O": 2}, other_types=0.5)))


@query(f"""{_F1}, xy AS (SELECT aw::DOUBLE AS x, bw::DOUBLE AS y FROM ue WHERE status IN ('SHARED', 'CHANGED')),
 r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM xy)
 SELECT count(*) AS n_compared, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson, round(avg(abs(x - y)), 6) AS mean_abs_diff FROM r""")
def weight_agreement(spark, sf_dir):
    return rounded(counts.weight_agreement(diff(fx.trade(spark, sf_dir))))


def _delta_sql(base: str, direction: str) -> str:
    side = {"out": "SELECT source AS l, target AS m FROM {0}", "in": "SELECT target AS l, source AS m FROM {0}", "both": "SELECT source AS l, target AS m FROM {0} UNION SELECT target, source FROM {0}"}[direction]
    return f"""{base}, pa AS (SELECT DISTINCT l, m FROM ({side.format('ae')})), pb AS (SELECT DISTINCT l, m FROM ({side.format('be')})),
 j AS (SELECT coalesce(pa.l, pb.l) AS l, pa.l IS NOT NULL AS a, pb.l IS NOT NULL AS b FROM pa FULL JOIN pb ON pa.l = pb.l AND pa.m = pb.m),
 c AS (SELECT l, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS ns FROM j GROUP BY l),
 d AS (SELECT label, coalesce(na, 0) AS n_neighbors_a, coalesce(nb, 0) AS n_neighbors_b, coalesce(ns, 0) AS n_shared, coalesce(nb - ns, 0) AS n_added, coalesce(na - ns, 0) AS n_removed,
   round(CASE WHEN coalesce(na + nb - ns, 0) = 0 THEN 1 ELSE ns / (na + nb - ns) END, 6) AS jaccard FROM sn LEFT JOIN c ON label = l)"""


@query(_delta_sql(_P, "both") + " SELECT * FROM d")
def neighborhood_delta_both(spark, sf_dir):
    return rounded(counts.neighborhood_delta(diff(fx.priority(spark, sf_dir))))


@query(_delta_sql(_P, "out") + " SELECT * FROM d")
def neighborhood_delta_out(spark, sf_dir):
    return rounded(counts.neighborhood_delta(diff(fx.priority(spark, sf_dir)), "out"))


@query(_delta_sql(_P, "in") + " SELECT * FROM d")
def neighborhood_delta_in(spark, sf_dir):
    return rounded(counts.neighborhood_delta(diff(fx.priority(spark, sf_dir)), "in"))


@query(_delta_sql(_F3, "both") + " SELECT * FROM d ORDER BY jaccard, n_added DESC, n_removed DESC, label LIMIT 20")
def neighborhood_top(spark, sf_dir):
    return counts.most_changed(rounded(counts.neighborhood_delta(diff(fx.purchase(spark, sf_dir)))), 20)


@query(_delta_sql(_F3, "both") + " SELECT count(*) AS n_nodes, round(avg(jaccard), 4) AS mean_jaccard, round(median(jaccard), 4) AS median_jaccard, count(*) FILTER (jaccard = 1) AS n_unchanged FROM d")
def neighborhood_summary(spark, sf_dir):
    return rounded(counts.neighborhood_summary(rounded(counts.neighborhood_delta(diff(fx.purchase(spark, sf_dir))))), 4)


_DEGREES = "dg AS (SELECT label, count(e.l) AS degree FROM an LEFT JOIN (SELECT source AS l FROM ae UNION ALL SELECT target FROM ae) e ON label = e.l GROUP BY label)"


@query(f"{_W3}, {_DEGREES} SELECT label, degree FROM dg")
def degrees(spark, sf_dir):
    return fx.purchase_whole(spark, sf_dir).degrees()


@query(f'{_W3}, {_DEGREES} SELECT min(degree) AS "min", max(degree) AS "max", round(avg(degree), 6) AS mean, round(median(degree), 6) AS median, round(stddev_pop(degree), 6) AS std FROM dg')
def degree_stats(spark, sf_dir):
    return rounded(fx.purchase_whole(spark, sf_dir).degree_stats())


@query(f"{_W3}, {_DEGREES} SELECT degree, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM dg WHERE degree > 0 GROUP BY degree")
def degree_histogram(spark, sf_dir):
    return rounded(views.degree_histogram(fx.purchase_whole(spark, sf_dir)))


@query(f"{_W4} SELECT (SELECT count(*) FROM an) AS n_nodes, (SELECT count(*) FROM ae) AS n_edges, (SELECT count(DISTINCT type) FROM ae) AS n_types, round((SELECT count(*) FROM ae) / ((SELECT count(*) FROM an) * ((SELECT count(*) FROM an) - 1) / 2), 6) AS density")
def inspect_graph(spark, sf_dir):
    g = fx.co_events_whole(spark, sf_dir)
    n, m = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")), g.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("type").alias("n_types"))
    return rounded(n.crossJoin(m).withColumn("density", F.try_divide("n_edges", F.col("n_nodes") * (F.col("n_nodes") - 1) / 2)))  # two single rows


@query(f"{_P} SELECT source, type, target, weight FROM ae WHERE source IN (SELECT label FROM sn) AND target IN (SELECT label FROM sn)")
def induced_subgraph(spark, sf_dir):
    u = diff(fx.priority(spark, sf_dir))
    return u.a.induced(u.shared_labels()).edges


@query("SELECT least(s, t) AS source, event_type AS type, greatest(s, t) AS target, count(*) AS n FROM (SELECT 'U#' || user_id AS s, 'U#' || (props->>'k') AS t, event_type FROM events) GROUP BY ALL")
def undirected_canonical(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("U#"), "user_id").alias("source"), F.col("event_type").alias("type"), F.concat(F.lit("U#"), F.get_json_object("props", "$.k")).alias("target"))
    return graph(e, directed=False).edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'C#' || o_custkey AS source, o_orderstatus AS type, 'P#' || o_orderpriority AS target, count(*) AS n_rows FROM orders GROUP BY ALL")
def dedupe_edges(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("C#"), "o_custkey").alias("source"), F.col("o_orderstatus").alias("type"), F.concat(F.lit("P#"), "o_orderpriority").alias("target"))
    once = graph(o, on_duplicate_edge="first").edges
    return once.join(o.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows")), KEY)


_INCIDENT = """ic AS (SELECT label, un.status, count(*) FILTER (e.status = 'SHARED') AS n_shared, count(*) FILTER (e.status = 'CHANGED') AS n_changed, count(*) FILTER (e.status = 'A_ONLY') AS n_removed, count(*) FILTER (e.status = 'B_ONLY') AS n_added
 FROM un LEFT JOIN (SELECT source AS l, status FROM ue UNION ALL SELECT target, status FROM ue) e ON label = e.l GROUP BY ALL)"""


@query(f"{_P}, {_INCIDENT} SELECT * FROM ic")
def incident_counts(spark, sf_dir):
    return counts.incident_counts(diff(fx.priority(spark, sf_dir)))


_RATES = """rt AS (SELECT count(*) FILTER (status = 'A_ONLY') AS removed, count(*) FILTER (status = 'B_ONLY') AS added, count(*) FILTER (status = 'CHANGED') AS changed, count(*) FILTER (status <> 'B_ONLY') AS edges_a,
 count(*) FILTER (status <> 'A_ONLY') AS edges_b, count(*) FILTER (status IN ('SHARED', 'CHANGED')) AS edges_both FROM ue)"""


@query(f"{_P}, {_RATES} SELECT *, round(removed / edges_a, 6) AS removal, round(added / edges_b, 6) AS addition, round(changed / edges_both, 6) AS reweight FROM rt")
def background_rates(spark, sf_dir):
    return rounded(counts.background_rates(diff(fx.priority(spark, sf_dir))))




def _tail(k: str, n: str, tk: str, tn: str) -> str:
    p = f"least(greatest((greatest({tk} - {k}, 0) + 0.5) / (greatest({tn} - {n}, 0) + 1.0), 1e-9), 1 - 1e-9)"
    return f"CASE WHEN {k} = 0 OR {n} = 0 THEN 0 ELSE least(300, -log10(greatest(list_sum(list_transform(range({k}, {n} + 1), lambda j: exp(lgamma({n} + 1.0) - lgamma(j + 1.0) - lgamma({n} - j + 1.0) + j * ln({p}) + ({n} - j) * ln(1 - {p})))), 1e-300))) END"


_SURPRISE = f"""{_INCIDENT}, {_RATES}, cs AS (SELECT *, n_shared + n_changed + n_removed AS degree_a, n_shared + n_changed + n_added AS degree_b, n_shared + n_changed AS nb FROM ic, rt),
 su AS (SELECT label, status, n_removed, n_added, n_changed, degree_a, degree_b, {_tail('n_removed', 'degree_a', 'removed', 'edges_a')} AS s1, {_tail('n_added', 'degree_b', 'added', 'edges_b')} AS s2, {_tail('n_changed', 'nb', 'changed', 'edges_both')} AS s3, (n_removed + n_added + 0.5 * n_changed)::DOUBLE AS magnitude FROM cs)"""


@query(f"{_P}, {_SURPRISE} SELECT label, status, round(CASE WHEN magnitude > 0 THEN (1 + s1 + s2 + s3) * log2(2 + magnitude) ELSE 0 END, 4) AS significance, round(s1 + s2 + s3, 4) AS surprise, round(magnitude, 4) AS magnitude, round(s1, 4) AS surprise_removed, round(s2, 4) AS surprise_added, round(s3, 4) AS surprise_changed, n_removed, n_added, n_changed, degree_a, degree_b FROM su")
def significance_scores(spark, sf_dir):
    return rounded(significance.surprises(diff(fx.priority(spark, sf_dir))), 4)


def _pagerank_sql(steps: int) -> str:
    parts = [f"{_W4}, adj AS (SELECT DISTINCT u, v FROM (SELECT source AS u, target AS v FROM ae UNION ALL SELECT target, source FROM ae) WHERE u <> v), dg AS (SELECT label AS u, (SELECT count(*) FROM adj WHERE adj.u = an.label) AS d, (SELECT count(*) FROM an) AS n FROM an), r0 AS (SELECT u, d, n, 1.0::DOUBLE / n AS r FROM dg)"]
    for i in range(1, steps + 1):
        parts.append(f"r{i} AS (SELECT x.u, x.d, x.n, 0.15 / x.n + 0.85 * (coalesce(s.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE d = 0) / x.n) AS r FROM dg x LEFT JOIN (SELECT v AS u, sum(r / d) AS s FROM adj JOIN r{i - 1} y ON adj.u = y.u GROUP BY v) s ON x.u = s.u)")
    return ", ".join(parts) + f" SELECT u AS label, round(r, 8) AS pagerank FROM r{steps}"


@query(_pagerank_sql(8))
def pagerank_fixed(spark, sf_dir):
    return rounded(significance.pagerank_steps(fx.co_events_whole(spark, sf_dir), 8), 8)


@query()
def significance_rank(spark, sf_dir):
    u = diff(fx.priority(spark, sf_dir))
    return significance.node_significance(u, counts.neighborhood_delta(u))


_ADJ = "adj AS (SELECT DISTINCT u, v FROM (SELECT source AS u, target AS v FROM {0} UNION ALL SELECT target, source FROM {0}) WHERE u <> v)"


@query(f"{_W4}, {_ADJ.format('ae')}, t AS (SELECT a.u, count(*) / 2 AS t FROM adj a JOIN adj b ON a.v = b.u JOIN adj c ON b.v = c.u AND c.v = a.u GROUP BY a.u) SELECT u, t::BIGINT AS triangles FROM t")
def triangles(spark, sf_dir):
    return structure.triangles_of(fx.co_events_whole(spark, sf_dir))


@query(f"{_W3}, {_ADJ.format('ae')}, far AS (SELECT DISTINCT a.u, b.v FROM adj a JOIN adj b ON a.v = b.u WHERE a.u <> b.v) SELECT u, count(*) AS two_hop FROM (SELECT * FROM far ANTI JOIN adj USING (u, v)) GROUP BY u")
def two_hop_reach(spark, sf_dir):
    return structure.two_hop(structure.adjacency(fx.purchase_whole(spark, sf_dir)))


def _features_sql(edges: str, nodes: str, p: str) -> str:
    return f"""{p}adj AS (SELECT DISTINCT u, v FROM (SELECT source AS u, target AS v FROM {edges} UNION ALL SELECT target, source FROM {edges}) WHERE u <> v),
 {p}dg AS (SELECT label AS u, count(v) AS d FROM {nodes} LEFT JOIN {p}adj ON u = label GROUP BY label),
 {p}tr AS (SELECT a.u, count(*) / 2 AS t FROM {p}adj a JOIN {p}adj b ON a.v = b.u JOIN {p}adj c ON b.v = c.u AND c.v = a.u GROUP BY a.u),
 {p}th AS (SELECT f.u, count(*) AS h FROM (SELECT DISTINCT a.u, b.v FROM {p}adj a JOIN {p}adj b ON a.v = b.u WHERE a.u <> b.v) f ANTI JOIN {p}adj g ON f.u = g.u AND f.v = g.v GROUP BY f.u),
 {p}b AS (SELECT dg.u, d, coalesce(t, 0) AS t, coalesce(h, 0) AS h, CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) / 2) ELSE 0 END AS c FROM {p}dg dg LEFT JOIN {p}tr tr ON dg.u = tr.u LEFT JOIN {p}th th ON dg.u = th.u),
 {p}nb AS (SELECT adj.u, sum(d) AS sd, avg(d) AS ad, avg(c) AS ac FROM {p}adj adj JOIN {p}b b ON adj.v = b.u GROUP BY adj.u),
 {p}ft AS (SELECT b.u AS label, d::DOUBLE AS degree, c::DOUBLE AS clustering, coalesce(ad, 0)::DOUBLE AS neighbor_degree, (d + t)::DOUBLE AS ego_edges, greatest(coalesce(sd, 0) - d - 2 * t, 0)::DOUBLE AS ego_boundary, h::DOUBLE AS two_hop, coalesce(ac, 0)::DOUBLE AS neighbor_clustering FROM {p}b b LEFT JOIN {p}nb nb ON b.u = nb.u)"""


@query(f"{_W4}, {_features_sql('ae', 'an', '')} SELECT label, " + ", ".join(f"round({f}, 6) AS {f}" for f in structure.FEATURES) + " FROM ft")
def netsimile_features(spark, sf_dir):
    return rounded(structure.local_features(fx.co_events_whole(spark, sf_dir)))


def _signature_sql(p: str) -> str:
    def m(f: str, k: str) -> str:
        c = f"({f} - avg_{f})"
        return {"mean": f"avg({f})", "median": f"median({f})", "std": f"stddev_pop({f})", "skew": f"CASE WHEN max({f}) > min({f}) THEN avg({c} ** 3) / stddev_pop({f}) ** 3 ELSE 0 END", "kurtosis": f"CASE WHEN max({f}) > min({f}) THEN avg({c} ** 4) / stddev_pop({f}) ** 4 - 3 ELSE 0 END"}[k]

    centred = f"SELECT *, {', '.join(f'avg({f}) OVER () AS avg_{f}' for f in structure.FEATURES)} FROM {p}ft"
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, '{k}' AS moment, {m(f, k)} AS value FROM ({centred})" for f in structure.FEATURES for k in structure.MOMENTS)


@query(f"{_W4}, {_features_sql('ae', 'an', '')} SELECT feature, moment, round(value, 5) AS value FROM ({_signature_sql('')})")
def netsimile_signature(spark, sf_dir):
    return rounded(structure.signature(structure.local_features(fx.co_events_whole(spark, sf_dir))), 5)


@query(f"{_F4}, {_features_sql('ae', 'an', 'a_')}, {_features_sql('be', 'bn', 'b_')}, x AS ({_signature_sql('a_')}), y AS ({_signature_sql('b_')}) SELECT round(1 - sum(CASE WHEN abs(x.value) + abs(y.value) > 0 THEN abs(x.value - y.value) / (abs(x.value) + abs(y.value)) ELSE 0 END) / 35, 5) AS netsimile_similarity FROM x JOIN y USING (feature, moment)")
def netsimile_similarity(spark, sf_dir):
    return rounded(structure.netsimile(*fx.co_events(spark, sf_dir)), 5)


def _js_sql(base: str) -> str:
    edges = [0, 1, 2, 3, 4, 5]
    while edges[-1] < 10**7:
        edges.append(-(-edges[-1] * 3 // 2))
    sides = {"total": "source AS l FROM {0} UNION ALL SELECT target FROM {0}", "out": "source AS l FROM {0}", "in": "target AS l FROM {0}"}
    parts = [f"SELECT '{s}' AS side, '{w}' AS w, (SELECT count(*) FROM (SELECT {q.format(w + 'e')}) x WHERE x.l = n.label) AS d FROM {w}n n" for s, q in sides.items() for w in "ab"]
    return f"""{base}, dd AS ({' UNION ALL '.join(parts)}), bb AS (SELECT side, w, len(list_filter({edges}, lambda e: e <= d)) AS b FROM dd),
 hh AS (SELECT side, b, count(*) FILTER (w = 'a') / (SELECT count(*) FROM an) AS p, count(*) FILTER (w = 'b') / (SELECT count(*) FROM bn) AS q FROM bb GROUP BY side, b),
 js AS (SELECT side, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM hh GROUP BY side)
 SELECT round(1 - avg(js), 6) AS degree_js_similarity FROM js"""


@query(_js_sql(_P))
def degree_js(spark, sf_dir):
    return rounded(structure.degree_similarity(*fx.priority(spark, sf_dir)))


def _wl_sql() -> str:
    out = [_F4]
    for w in "ab":
        out.append(f"{w}j AS (SELECT DISTINCT u, v FROM (SELECT source AS u, target AS v FROM {w}e UNION ALL SELECT target, source FROM {w}e) WHERE u <> v)")
        out.append(f"{w}0 AS (SELECT label AS u, (CASE WHEN count(v) <= 4 THEN count(v) ELSE 5 + floor(ln(count(v) / 4) / ln(1.5)) END)::BIGINT::VARCHAR AS k FROM {w}n LEFT JOIN {w}j ON u = label GROUP BY label)")
        for i in (1, 2):
            out.append(f"{w}{i} AS (SELECT x.u, x.k || '|' || coalesce((SELECT string_agg(y.k, ',' ORDER BY y.k) FROM {w}j j JOIN {w}{i - 1} y ON j.v = y.u WHERE j.u = x.u), '') AS k FROM {w}{i - 1} x)")
    depth = " UNION ALL ".join(f"SELECT {i} AS depth, (SELECT sum(x.n * y.n) FROM (SELECT k, count(*) AS n FROM a{i} GROUP BY k) x JOIN (SELECT k, count(*) AS n FROM b{i} GROUP BY k) y USING (k)) AS dot, (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM a{i} GROUP BY k)) AS xx, (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM b{i} GROUP BY k)) AS yy" for i in range(3))
    return ", ".join(out) + f" SELECT round(avg(coalesce(dot, 0) / sqrt(xx * yy)), 6) AS wl_similarity FROM ({depth})"


@query(_wl_sql())
def wl_similarity(spark, sf_dir):
    return rounded(structure.wl_similarity(*fx.co_events(spark, sf_dir)))


@query()
def spectral_similarity(spark, sf_dir):
    value = structure.spectral_similarity(*fx.co_events(spark, sf_dir))
    return spark.createDataFrame([("spectral_similarity", value)], "metric string, value double")


@query()
def communities(spark, sf_dir):
    u = diff(fx.co_events(spark, sf_dir))
    return cluster.clusters_of(u).clusters


_SEG = """mb AS (SELECT label, coalesce(aseg, bseg, '(none)') AS cluster FROM nu), cn AS (SELECT cluster, count(*) AS size, count(*) FILTER (status = 'SHARED') AS nodes_shared, count(*) FILTER (status = 'CHANGED') AS nodes_changed, count(*) FILTER (status = 'A_ONLY') AS nodes_a_only, count(*) FILTER (status = 'B_ONLY') AS nodes_b_only FROM nu JOIN mb USING (label) GROUP BY cluster),
 dg AS (SELECT label, count(e.l) AS degree FROM nu LEFT JOIN (SELECT source AS l FROM ue0 UNION ALL SELECT target FROM ue0) e ON label = e.l GROUP BY label),
 hb AS (SELECT cluster, arg_min(label, (-degree, label)) AS name FROM mb JOIN dg USING (label) GROUP BY cluster),
 pe AS (SELECT x.cluster AS ca, y.cluster AS cb, status FROM ue0 JOIN mb x ON source = x.label JOIN mb y ON target = y.label)"""
_EC = "count(*) FILTER (status = 'SHARED') AS edges_shared, count(*) FILTER (status = 'CHANGED') AS edges_changed, count(*) FILTER (status = 'A_ONLY') AS edges_a_only, count(*) FILTER (status = 'B_ONLY') AS edges_b_only"
_CL = f"WITH {fx.SQL['priority']}, {_NODES}, {fx.UNION_SQL}, {_SEG}"
_CLUSTERS = f"""{_CL}, ie AS (SELECT ca AS cluster, {_EC} FROM pe WHERE ca = cb GROUP BY ca),
 fc AS (SELECT cn.*, name, coalesce(edges_shared, 0) AS edges_shared, coalesce(edges_changed, 0) AS edges_changed, coalesce(edges_a_only, 0) AS edges_a_only, coalesce(edges_b_only, 0) AS edges_b_only FROM cn JOIN hb USING (cluster) LEFT JOIN ie USING (cluster)),
 fd AS (SELECT *, nodes_changed + nodes_a_only + nodes_b_only + edges_changed + edges_a_only + edges_b_only AS n_changed, (nodes_changed + nodes_a_only + nodes_b_only + edges_changed + edges_a_only + edges_b_only) / (size + edges_shared + edges_changed + edges_a_only + edges_b_only) AS change_density FROM fc)"""


@query(_CLUSTERS + " SELECT * REPLACE (round(change_density, 6) AS change_density), row_number() OVER (ORDER BY change_density DESC, size DESC, cluster)::INT AS rank FROM fd")
def cluster_by_attribute(spark, sf_dir):
    return rounded(cluster.clusters_of(diff(fx.priority(spark, sf_dir, attributes=True)), attribute="c_mktsegment").clusters)


@query(f"{_CL} SELECT least(ca, cb) AS cluster_a, greatest(ca, cb) AS cluster_b, {_EC} FROM pe WHERE ca <> cb GROUP BY ALL")
def cluster_links(spark, sf_dir):
    return cluster.clusters_of(diff(fx.priority(spark, sf_dir, attributes=True)), attribute="c_mktsegment").links


@query(f"{_CL}, sz AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) AS p FROM mb GROUP BY cluster) SELECT CASE WHEN p <= 3 THEN cluster ELSE '(other)' END AS cluster, count(*) AS n FROM mb JOIN sz USING (cluster) GROUP BY 1")
def cluster_fold_tail(spark, sf_dir):
    u = diff(fx.priority(spark, sf_dir, attributes=True))
    return cluster.folded(cluster.by_attribute(u, "c_mktsegment"), 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(_CLUSTERS + ", rn AS (SELECT n_changed, row_number() OVER w AS p, sum(n_changed) OVER (ORDER BY n_changed DESC, cluster ROWS UNBOUNDED PRECEDING) AS reach, sum(n_changed) OVER () AS total FROM fd WINDOW w AS (ORDER BY n_changed DESC, cluster)) SELECT count(*) AS n_clusters, max(total)::BIGINT AS n_changed, min(p) FILTER (reach >= 0.8 * total)::INT AS k FROM rn")
def concentration_k80(spark, sf_dir):
    return cluster.concentration(cluster.clusters_of(diff(fx.priority(spark, sf_dir, attributes=True)), attribute="c_mktsegment").clusters)


@query(f"{_P}, {_INCIDENT} SELECT label, status, n_shared + n_changed + n_removed + n_added AS degree FROM ic WHERE status IN ('A_ONLY', 'B_ONLY') AND n_shared + n_changed + n_removed + n_added >= 5")
def hub_findings(spark, sf_dir):
    degree = F.col("n_shared") + F.col("n_changed") + F.col("n_removed") + F.col("n_added")
    return counts.incident_counts(diff(fx.priority(spark, sf_dir))).where(F.col("status").isin("A_ONLY", "B_ONLY")).select("label", "status", degree.alias("degree")).where("degree >= 5")


_AL = f"WITH {fx.SQL['renamed_parts']}, {fx.UNION_SQL}, ra AS (SELECT label FROM an ANTI JOIN bn USING (label)), rb AS (SELECT label FROM bn ANTI JOIN an USING (label))"
_NORM = "trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))"
_NM = f", fa AS (SELECT {_NORM} AS form, min(label) AS label, count(*) AS n FROM ra GROUP BY 1), fb AS (SELECT {_NORM} AS form, min(label) AS label, count(*) AS n FROM rb GROUP BY 1), nm AS (SELECT fa.label AS label_a, fb.label AS label_b FROM fa JOIN fb USING (form) WHERE fa.n = 1 AND fb.n = 1 AND form <> '')"
_TG = "list_distinct(list_transform(range(1, length(label) + 2), lambda i: substr('  ' || label || ' ', i::INT, 3)))"
_CAND = f"""{_AL}{_NM}, qa AS (SELECT label FROM ra WHERE label NOT IN (SELECT label_a FROM nm)), qb AS (SELECT label FROM rb WHERE label NOT IN (SELECT label_b FROM nm)),
 ga AS (SELECT label, unnest({_TG}) AS g FROM qa), gb AS (SELECT label, unnest({_TG}) AS g FROM qb),
 wk AS (SELECT g, x.n * y.n AS w FROM (SELECT g, count(*) AS n FROM ga GROUP BY g) x JOIN (SELECT g, count(*) AS n FROM gb GROUP BY g) y USING (g)),
 kp AS (SELECT g FROM (SELECT g, sum(w) OVER (ORDER BY w, g ROWS UNBOUNDED PRECEDING) AS spent FROM wk) WHERE spent <= 20000000),
 sz AS (SELECT label, len({_TG}) AS n FROM (SELECT label FROM qa UNION SELECT label FROM qb)),
 sh AS (SELECT ga.label AS label_a, gb.label AS label_b, count(*) AS n FROM ga SEMI JOIN kp USING (g) JOIN gb ON ga.g = gb.g GROUP BY ALL),
 cd AS (SELECT label_a, label_b, (sh.n / (x.n + y.n - sh.n) + sh.n / least(x.n, y.n)) / 2 AS s FROM sh JOIN sz x ON x.label = label_a JOIN sz y ON y.label = label_b),
 tk AS (SELECT * FROM cd WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY label_a ORDER BY s DESC, label_b) <= 10)"""


@query(f"{_AL} SELECT label AS label_a, label AS label_b FROM an JOIN bn USING (label)")
def align_exact(spark, sf_dir):
    return al.exact_matches(*fx.renamed_parts(spark, sf_dir))


def _residuals(spark, sf_dir):
    a, b = fx.renamed_parts(spark, sf_dir)
    exact = al.exact_matches(a, b)
    return a, b, exact, al.residual(a, exact, "label_a"), al.residual(b, exact, "label_b")


@query(f"{_AL}{_NM} SELECT * FROM nm")
def align_normalized(spark, sf_dir):
    _, _, _, ra, rb = _residuals(spark, sf_dir)
    return al.normalized_matches(ra, rb)


def _fuzzy(spark, sf_dir):
    a, b, exact, ra, rb = _residuals(spark, sf_dir)
    normal = al.normalized_matches(ra, rb)
    matched = al.settled(exact.unionByName(normal))
    return a, b, matched, al.candidates(al.residual(a, matched, "label_a"), al.residual(b, matched, "label_b"))


@query(f"{_CAND} SELECT label_a, label_b, round(s, 6) AS label_similarity FROM tk")
def align_topk(spark, sf_dir):
    return rounded(_fuzzy(spark, sf_dir)[3])


@query(f"""{_CAND}, mt AS (SELECT label AS label_a, label AS label_b FROM an JOIN bn USING (label) UNION ALL SELECT label_a, label_b FROM nm),
 pa AS (SELECT DISTINCT l, label_a AS x FROM (SELECT source AS l, target AS m FROM ae UNION SELECT target, source FROM ae) JOIN mt ON m = label_a), pb AS (SELECT DISTINCT l, label_a AS x FROM (SELECT source AS l, target AS m FROM be UNION SELECT target, source FROM be) JOIN mt ON m = label_b),
 bo AS (SELECT tk.label_a, tk.label_b, count(*) AS n FROM tk JOIN pa ON pa.l = tk.label_a JOIN pb ON pb.l = tk.label_b AND pa.x = pb.x GROUP BY ALL), ca AS (SELECT l, count(*) AS n FROM pa GROUP BY l), cb AS (SELECT l, count(*) AS n FROM pb GROUP BY l)
 SELECT tk.label_a, tk.label_b, round(coalesce(bo.n, 0) / nullif(coalesce(ca.n, 0) + coalesce(cb.n, 0) - coalesce(bo.n, 0), 0), 6) AS structural_similarity
 FROM tk LEFT JOIN bo USING (label_a, label_b) LEFT JOIN ca ON ca.l = tk.label_a LEFT JOIN cb ON cb.l = tk.label_b""")
def align_structural_score(spark, sf_dir):
    a, b, matched, found = _fuzzy(spark, sf_dir)
    return rounded(al.structural_scores(found, a, b, matched).drop("label_similarity"))


@query()
def align_match(spark, sf_dir):
    return al.align(*fx.renamed_parts(spark, sf_dir), al.AlignOptions(method="fuzzy")).pairs


@query(f"{_AL}{_NM} SELECT source, type, coalesce(label_a, target) AS target, min(weight) AS weight FROM be LEFT JOIN nm ON target = label_b GROUP BY ALL")
def relabel_b(spark, sf_dir):
    from deltamesh.operators.union import relabel

    a, b, _, ra, rb = _residuals(spark, sf_dir)
    return relabel(b, al.normalized_matches(ra, rb)).edges


_S = f"WITH {fx.ACTIVITY_SQL}, "
_STEPS = """es AS (SELECT coalesce(a.idx, b.idx - 1) AS step, CASE WHEN b.idx IS NULL THEN 'A_ONLY' WHEN a.idx IS NULL THEN 'B_ONLY' WHEN a.weight = b.weight THEN 'SHARED' ELSE 'CHANGED' END AS status FROM s a FULL JOIN s b ON b.idx = a.idx + 1 AND a.source = b.source AND a.type = b.type AND a.target = b.target),
 nn AS (SELECT idx, source AS label FROM s UNION SELECT idx, target FROM s), ns AS (SELECT coalesce(a.idx, b.idx - 1) AS step, CASE WHEN b.idx IS NULL THEN 'A_ONLY' WHEN a.idx IS NULL THEN 'B_ONLY' ELSE 'SHARED' END AS status FROM nn a FULL JOIN nn b ON b.idx = a.idx + 1 AND a.label = b.label),
 ok AS (SELECT DISTINCT idx AS step FROM s WHERE idx < (SELECT max(idx) FROM s)),
 ch AS (SELECT step, nodes_removed, nodes_added, edges_removed, edges_added, edges_reweighted, 1 - least(1, (nodes_removed + nodes_added + edges_removed + edges_added + edges_reweighted) / (nodes_removed + nodes_added + edges_removed + edges_added + 2 * (k + m))) AS similarity FROM
   (SELECT step, count(*) FILTER (status = 'A_ONLY') AS nodes_removed, count(*) FILTER (status = 'B_ONLY') AS nodes_added, count(*) FILTER (status = 'SHARED') AS k FROM ns SEMI JOIN ok USING (step) GROUP BY step) JOIN
   (SELECT step, count(*) FILTER (status = 'A_ONLY') AS edges_removed, count(*) FILTER (status = 'B_ONLY') AS edges_added, count(*) FILTER (status = 'CHANGED') AS edges_reweighted, count(*) FILTER (status IN ('SHARED', 'CHANGED')) AS m FROM es SEMI JOIN ok USING (step) GROUP BY step) USING (step))"""


@query(f"{_S}{_STEPS} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM ch")
def timeline_churn(spark, sf_dir):
    return rounded(series.churn(fx.activity(spark, sf_dir)))


_ATTRIBUTE_STEPS = f"""WITH {fx.ATTRIBUTES_SQL}, top AS (SELECT max(idx) AS top FROM s2),
 ej AS (SELECT coalesce(a.idx, b.idx - 1) AS step, CASE WHEN b.source IS NULL THEN 'gone' WHEN a.source IS NULL THEN 'new' WHEN a.weight <> b.weight OR a.top_k <> b.top_k THEN 'altered' ELSE 'same' END AS st FROM s2 a FULL JOIN s2 b ON b.idx = a.idx + 1 AND a.source = b.source AND a.type = b.type AND a.target = b.target),
 nj AS (SELECT coalesce(a.idx, b.idx - 1) AS step, CASE WHEN b.label IS NULL THEN 'gone' WHEN a.label IS NULL THEN 'new' WHEN a.n_events <> b.n_events THEN 'altered' ELSE 'same' END AS st FROM n2 a FULL JOIN n2 b ON b.idx = a.idx + 1 AND a.label = b.label),
 c AS (SELECT step, sum((st = 'gone' AND n)::INT) AS ng, sum((st = 'new' AND n)::INT) AS nn, sum((st = 'gone' AND NOT n)::INT) AS eg, sum((st = 'new' AND NOT n)::INT) AS en, sum((st = 'altered' AND NOT n)::INT) AS ea, sum((st <> 'same')::INT) AS cost, sum(CASE WHEN st IN ('gone', 'new') THEN 1 ELSE 2 END) AS worst FROM (SELECT step, st, true AS n FROM nj UNION ALL SELECT step, st, false FROM ej) GROUP BY step)
 SELECT step, ng::BIGINT AS nodes_removed, nn::BIGINT AS nodes_added, eg::BIGINT AS edges_removed, en::BIGINT AS edges_added, ea::BIGINT AS edges_reweighted, round(1 - cost / worst, 6) AS similarity FROM c, top WHERE step >= 0 AND step < top"""


@query(_ATTRIBUTE_STEPS)
def timeline_churn_attributes(spark, sf_dir):
    return rounded(series.churn(*fx.activity_attributes(spark, sf_dir)))


_PRES = "nn AS (SELECT idx, source AS label FROM s UNION SELECT idx, target FROM s), pr AS (SELECT label, string_agg(CASE WHEN EXISTS (SELECT 1 FROM nn x WHERE x.label = l.label AND x.idx = i.idx) THEN '1' ELSE '0' END, '' ORDER BY i.idx) AS pattern FROM (SELECT DISTINCT label FROM nn) l, (SELECT DISTINCT idx FROM s) i GROUP BY label)"


@query(f"{_S}{_PRES} SELECT label, pattern FROM pr")
def timeline_presence(spark, sf_dir):
    return series.presence(fx.activity(spark, sf_dir))


@query(f"{_S}{_PRES} SELECT label, pattern, len(list_filter(range(1, length(pattern)), lambda i: pattern[i] <> pattern[i + 1]))::INT AS transitions FROM pr WHERE len(list_filter(range(1, length(pattern)), lambda i: pattern[i] <> pattern[i + 1])) >= 2")
def timeline_flickers(spark, sf_dir):
    return series.flickers(series.presence(fx.activity(spark, sf_dir)))


@query(f"{_S}{_STEPS}, z AS (SELECT *, nodes_removed + nodes_added + edges_removed + edges_added AS size FROM ch) SELECT count(*) AS n_steps, round(regr_slope(similarity, step), 6) AS slope, round(max(size) / sum(size), 6) AS top_share, arg_max(step, (size, -step)) AS top_step, round(stddev_samp(size) / avg(size), 6) AS cv FROM z")
def timeline_trend(spark, sf_dir):
    return rounded(series.trend(series.churn(fx.activity(spark, sf_dir))))


def _step_scores(spark, sf_dir) -> DataFrame:
    """A plain score per node and step: its differing incident edges."""
    e = series.step_edges(fx.activity(spark, sf_dir)).where(F.col("status").isin(*DIFFERING))
    return e.select("step", F.explode(F.array("source", "target")).alias("label")).groupBy("step", "label").agg(F.count(F.lit(1)).cast("double").alias("significance"))


_SCORES = """ee AS (SELECT coalesce(a.idx, b.idx - 1) AS step, coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target FROM s a FULL JOIN s b ON b.idx = a.idx + 1 AND a.source = b.source AND a.type = b.type AND a.target = b.target WHERE a.weight IS DISTINCT FROM b.weight),
 ok AS (SELECT DISTINCT idx AS step FROM s WHERE idx < (SELECT max(idx) FROM s)), sc AS (SELECT step, label, count(*)::DOUBLE AS significance FROM (SELECT step, source AS label FROM ee UNION ALL SELECT step, target FROM ee) SEMI JOIN ok USING (step) GROUP BY ALL),
 bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY step ORDER BY significance DESC, label) <= 50)"""


@query(f"{_S}{_SCORES} SELECT label, count(*) AS steps, sum(significance) AS total FROM bs GROUP BY label HAVING count(*) >= 2")
def timeline_recurrent(spark, sf_dir):
    return series.recurrent(_step_scores(spark, sf_dir), 2)


@query(f"{_S}{_SCORES}, tt AS (SELECT label FROM bs GROUP BY label ORDER BY sum(significance) DESC, label LIMIT 50) SELECT tt.label, ok.step, coalesce(bs.significance, 0) AS significance FROM tt CROSS JOIN ok LEFT JOIN bs ON bs.label = tt.label AND bs.step = ok.step")
def timeline_node_history(spark, sf_dir):
    return series.node_history(_step_scores(spark, sf_dir))


def _stacked(spark, sf_dir) -> DataFrame:
    return fx.activity(spark, sf_dir).select(F.concat(F.lit("g"), "idx").alias("graph_id"), *KEY, F.col("weight").cast("double").alias("weight"))


_PAIRS = """g AS (SELECT 'g' || idx AS graph_id, source, type, target, weight FROM s), nd AS (SELECT graph_id, source AS label FROM g UNION SELECT graph_id, target FROM g),
 pp AS (SELECT DISTINCT x.graph_id AS graph_a, y.graph_id AS graph_b FROM nd x, nd y WHERE x.graph_id < y.graph_id),
 nc AS (SELECT graph_a, graph_b, (SELECT count(*) FROM nd WHERE graph_id = graph_a) AS na, (SELECT count(*) FROM nd WHERE graph_id = graph_b) AS nb, (SELECT count(*) FROM nd x JOIN nd y USING (label) WHERE x.graph_id = graph_a AND y.graph_id = graph_b) AS nm,
   (SELECT count(*) FROM g WHERE graph_id = graph_a) AS ea, (SELECT count(*) FROM g WHERE graph_id = graph_b) AS eb, (SELECT count(*) FROM g x JOIN g y USING (source, type, target) WHERE x.graph_id = graph_a AND y.graph_id = graph_b) AS em,
   (SELECT count(*) FROM g x JOIN g y USING (source, type, target) WHERE x.graph_id = graph_a AND y.graph_id = graph_b AND x.weight <> y.weight) AS ec FROM pp)"""


@query(f"{_S}{_PAIRS} SELECT graph_a, graph_b, round(nm / (na + nb - nm), 6) AS jaccard_nodes, round(em / (ea + eb - em), 6) AS jaccard_typed_edges FROM nc")
def all_pairs_jaccard(spark, sf_dir):
    t = series.all_pairs(_stacked(spark, sf_dir)).where("scope = 'raw'")
    return rounded(t.groupBy("graph_a", "graph_b").pivot("metric", ["jaccard_nodes", "jaccard_typed_edges"]).agg(F.first("value")))


@query(f"{_S}{_PAIRS} SELECT graph_a, graph_b, (na + nb - 2 * nm + ea + eb - 2 * em + ec)::DOUBLE AS ged_cost, round(1 - (na + nb - 2 * nm + ea + eb - 2 * em + ec) / (na + nb + ea + eb), 6) AS ged_similarity FROM nc")
def all_pairs_ged(spark, sf_dir):
    t = series.all_pairs(_stacked(spark, sf_dir)).where("scope = 'raw'")
    return rounded(t.groupBy("graph_a", "graph_b").pivot("metric", ["ged_cost", "ged_similarity"]).agg(F.first("value")))


@query(f"""WITH {fx.ATTRIBUTES_SQL}, ep AS (SELECT x.idx AS i, y.idx AS j, count(*) AS m, count_if(x.weight <> y.weight OR x.top_k <> y.top_k) AS c FROM s2 x JOIN s2 y USING (source, type, target) WHERE x.idx < y.idx GROUP BY ALL),
 np AS (SELECT x.idx AS i, y.idx AS j, count(*) AS m, count_if(x.n_events <> y.n_events) AS c FROM n2 x JOIN n2 y USING (label) WHERE x.idx < y.idx GROUP BY ALL),
 z AS (SELECT idx, count(*) AS n FROM (SELECT idx FROM s2 UNION ALL SELECT idx FROM n2) GROUP BY idx),
 t AS (SELECT a.idx AS i, b.idx AS j, a.n + b.n AS worst, a.n + b.n - 2 * coalesce(ep.m, 0) - 2 * coalesce(np.m, 0) + coalesce(ep.c, 0) + coalesce(np.c, 0) AS cost FROM z a JOIN z b ON a.idx < b.idx LEFT JOIN ep ON ep.i = a.idx AND ep.j = b.idx LEFT JOIN np ON np.i = a.idx AND np.j = b.idx)
 SELECT 'g' || i AS graph_a, 'g' || j AS graph_b, cost::DOUBLE AS ged_cost, round(1 - cost / worst, 6) AS ged_similarity FROM t""")
def all_pairs_attributes(spark, sf_dir):
    edges, nodes = (x.withColumn("graph_id", F.concat(F.lit("g"), "idx")).drop("idx") for x in fx.activity_attributes(spark, sf_dir))
    t = series.all_pairs(edges, nodes).where("scope = 'raw'")
    return rounded(t.groupBy("graph_a", "graph_b").pivot("metric", ["ged_cost", "ged_similarity"]).agg(F.first("value")))


@query(f"""{_S}{_PAIRS}, sn AS (SELECT x.graph_id AS graph_a, y.graph_id AS graph_b, label FROM nd x JOIN nd y USING (label) WHERE x.graph_id < y.graph_id),
 ia AS (SELECT sa.graph_a, sa.graph_b, g.source, g.type, g.target FROM g JOIN sn sa ON g.graph_id = sa.graph_a AND g.source = sa.label JOIN sn sb ON sb.graph_a = sa.graph_a AND sb.graph_b = sa.graph_b AND sb.label = g.target),
 ib AS (SELECT sa.graph_a, sa.graph_b, g.source, g.type, g.target FROM g JOIN sn sa ON g.graph_id = sa.graph_b AND g.source = sa.label JOIN sn sb ON sb.graph_a = sa.graph_a AND sb.graph_b = sa.graph_b AND sb.label = g.target)
 SELECT nc.graph_a, nc.graph_b, round(em / ((SELECT count(*) FROM ia WHERE ia.graph_a = nc.graph_a AND ia.graph_b = nc.graph_b) + (SELECT count(*) FROM ib WHERE ib.graph_a = nc.graph_a AND ib.graph_b = nc.graph_b) - em), 6) AS jaccard_typed_edges FROM nc""")
def all_pairs_shared(spark, sf_dir):
    t = series.all_pairs(_stacked(spark, sf_dir)).where("scope = 'shared' and metric = 'jaccard_typed_edges'")
    return rounded(t.select("graph_a", "graph_b", F.col("value").alias("jaccard_typed_edges")))


@query(f"{_S}{_PAIRS}, lg AS (SELECT graph_a, graph_b, nm / (na + nb - nm) AS v FROM nc), bo AS (SELECT * FROM lg UNION ALL SELECT graph_b, graph_a, v FROM lg) SELECT i AS graph_a, " + ", ".join(f"CASE WHEN i = 'g{k}' THEN 1 ELSE (SELECT round(v, 6) FROM bo WHERE graph_a = i AND graph_b = 'g{k}') END AS g{k}" for k in range(5)) + " FROM (SELECT DISTINCT graph_a AS i FROM bo)")
def similarity_matrix(spark, sf_dir):
    t = series.all_pairs(_stacked(spark, sf_dir)).where("scope = 'raw' and metric = 'jaccard_nodes'")
    return rounded(views.similarity_matrix(t, "value", [f"g{k}" for k in range(5)]))


@query(f"""{_P}, sd AS (SELECT label FROM un WHERE status <> 'SHARED' UNION SELECT source FROM ue WHERE status <> 'SHARED' UNION SELECT target FROM ue WHERE status <> 'SHARED'),
 gr AS (SELECT label FROM sd UNION SELECT source FROM ue WHERE target IN (SELECT label FROM sd) UNION SELECT target FROM ue WHERE source IN (SELECT label FROM sd)),
 ch AS (SELECT label FROM sd WHERE (SELECT count(*) FROM sd) >= 2000 UNION SELECT label FROM gr WHERE (SELECT count(*) FROM sd) < 2000),
 dg AS (SELECT label, count(e.l) AS degree FROM un LEFT JOIN (SELECT source AS l FROM ue UNION ALL SELECT target FROM ue) e ON label = e.l GROUP BY label),
 fl AS (SELECT ch.label, sd.label IS NOT NULL AS is_seed, degree FROM ch JOIN dg USING (label) LEFT JOIN sd ON ch.label = sd.label)
 SELECT label, is_seed FROM fl ORDER BY is_seed DESC, CASE WHEN is_seed THEN 0 ELSE -degree END, label LIMIT 2000""")
def focus_nodes_1hop(spark, sf_dir):
    return views.focus_nodes(diff(fx.priority(spark, sf_dir)))


@query(f"""{_P}, eg AS (SELECT label AS ego FROM un WHERE label LIKE 'P#%'), pr AS (SELECT source AS ego, target AS neighbor, status, true AS outgoing FROM ue UNION ALL SELECT target, source, status, false FROM ue),
 rk AS (SELECT ego, neighbor, status, outgoing, CASE status WHEN 'B_ONLY' THEN 3 WHEN 'A_ONLY' THEN 2 WHEN 'CHANGED' THEN 1 ELSE 0 END AS r FROM pr SEMI JOIN eg USING (ego) WHERE ego <> neighbor),
 o1 AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY ego, neighbor ORDER BY r DESC, outgoing DESC) = 1)
 SELECT ego, neighbor, status, outgoing, greatest(count(*) OVER (PARTITION BY ego) - 24, 0) AS n_hidden FROM o1 QUALIFY row_number() OVER (PARTITION BY ego ORDER BY r DESC, neighbor) <= 24""")
def ego_networks(spark, sf_dir):
    u = diff(fx.priority(spark, sf_dir))
    return views.ego_networks(u, u.nodes.select("label").where("label like 'P#%'"))


@query(f"{_P}, eg AS (SELECT label AS ego FROM un WHERE label LIKE 'P#%') SELECT ego, count(*) AS n FROM (SELECT DISTINCT target AS ego, source AS m FROM ue) SEMI JOIN eg USING (ego) GROUP BY ego")
def ego_sizes(spark, sf_dir):
    u = diff(fx.priority(spark, sf_dir))
    return views.ego_networks(u, u.nodes.select("label").where("label like 'P#%'"), most=1 << 30).groupBy("ego").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS label, trim(regexp_replace(lower(n_name || ' - ' || n_regionkey), '[^a-z0-9]+', ' ', 'g')) AS form FROM nation")
def normalize_labels(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("label"), normalized(F.concat(F.col("n_name"), F.lit(" - "), F.col("n_regionkey").cast("string"))).alias("form"))


@query(f"""{_P}, {_SCOPED}, t AS (SELECT {_SIZES} FROM un), e AS (SELECT {_SIZES} FROM ue)
 SELECT metric, round(value, 6) AS value FROM (SELECT 'jaccard_nodes' AS metric, n_both / (n_a + n_b - n_both) AS value FROM t UNION ALL SELECT 'dice_nodes', 2 * n_both / (n_a + n_b) FROM t
 UNION ALL SELECT 'jaccard_typed_edges', n_both / (n_a + n_b - n_both) FROM e UNION ALL SELECT 'dice_typed_edges', 2 * n_both / (n_a + n_b) FROM e)""")
def scores_tidy(spark, sf_dir):
    u = diff(fx.priority(spark, sf_dir))
    rows = [t.where("scope = 'raw'").select(F.inline(F.array(*[F.struct(F.lit(f"{m}_{w}").alias("metric"), F.col(m).alias("value")) for m in ("jaccard", "dice")]))) for w, t in (("nodes", counts.node_overlap(u)), ("typed_edges", counts.typed_edge_overlap(u)))]
    return rounded(rows[0].unionByName(rows[1]))


@query(f"""WITH a AS (SELECT source, type, target FROM (WITH {fx.SQL['priority']} SELECT * FROM ae) UNION SELECT source, type, target FROM (WITH {fx.SQL['priority']} SELECT * FROM be)) SELECT type, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM a GROUP BY type""")
def edge_types(spark, sf_dir):
    g = diff(fx.priority(spark, sf_dir)).as_graph()
    return g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))
