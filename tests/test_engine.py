from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from deltamesh.cli import main
from deltamesh.functions.stats import incomplete_beta, lgamma, surprise, t_test_p
from deltamesh.functions.text import normal_form, normalized
from deltamesh.model import DuplicateEdgeError, GraphError, graph
from deltamesh.operators import blocks, counts, significance, structure, views
from deltamesh.operators.align import AlignOptions, align
from deltamesh.operators.cluster import clusters_of, communities, concentration
from deltamesh.operators.union import build_union
from deltamesh.plans import batch, generators
from deltamesh.plans.report import Rule, compare, load_baseline, quantity, run_checks
from deltamesh.sources import write_graph

SCHEMA = "source string, type string, target string, weight double"
A = [("a", "knows", "b", 1.0), ("b", "knows", "c", 2.0), ("c", "owns", "d", 3.0)]
B = [("a", "knows", "b", 1.0), ("b", "knows", "c", 5.0), ("c", "owns", "e", 3.0)]


@pytest.fixture(scope="module")
def pair(spark):
    return tuple(graph(spark.createDataFrame(rows, SCHEMA), name=n) for rows, n in ((A, "a"), (B, "b")))


@pytest.fixture(scope="module")
def union(pair):
    return build_union(*pair)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_statuses_and_details(union):
    assert {k: v["status"] for k, v in by(union.nodes, "label").items()} == {"a": "SHARED", "b": "SHARED", "c": "SHARED", "d": "A_ONLY", "e": "B_ONLY"}
    assert {(r["source"], r["target"]): r["status"] for r in union.edges.collect()} == {("a", "b"): "SHARED", ("b", "c"): "CHANGED", ("c", "d"): "A_ONLY", ("c", "e"): "B_ONLY"}
    assert [tuple(r) for r in union.changed_long().collect()] == [("b", "knows", "c", "weight", "2.0", "5.0")]


def test_hand_computed_metrics(union):
    n, e = by(counts.node_overlap(union), "scope")["raw"], by(counts.typed_edge_overlap(union), "scope")["raw"]
    assert (n["jaccard"], n["overlap"], n["dice"]) == (0.6, 0.75, 0.75)
    assert e["jaccard"] == 0.5 and math.isclose(e["dice"], 2 / 3)
    assert {k: v["jaccard"] for k, v in by(counts.per_type_overlap(union).where("scope = 'raw'"), "type").items()} == {"knows": 1.0, "owns": 0.0}
    g = by(counts.edit_distance(union), "scope")
    assert (g["raw"]["cost"], g["raw"]["worst"], g["shared"]["cost"], g["shared"]["worst"]) == (5, 14, 1, 10)
    g = by(counts.edit_distance(union, counts.EditCosts(type_factors={"owns": 10})), "scope")["raw"]
    assert (g["cost"], g["worst"]) == (23, 32)
    w = counts.weight_agreement(union).first()
    assert (w["n_compared"], w["spearman"], w["mean_abs_diff"]) == (2, 1.0, 1.5)
    d = counts.neighborhood_delta(union)
    assert {k: round(v["jaccard"], 9) for k, v in by(d, "label").items()} == {"a": 1.0, "b": 1.0, "c": round(1 / 3, 9)}
    s = counts.neighborhood_summary(d).first()
    assert (round(s["mean_jaccard"], 9), s["median_jaccard"], s["n_unchanged"]) == (round(7 / 9, 9), 1.0, 2)


def test_tolerance_null_and_kind_rules(spark):
    def status(x, y, tx="double", ty="double"):
        a, b = (graph(spark.createDataFrame([("u", "t", "v", w)], f"source string, type string, target string, weight {t}")) for w, t in ((x, tx), (y, ty)))
        return build_union(a, b).edges.first()["status"]

    assert status(1.0, 1 + 1e-12) == "SHARED"
    assert status(None, None) == "SHARED" and status(float("nan"), None) == "SHARED"
    assert status(None, 1.0) == "CHANGED"
    assert status("1", 1, "string", "long") == "CHANGED" and status(True, 1, "boolean", "long") == "SHARED"


def test_empty_and_directed(spark, pair):
    none = graph(spark.createDataFrame([], SCHEMA), name="none")
    u = build_union(none, none)
    assert by(counts.node_overlap(u), "scope")["raw"]["jaccard"] == 1.0
    assert by(counts.edit_distance(u), "scope")["raw"]["similarity"] == 1.0
    assert structure.degree_similarity(none, none).first()[0] == 1.0
    u = build_union(none, pair[0])
    assert by(counts.node_overlap(u), "scope")["raw"]["jaccard"] == 0.0
    assert counts.neighborhood_delta(u).count() == 0
    with pytest.raises(GraphError):
        build_union(pair[0], graph(pair[1].edges, directed=False))


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", "x", "b", 1.0), ("a", "x", "b", 2.0)], SCHEMA).coalesce(1)
    with pytest.raises(DuplicateEdgeError):
        graph(rows).validate()
    assert graph(rows, on_duplicate_edge="first").edges.first()["weight"] == 1.0
    assert graph(rows, on_duplicate_edge="last").edges.first()["weight"] == 2.0
    back = spark.createDataFrame([("a", "x", "b", 1.0), ("b", "x", "a", 2.0)], SCHEMA)
    with pytest.raises(DuplicateEdgeError):
        graph(back, directed=False).validate()


def test_a_union_refuses_what_repeats(spark, pair):
    twice = graph(spark.createDataFrame([*A, ("a", "knows", "b", 1.0)], SCHEMA))
    labels = graph(pair[0].edges, spark.createDataFrame([("a",), ("b",), ("a",)], "label string"))
    for x in (twice, labels):
        for u in (build_union(x, pair[1]), build_union(pair[1], x)):
            with pytest.raises(Exception, match="repeated"):
                u.edges.select("status").collect()
                u.nodes.select("status").collect()
    with pytest.raises(DuplicateEdgeError):
        batch.matrix({"a": pair[0], "b": twice}, ["jaccard_nodes"])


def test_series_see_every_attribute(spark):
    schema = "source string, type string, target string, weight double, note string"
    nodes = [spark.createDataFrame(r, "label string, kind string") for r in ([("a", "x"), ("b", "y"), ("alone", "z")], [("a", "x"), ("b", "other"), ("alone", "z")])]
    pair = [graph(spark.createDataFrame([("a", "t", "b", w, note)], schema), n, name=name) for w, note, n, name in ((1.0, "old", nodes[0], "p"), (1.0 + 1e-13, "new", nodes[1], "q"))]
    r = compare(*pair, structural=False, findings=False)
    rows = {x["metric"]: x for x in batch.matrix({"p": pair[0], "q": pair[1]}, ["ged_cost", "ged_similarity", "jaccard_nodes"]).collect()}
    assert rows["ged_cost"]["raw_score"] == r.score("ged_cost") == 2.0
    assert all(math.isclose(x["raw_score"], r.score(m)) and math.isclose(x["shared_subgraph_score"], r.score(m, True)) for m, x in rows.items())
    t = batch.timeline(pair)
    step = t.churn.first()
    assert step["edges_reweighted"] == 1 and step["nodes_added"] == step["nodes_removed"] == 0 and math.isclose(step["similarity"], r.score("ged_similarity"))
    assert {x["label"]: x["pattern"] for x in t.presence.collect()} == {"a": "11", "b": "11", "alone": "11"}


def test_special_functions(spark):
    assert all(math.isclose(lgamma(x), math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12) for x in (0.5, 1.0, 3.7, 20.0, 1e5))
    tail = lambda k, n, p: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
    for k, n, p in ((1, 10, 0.3), (5, 10, 0.3), (10, 10, 0.3), (60, 400, 0.1), (1, 500, 0.9)):
        assert math.isclose(float(incomplete_beta(k, n - k + 1, p)), tail(k, n, p), rel_tol=1e-9)
    rows = [(0, 5, 10, 20), (3, 0, 10, 20), (4, 6, 9, 31), (7, 3, 9, 30), (900, 900, 901, 5000)]
    got = [r[0] for r in spark.createDataFrame(rows, "k long, n long, tk long, tn long").coalesce(1).select(surprise(*map(F.col, ("k", "n", "tk", "tn")))).collect()]
    assert got[:2] == [0.0, 0.0] and got[4] == 300.0
    # of the other 25 trials 5 are hits, of the other 27 two
    assert math.isclose(got[2], -math.log10(tail(4, 6, 5.5 / 26)), rel_tol=1e-9) and math.isclose(got[3], -7 * math.log10(2.5 / 28), rel_tol=1e-9)
    assert math.isclose(t_test_p(0.5, 20), 0.024769, rel_tol=1e-3)


def test_concentrated_change_outranks_scattered_change(spark):
    centre = [("m", "t", f"s{i}", 1.0) for i in range(14)]
    ring = [(f"r{i}", "t", f"r{(i + 1) % 45}", 1.0) for i in range(45)]
    # nine of the centre's fourteen edges go, and three of the ring's 45
    after = centre[9:] + [e for i, e in enumerate(ring) if i % 15]
    u = build_union(*(graph(spark.createDataFrame(r, SCHEMA)) for r in (centre + ring, after)))
    rows = by(significance.node_significance(u), "label")
    assert significance.ranked(significance.node_significance(u)).first()["label"] == "m"
    m, r = rows["m"], rows["r0"]
    assert (m["degree_a"], m["n_removed"], m["degree_b"], r["degree_a"], r["n_removed"]) == (14, 9, 5, 2, 1)
    tail = lambda k, n, p: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
    # twelve of 59 edges are gone, three of the 45 others
    assert math.isclose(m["surprise_removed"], -math.log10(tail(9, 14, 3.5 / 46)), rel_tol=1e-9)


def test_pagerank_forms_agree(spark):
    g = graph(spark.createDataFrame([("a", "t", "b", 1.0), ("b", "t", "c", 1.0), ("d", "t", "d", 1.0)], SCHEMA))
    x = {r["label"]: r["pagerank"] for r in significance.pagerank(g).collect()}
    y = {r["label"]: r["pagerank"] for r in significance.pagerank_steps(g, 25).collect()}
    assert math.isclose(sum(x.values()), 1.0) and all(abs(x[k] - y[k]) < 1e-2 for k in x)


def test_shapes_tell_a_wheel_from_a_ladder(spark):
    n = 24
    wheel = [("hub", "t", f"w{i}", 1.0) for i in range(n)] + [(f"w{i}", "t", f"w{(i + 1) % n}", 1.0) for i in range(n)]
    ladder = [(f"{s}{i}", "t", f"{s}{(i + 1) % n}", 1.0) for s in "xy" for i in range(n)] + [(f"x{i}", "t", f"y{i}", 1.0) for i in range(n)]
    wheel, ladder = (graph(spark.createDataFrame(e, SCHEMA)) for e in (wheel, ladder))
    # all but the hub have three neighbours in either, in other directions; around them, only a wheel's have a hub and triangles
    assert 0.5 < structure.degree_similarity(wheel, ladder).first()[0] < 0.9
    assert math.isclose(structure.wl_similarity(wheel, ladder).first()[0], (n / math.sqrt(n * n + 1)) / 3, rel_tol=1e-9)
    assert structure.netsimile(wheel, ladder).first()[0] < 0.75
    assert structure.spectral_similarity(wheel, ladder) < 0.999
    for f in (structure.degree_similarity, structure.wl_similarity, structure.netsimile):
        assert math.isclose(f(ladder, ladder).first()[0], 1.0)
    assert math.isclose(structure.spectral_similarity(wheel, wheel), 1.0)


def test_degree_bins_grow_by_half():
    assert structure.degree_bins(0) == [0, 1, 2, 3, 4, 5] and structure.degree_bins(5) == [0, 1, 2, 3, 4, 5, 8]
    assert structure.degree_bins(26) == [0, 1, 2, 3, 4, 5, 8, 12, 18, 27]


def test_spectra_do_not_depend_on_where_the_edges_are(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 900)
    edges = [(f"n{i}", "t", f"n{(i * j + j) % 450}", 1.0) for i in range(450) for j in (1, 3, 7)] + [("x", "t", "y", 1.0)]
    g = graph(spark.createDataFrame(edges, SCHEMA))
    near = structure.spectrum(g, k=3)
    far = structure.spectrum(g, k=3, most_edges=0)
    assert far is not None and max(abs(near - far)) < 1e-6
    assert structure.spectrum(g, k=3, most_nodes=10) is None


def test_communities_and_concentration(spark):
    two = graph(spark.createDataFrame([("a", "t", "b", 1.0), ("b", "t", "c", 1.0), ("c", "t", "a", 1.0), ("x", "t", "y", 1.0), ("y", "t", "z", 1.0), ("z", "t", "x", 1.0)], SCHEMA))
    for kw in ({}, {"local_nodes": 0}):
        found, _ = communities(two, **kw)
        assert found.groupBy("cluster").count().count() == 2
    u = build_union(*generators.block_pair(spark))
    found = clusters_of(u)
    assert concentration(found.clusters).first()["k"] == 3
    n = found.clusters.agg(F.sum("size")).first()[0]
    assert n == u.nodes.count()


def test_communities_do_not_depend_on_where_the_edges_are(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 60)
    edges = [(f"n{i}", "t", f"n{i // 12 * 12 + (i * j + 5) % 12}", 1.0) for i in range(60) for j in (1, 2, 5, 7)] + [(f"n{12 * i}", "t", f"n{(12 * i + 12) % 60}", 1.0) for i in range(5)]
    g = graph(spark.createDataFrame(list(dict.fromkeys(edges)), SCHEMA))
    for resolution in (0.3, 1.0, 4.0):
        near, far, split = (communities(g, resolution, **kw) for kw in ({}, {"local_edges": 0}, {"local_nodes": 0}))
        assert near[1] == far[1] == split[1] == "modularity"
        want = sorted(map(tuple, near[0].collect()))
        assert sorted(map(tuple, far[0].collect())) == sorted(map(tuple, split[0].collect())) == want


def test_alignment_recovers_renamed_labels(spark):
    a, _ = generators.block_pair(spark, blocks=6, size=60)
    b, truth = generators.renamed_copy(a, 0.15)
    found = align(a, b, AlignOptions(method="fuzzy")).pairs
    assert found.select("label_a").distinct().count() == found.count() == found.select("label_b").distinct().count()
    right = found.join(truth, ["label_a", "label_b"]).count()
    assert right / found.count() > 0.9 and right / truth.count() > 0.9
    u = build_union(a, b, alignment=found)
    assert by(counts.edit_distance(u), "scope")["raw"]["similarity"] > by(counts.edit_distance(build_union(a, b)), "scope")["raw"]["similarity"]


def test_normal_forms(spark):
    labels = ["Crème  Brûlée!", "a_b-C", "STRASSE", "straße", "", "٣ x"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(normalized(F.col("l")).alias("n"))
    assert [r["n"] for r in df.collect()] == [normal_form(x) for x in labels]
    assert normal_form("straße") == "strasse" and normal_form("Crème  Brûlée!") == "creme brulee"


def test_focus_and_egos(spark, union):
    assert {r["label"] for r in views.focus_nodes(union, hops=0).where("is_seed").collect()} == {"b", "c", "d", "e"}
    assert views.focus_nodes(union, most=2).count() == 2
    egos = views.ego_networks(union, spark.createDataFrame([("c",)], "label string"), most=2).orderBy("neighbor").collect()
    assert [(r["neighbor"], r["status"], r["n_hidden"]) for r in egos] == [("d", "A_ONLY", 1), ("e", "B_ONLY", 1)]
    assert set(views.layout(["a", "b"], [("a", "b")])) == {"a", "b"}


def test_report_rules_and_files(spark, pair, tmp_path):
    r = compare(*pair, structural=False)  # the structural scores have tests of their own
    doc = json.loads(r.to_json(str(tmp_path / "r.json")))
    assert len(doc["scores"]) == 21 and doc["findings"][-1]["kind"] == "background"
    done = run_checks(r, ["similarity >= 0.6", "nodes.A_ONLY == 1", "edges<3", "significance.n_over_1e3==0"], load_baseline(str(tmp_path / "r.json")), {"similarity": 0.0, "similarity.shared": 1e-9})
    assert [o.ok for o in done.outcomes] == [True, True, False, True, True, True]
    assert [f.kind for f in compare(pair[0], pair[0], structural=False).findings] == ["identical"]
    r.union_to_parquet(str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u/union_edges.parquet")).count() == 4
    assert "jaccard_nodes" in r.to_markdown() and r.page_data()["nodes"]
    for text in ("x >> 3", "x", ">= 3", "x >= ", "x >= 1_0", "x < inf", "a b > 1", "x = 1", "x => 1"):
        with pytest.raises(ValueError):
            Rule.parse(text)
    assert Rule.parse(" similarity>=-1e-2 ") == Rule("ged_similarity", ">=", -0.01) and Rule.parse("nodes.A_ONLY != 0").op == "!="
    for name in ("nope", "nodes.nope", "ged_similarity.nope", "significance.nope"):
        with pytest.raises(KeyError):
            quantity(r, name)


def test_matrix_and_timeline(spark, pair):
    t = {(r["metric"]): r.asDict() for r in batch.matrix({"a": pair[0], "b": pair[1]}, ["jaccard_nodes", "ged_similarity", "jaccard_typed_edges", "weight_spearman"]).collect()}
    r = compare(*pair, structural=False, findings=False)
    for m, row in t.items():
        assert math.isclose(row["raw_score"], r.score(m)) and math.isclose(row["shared_subgraph_score"], r.score(m, shared=True))
    with pytest.raises(KeyError):
        batch.matrix({"a": pair[0]}, ["nope"])
    tl = batch.timeline(generators.snapshots(spark))
    kinds = {f.kind: f for f in tl.findings()}
    assert "flick-0" in kinds["flicker"].labels and tl.n_steps == 5
    assert tl.churn.orderBy(F.col("edges_removed").desc()).first()["step"] == 2
    same = batch.timeline([pair[0]] * 3)
    assert same.history.count() == 0 and same.flickers().count() == 0 and same.names == ["a[0]", "a[1]", "a[2]"]


def test_command_line(spark, pair, tmp_path, capsys):
    paths = []
    for g in pair:
        paths.append(str(tmp_path / f"{g.name}.graphml"))
        write_graph(g, paths[-1])
    assert main(["check", *paths, "--no-structural", "--no-findings", "--rule", "similarity>=0.5"], spark) == 0
    assert main(["check", *paths, "--no-structural", "--no-findings", "--rule", "similarity>=0.9"], spark) == 1
    assert main(["check", *paths, "--rule", "nonsense"], spark) == 2
    assert main(["inspect", paths[0]], spark) == 0
    assert '"n_edges": 3' in capsys.readouterr().out


@pytest.mark.parametrize("hub", [2, 1024])
def test_two_hop_whatever_the_share_of_a_hub(spark, monkeypatch, hub):
    monkeypatch.setattr(structure, "HUB", hub)
    edges = [("hub", f"n{i}") for i in range(9)] + [("n0", "n1"), ("n2", "far"), ("far", "end"), ("x", "y")]
    near: dict[str, set[str]] = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {u: len(set().union(*(near[v] for v in near[u])) - near[u] - {u}) for u in near}
    adj = spark.createDataFrame([(u, v) for u in near for v in near[u]], "u string, v string")
    assert {r.u: r.two_hop for r in structure.two_hop(adj).collect()} == {u: n for u, n in want.items() if n}
    assert structure.two_hop(adj.limit(0)).count() == 0


def test_two_hop_of_random_graphs_makes_no_wedges(spark):
    rng = random.Random(5)
    near: dict[str, set[str]] = {}
    for _ in range(900):
        u, v = rng.sample([f"n{i}" for i in range(400)], 2)
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {u: len(set().union(*(near[v] for v in near[u])) - near[u] - {u}) for u in near}
    adj = spark.createDataFrame([(u, v) for u in near for v in near[u]], "u string, v string")
    found = structure.two_hop(adj)
    assert {r.u: r.two_hop for r in found.collect()} == {u: n for u, n in want.items() if n}
    # between the edges and the counts are lists of neighbours, not the pairs of a join on the middle node
    assert "near" in found._jdf.queryExecution().analyzed().toString()
