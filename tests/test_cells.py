from __future__ import annotations

import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from deltamesh.model import graph
from deltamesh.operators import cells as cells_of
from deltamesh.operators import cluster, significance, structure
from deltamesh.plans import catalogue, fixtures


@pytest.fixture(scope="module")
def forms(spark):
    """A graph as edges only, and the same with cells: sizes 1 to 40, repeated rows, a cell apart."""
    rng = random.Random(3)
    cells = {f"c{i}": rng.sample(range(150), rng.choice([1, 2, 3, 5, 40])) for i in range(30)} | {"apart": [900, 901]}
    rows = [(f"n{u}", c) for c, own in cells.items() for u in own]
    pairs = {tuple(sorted((f"n{u}", f"n{v}"))) for own in cells.values() for u, v in combinations(own, 2)}
    edges = graph(spark.createDataFrame([(u, "t", v) for u, v in pairs], "source string, type string, target string"), directed=False)
    return edges, replace(edges, cells=spark.createDataFrame(rows + rows[:9], "label string, cell string"))


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def without_edges(spark, g):
    """The graph with a table of edges that fails where it is read."""
    boom = F.raise_error(F.lit("edges were read")).cast("string")
    return replace(g, edges=spark.range(3).select(boom.alias("source"), boom.alias("type"), boom.alias("target")))


def test_triangles_from_cells(spark, forms):
    edges, cells = forms
    want = rows_of(structure.triangles(structure.adjacency(edges)))
    assert want and rows_of(structure.triangles_of(without_edges(spark, cells))) == want
    assert rows_of(structure.triangles_of(edges)) == want
    none = replace(cells, nodes=cells.nodes.limit(0), cells=cells.cells.limit(0))
    assert structure.triangles_of(none).count() == 0


def test_the_nodes_of_shared_cells_are_the_ends_of_the_edges(spark):
    g = fixtures.co_events_whole(spark, "/root/testdata/sf0.001")
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("label")).distinct()
    assert rows_of(g.nodes) == rows_of(ends)
    assert catalogue.triangles(spark, "/root/testdata/sf0.001").count() > 0


def test_features_from_cells(spark, forms):
    edges, cells = forms
    assert rows_of(structure.local_features(without_edges(spark, cells))) == rows_of(structure.local_features(edges))


def test_weisfeiler_lehman_from_cells(spark, forms):
    edges, cells = forms
    own = structure.wl_labels({"x": without_edges(spark, cells)}, 2).groupBy("depth", "n").count()
    assert rows_of(own) == rows_of(structure.wl_labels({"x": edges}, 2).groupBy("depth", "n").count())


def test_pagerank_from_cells(spark, forms):
    edges, cells = forms
    assert rows_of(significance.pagerank_steps(without_edges(spark, cells), 8)) == rows_of(significance.pagerank_steps(edges, 8))


def test_triangles_and_features_where_cells_overlap_or_blocks_are_many(spark, monkeypatch):
    rng = random.Random(4)
    one = {f"d{i}": rng.sample(range(60), 30) for i in range(20)}  # nodes share several cells: edges are the fewer
    two = {f"c{i}": rng.sample(range(300), 9) for i in range(120)}
    monkeypatch.setattr(cells_of, "WORDS", 2)
    monkeypatch.setattr(cells_of, "GROUP", 50)
    for cells, few in ((one, False), (two, True)):
        edges, own = both_forms(spark, cells)
        assert cells_of.Projection(own).cells.few() == few
        assert rows_of(structure.triangles_of(without_edges(spark, own))) == rows_of(structure.triangles(structure.adjacency(edges)))
        assert rows_of(structure.local_features(without_edges(spark, own))) == rows_of(structure.local_features(edges))


def both_forms(spark, cells):
    pairs = {tuple(sorted((f"n{u}", f"n{v}"))) for own in cells.values() for u, v in combinations(own, 2)}
    edges = graph(spark.createDataFrame([(u, "t", v) for u, v in pairs], "source string, type string, target string"), directed=False)
    return edges, replace(edges, cells=spark.createDataFrame([(f"n{u}", c) for c, own in cells.items() for u in own], "label string, cell string"))


def test_spectra_from_cells(spark, forms):
    rng = random.Random(5)
    large = both_forms(spark, {f"c{i}": rng.sample(range(600), 6) for i in range(300)})
    overlapping = both_forms(spark, {f"c{i}": [x + 450 * (i % 2) for x in rng.sample(range(450), 200)] for i in range(12)})
    for edges, cells in (forms, large, overlapping):
        want, got = structure.spectrum(edges), structure.spectrum(without_edges(spark, cells))
        assert max(abs(want - got)) < 1e-6
    none = replace(forms[1], cells=forms[1].cells.limit(0))
    assert structure.spectrum(none) is None


def test_communities_from_cells(spark, forms, monkeypatch):
    monkeypatch.setattr(cells_of, "BLOCK", 300)
    rng = random.Random(6)
    grouped = both_forms(spark, {f"c{i}": rng.sample(range(40 * (i % 5), 40 * (i % 5) + 48), 5) for i in range(90)})
    for edges, cells in (forms, grouped):
        for resolution in (0.3, 1.0, 4.0):
            want = rows_of(cluster.communities(edges, resolution)[0])
            for kw in ({}, {"local_edges": 0}):
                assert rows_of(cluster.communities(without_edges(spark, cells), resolution, **kw)[0]) == want


def test_clusters_of_shared_cells_need_no_table_of_edges(spark):
    u = catalogue.diff(fixtures.co_events(spark, "/root/testdata/sf0.001"))
    boom = F.raise_error(F.lit("edges were read")).cast("string")
    unread = replace(u, edges=u.edges.limit(0).withColumns({c: boom for c in ("source", "type", "target", "status")}).unionByName(spark.range(1).select(*[(boom if t == "string" else F.lit(None).cast(t)).alias(c) for c, t in u.edges.dtypes])))
    for most in (60, 2):
        for resolution in (1.0, 3.0):
            want = rows_of(cluster.clusters_of(replace(u, cells=None), resolution=resolution, most=most).clusters)
            assert want and rows_of(cluster.clusters_of(unread, resolution=resolution, most=most).clusters) == want
