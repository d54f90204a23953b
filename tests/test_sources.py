from __future__ import annotations

import json

import pytest

from deltamesh.model import graph
from deltamesh.sources import GraphFormatError, detect_format, discover_graphs, provenance, read_graph, write_graph


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c<&>", "z", None)], "label string, kind string, size long")
    edges = spark.createDataFrame([("a", "knows", "b", 1.5), ("b", "owns", "c<&>", None)], "source string, type string, target string, weight double")
    return graph(edges, nodes, name="small")


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["g.graphml", "g.json", "g_dir"])
def test_round_trip(spark, small, tmp_path, name):
    path = str(tmp_path / name)
    write_graph(small, path)
    back = read_graph(spark, path)
    assert back.directed
    assert rows(back.edges) == rows(small.edges)
    assert rows(back.nodes) == rows(small.nodes)


def test_edge_list_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "g.tsv")
    write_graph(small, path)
    assert rows(read_graph(spark, path).edges) == rows(small.edges)


def test_headers_and_no_header(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("From;To;Relation;weight\na;b;r;x\nb;c;s;2\n")
    g = read_graph(spark, str(p))
    assert rows(g.edges.select("source", "type", "target", "weight")) == sorted([(("source", "a"), ("target", "b"), ("type", "r"), ("weight", None)), (("source", "b"), ("target", "c"), ("type", "s"), ("weight", 2.0))], key=str)
    for text, want in (
        ("p,q,likes,4\nq,r,hates,0.5\n", [("p", "likes", "q", 4.0), ("q", "hates", "r", 0.5)]),
        ("p,q,likes\nq,r,hates\n", [("p", "likes", "q"), ("q", "hates", "r")]),
        ("p q\nq r\n", [("p", "", "q"), ("q", "", "r")]),
        ("p|q|likes|4|x y\nq|r|hates|0.5|z w\n", [("p", "likes", "q", 4.0, "x y"), ("q", "hates", "r", 0.5, "z w")]),
    ):
        p.write_text(text)
        assert sorted(map(tuple, read_graph(spark, str(p)).edges.collect())) == want


def test_graphml_defaults_and_missing_nodes(spark, tmp_path):
    p = tmp_path / "d.graphml"
    p.write_text("""<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="k0" for="node" attr.name="n" attr.type="int"><default>7</default></key><key id="k1" for="edge" attr.name="relation" attr.type="string"/>
<graph edgedefault="undirected"><node id="b"><data key="k0">3</data></node><node id="a"/><edge source="b" target="a"><data key="k1">r</data></edge><edge source="a" target="z"/></graph></graphml>""")
    g = read_graph(spark, str(p))
    assert not g.directed
    assert {r["label"]: r["n"] for r in g.nodes.collect()} == {"a": 7, "b": 3, "z": None}
    assert {(r["source"], r["type"], r["target"]) for r in g.edges.collect()} == {("a", "r", "b"), ("a", "", "z")}


def test_node_link_infers_nodes(spark, tmp_path):
    p = tmp_path / "n.json"
    p.write_text(json.dumps({"directed": False, "nodes": [], "edges": [{"source": "b", "target": "a", "weight": 2}]}))
    g = read_graph(spark, str(p))
    assert not g.directed and {r["label"] for r in g.nodes.collect()} == {"a", "b"}


def test_detection(tmp_path):
    for text, kind in (("<graphml/>", "graphml"), ("{}", "json"), ("a,b\n", "csv")):
        p = tmp_path / "x.dat"
        p.write_text(text)
        assert detect_format(str(p)) == kind
    for text in ("nothing", "a line of prose without any table\nand one more", ""):
        p.write_text(text)
        with pytest.raises(GraphFormatError):
            detect_format(str(p))


def test_discovery_and_provenance(tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n")
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "c.md").write_text("")
    assert [x.rsplit("/", 1)[1] for x in discover_graphs(str(tmp_path))] == ["a.json", "b.csv"]
    assert provenance(str(tmp_path / "b.csv"))["bytes"] == 4
