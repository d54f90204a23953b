"""Directories and sequences of graphs: all-pairs matrices and timelines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltamesh.model import PropertyGraph
from deltamesh.operators.significance import surprises
from deltamesh.operators.union import build_union
from deltamesh.plans import series
from deltamesh.plans.report import SCALAR_METRICS, Finding, compare, jsonable
from deltamesh.sources import read_graph

_STACKED = tuple(m for m in SCALAR_METRICS if m.endswith(("nodes", "edges")) or m.startswith("ged"))


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeated names get their place."""
    names = list(names)
    many = Counter(names)
    return [f"{n}[{i}]" if many[n] > 1 else n for i, n in enumerate(names)]


def matrix(graphs: dict[str, PropertyGraph], metrics: Iterable[str] | None = None, include_self: bool = False) -> DataFrame:
    """(graph_a, graph_b, metric, raw_score, shared_subgraph_score) for every unordered pair.

    Set and edit-distance metrics come from one job over all graphs stacked; other metrics need the
    pair's comparison. Repeated edges or labels raise before anything is compared.
    """
    wanted = list(metrics or SCALAR_METRICS)
    if unknown := [m for m in wanted if m not in SCALAR_METRICS]:
        raise KeyError(unknown[0])
    for g in graphs.values():
        g.validate()
    parts = []
    if cheap := [m for m in wanted if m in _STACKED]:
        parts.append(series.tidy(series.all_pairs(series.stacked(graphs), series.stacked_labels(graphs), include_self)).where(F.col("metric").isin(cheap)))
    rest = [m for m in wanted if m not in _STACKED]
    if rest:
        names = sorted(graphs)
        for i, x in enumerate(names):
            for y in names[i if include_self else i + 1 :]:
                r = compare(graphs[x], graphs[y], structural=any(m in rest for m in ("degree_js_similarity", "spectral_similarity", "netsimile_similarity", "wl_similarity")), findings=False)
                parts.append(r.to_frame().where(F.col("metric").isin(rest)).withColumns({"graph_a": F.lit(x), "graph_b": F.lit(y)}))
                r.union.unpersist()
    return reduce(DataFrame.unionByName, parts).orderBy("graph_a", "graph_b", "metric")


def matrix_of_files(spark: SparkSession, paths: Iterable[str], metrics: Iterable[str] | None = None, include_self: bool = False) -> DataFrame:
    graphs = [read_graph(spark, p) for p in paths]
    return matrix(dict(zip(unique_names(g.name for g in graphs), graphs, strict=True)), metrics, include_self)


@dataclass(frozen=True)
class Timeline:
    """Snapshots in order, compared step by step; all frames are long."""

    names: list[str]
    churn: DataFrame
    history: DataFrame
    presence: DataFrame
    scored: DataFrame

    @property
    def n_steps(self) -> int:
        return len(self.names) - 1

    @property
    def step_labels(self) -> list[str]:
        return [f"{a} -> {b}" for a, b in zip(self.names, self.names[1:], strict=False)]

    def flickers(self) -> DataFrame:
        return series.flickers(self.presence)

    def recurrent(self, min_steps: int = 2) -> DataFrame:
        return series.recurrent(self.scored, min_steps)

    def metric(self, name: str) -> DataFrame:
        return self.churn.select("step", F.col(name).alias("value")).orderBy("step")

    def findings(self) -> list[Finding]:
        out = []
        t = series.trend(self.churn).first()
        if t["n_steps"] and t["top_share"] >= 0.5 and t["n_steps"] > 1:
            out.append(Finding("dominant_step", "high", f"Step {self.step_labels[t['top_step']]} dominates", f"It holds {t['top_share']:.0%} of what came and went."))
        elif t["n_steps"] > 1 and t["top_share"] > 0:
            out.append(Finding("steady" if t["cv"] < 0.5 else "spread", "low", "Steady drift" if t["cv"] < 0.5 else "Change is spread over the steps", f"Variation {t['cv']:.2f}."))
        if t["n_steps"] >= 3 and t["slope"] is not None and abs(t["slope"]) >= 0.02:
            out.append(Finding("trend", "medium", "Similarity falls" if t["slope"] < 0 else "Similarity rises", f"{t['slope']:+.3f} a step."))
        flick = self.flickers()
        half = max(2, -(-self.n_steps // 2))
        again = self.recurrent(half).join(flick.select("label"), "label", "left_anti").orderBy(F.col("steps").desc(), F.col("total").desc(), "label").limit(5).collect()
        if again:
            out.append(Finding("recurrent", "medium", "The same nodes change again and again", f"In at least {half} steps each.", tuple(r["label"] for r in again)))
        some = flick.orderBy(F.col("transitions").desc(), "label").limit(5).collect()
        if some:
            out.append(Finding("flicker", "medium", "Nodes come and go", "", tuple(r["label"] for r in some)))
        return out

    def to_dict(self) -> dict:
        return jsonable({"snapshots": self.names, "churn": self.churn.orderBy("step").collect(), "findings": [f.to_dict() for f in self.findings()], "flickers": self.flickers().orderBy("label").collect(), "history": self.history.collect()})

    def to_markdown(self) -> str:
        rows = self.churn.orderBy("step").collect()
        lines = ["| step | nodes - | nodes + | edges - | edges + | altered | similarity |", "|-|-|-|-|-|-|-|"]
        lines += [f"| {self.step_labels[r['step']]} | {r['nodes_removed']} | {r['nodes_added']} | {r['edges_removed']} | {r['edges_added']} | {r['edges_reweighted']} | {r['similarity']:.4f} |" for r in rows]
        return "\n".join(lines + [""] + [f"- **{f.title}** {f.detail}".rstrip() for f in self.findings()]) + "\n"


def timeline(graphs: list[PropertyGraph], top_nodes: int = 50) -> Timeline:
    """Compare consecutive snapshots. Churn and presence of all steps are one job each; scores are one union per step."""
    names = unique_names(g.name for g in graphs)
    for g in graphs:
        g.validate()
    by_place = dict(enumerate(graphs))
    edges, nodes = series.stacked(by_place, "idx").persist(), series.stacked_labels(by_place, "idx").persist()
    scored = reduce(DataFrame.unionByName, [surprises(build_union(a, b)).select(F.lit(i).alias("step"), "label", "significance") for i, (a, b) in enumerate(zip(graphs, graphs[1:], strict=False))]).persist()
    return Timeline(names, series.churn(edges, nodes).persist(), series.node_history(scored, top_nodes), series.presence(edges, nodes).persist(), scored)
