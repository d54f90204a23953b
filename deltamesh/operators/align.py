"""Aligning nodes whose labels differ: exact, normalised and fuzzy matches, one to one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.functions.text import normalized, trigrams
from deltamesh.model import PropertyGraph, ratio
from deltamesh.operators.frames import settled

COLUMNS = "label_a string, label_b string, method string, label_similarity double, structural_similarity double, score double, confidence double, runner_up double"


@dataclass(frozen=True)
class AlignOptions:
    """method: exact, normalized or fuzzy; each includes those before."""

    method: str = "exact"
    threshold: float = 0.6
    label_weight: float = 0.6
    trigram_floor: float = 0.25
    max_candidates: int = 10
    rounds: int = 2
    max_work: int = 20_000_000


def exact_matches(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """(label_a, label_b) of labels that both graphs have."""
    own = a.nodes.select("label").join(b.nodes.select("label"), "label")
    return own.select(F.col("label").alias("label_a"), F.col("label").alias("label_b"))


def residual(g: PropertyGraph, matched: DataFrame, column: str) -> DataFrame:
    """Labels of g that no match has."""
    return g.nodes.select("label").join(matched.select(F.col(column).alias("label")), "label", "left_anti")


def normalized_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of residual labels with one normal form, where it is not empty and unique on both sides."""

    def unique(labels: DataFrame, name: str) -> DataFrame:
        forms = labels.select(normalized(F.col("label")).alias("form"), "label").where("form <> ''")
        return forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.first("label").alias(name)).where("n = 1").drop("n")

    return unique(a, "label_a").join(unique(b, "label_b"), "form").select("label_a", "label_b")


def candidates(a: DataFrame, b: DataFrame, options: AlignOptions = AlignOptions()) -> DataFrame:
    """Candidate pairs (label_a, label_b, label_similarity) by shared trigrams.

    Trigrams are kept from the rarest on while the sum of the pairs they make stays within
    max_work; those left out still count in the sizes. The k best partners of each A label stay.
    """
    ga = a.select(F.col("label").alias("label_a"), F.explode(trigrams(F.col("label"))).alias("gram"))
    gb = b.select(F.col("label").alias("label_b"), F.explode(trigrams(F.col("label"))).alias("gram"))
    df = ga.groupBy("gram").agg(F.count(F.lit(1)).alias("na")).join(gb.groupBy("gram").agg(F.count(F.lit(1)).alias("nb")), "gram")
    # the vocabulary of trigrams is small whatever the number of labels
    spent = F.sum("work").over(Window.orderBy("work", "gram").rowsBetween(Window.unboundedPreceding, 0))
    kept = df.select("gram", (F.col("na") * F.col("nb")).alias("work")).withColumn("spent", spent).where(F.col("spent") <= options.max_work).select("gram")
    shared = ga.join(kept, "gram", "left_semi").join(gb, "gram").groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    size = lambda c: F.size(trigrams(F.col(c)))
    na, nb, n = size("label_a"), size("label_b"), F.col("n")
    scored = shared.select("label_a", "label_b", ((ratio(n, na + nb - n) + ratio(n, F.least(na, nb))) / 2).alias("label_similarity")).where(F.col("label_similarity") >= options.trigram_floor)
    order = Window.partitionBy("label_a").orderBy(F.col("label_similarity").desc(), F.col("label_b").asc())
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.max_candidates).drop("place")


def structural_scores(pairs: DataFrame, a: PropertyGraph, b: PropertyGraph, matched: DataFrame) -> DataFrame:
    """pairs with structural_similarity: Jaccard of the matched neighbours of either side; null if neither has any."""
    anchors = matched.select("label_a", "label_b")
    near_a = a.neighbors().join(anchors, F.col("neighbor") == F.col("label_a")).select("label", F.col("label_a").alias("anchor")).groupBy("label").agg(F.collect_set("anchor").alias("sa")).withColumnRenamed("label", "label_a")
    near_b = b.neighbors().join(anchors, F.col("neighbor") == F.col("label_b")).select("label", F.col("label_a").alias("anchor")).groupBy("label").agg(F.collect_set("anchor").alias("sb")).withColumnRenamed("label", "label_b")
    empty = F.array().cast("array<string>")
    sa, sb = F.coalesce("sa", empty), F.coalesce("sb", empty)
    both, either = F.size(F.array_intersect(sa, sb)), F.size(F.array_union(sa, sb))
    joined = pairs.join(near_a, "label_a", "left").join(near_b, "label_b", "left")
    return joined.select(*pairs.columns, F.when(either > 0, ratio(both, either)).alias("structural_similarity"))


def blended(pairs: DataFrame, weight: float) -> DataFrame:
    """score = weight * label + (1 - weight) * structure, or the label's alone."""
    mix = weight * F.col("label_similarity") + (1 - weight) * F.col("structural_similarity")
    return pairs.withColumn("score", F.coalesce(mix, F.col("label_similarity")))


def with_runner_up(pairs: DataFrame) -> DataFrame:
    """The second-best score of each A label, on its best candidate only."""
    order = Window.partitionBy("label_a").orderBy(F.col("score").desc(), F.col("label_b").asc())
    return pairs.withColumn("runner_up", F.when(F.row_number().over(order) == 1, F.lead("score").over(order)))


def assign(pairs: DataFrame, threshold: float) -> DataFrame:
    """One-to-one pairs, as greedy choice by (score falling, label_a, label_b) makes them.

    Each turn takes all pairs that come first for both of their labels and drops the rest of those
    labels; under a strict order that equals taking pairs one by one. Every turn takes at least the
    best pair left, and a tie to break is broken by the labels.
    """
    names = pairs.columns
    left = settled(pairs.where(F.col("score") >= threshold))
    taken = None
    rank = (F.col("score").desc(), F.col("label_a").asc(), F.col("label_b").asc())
    while not left.isEmpty():
        firsts = left.withColumns({"__a": F.row_number().over(Window.partitionBy("label_a").orderBy(*rank)), "__b": F.row_number().over(Window.partitionBy("label_b").orderBy(*rank))})
        won = settled(firsts.where("__a = 1 and __b = 1").select(*names))
        taken = won if taken is None else taken.unionByName(won)
        left = settled(left.join(won.select("label_a"), "label_a", "left_anti").join(won.select("label_b"), "label_b", "left_anti").select(*names))
    return taken if taken is not None else left


def confidence(matches: DataFrame) -> DataFrame:
    """score, less half the runner-up where there is one."""
    return matches.withColumn("confidence", F.col("score") - F.coalesce(F.col("runner_up"), F.lit(0.0)) / 2)


@dataclass(frozen=True)
class Alignment:
    """pairs: see COLUMNS; what is left over on each side; the options used."""

    pairs: DataFrame
    unmatched_a: DataFrame
    unmatched_b: DataFrame
    options: AlignOptions

    def counts(self) -> DataFrame:
        return self.pairs.groupBy("method").agg(F.count(F.lit(1)).alias("n"))

    def inexact(self) -> DataFrame:
        return self.pairs.where("method <> 'exact'").orderBy("confidence", "label_a")

    def mapping(self) -> DataFrame:
        return self.pairs.select("label_b", "label_a")

    def summary(self) -> dict:
        return {"methods": {r["method"]: r["n"] for r in self.counts().collect()}, "unmatched_a": self.unmatched_a.count(), "unmatched_b": self.unmatched_b.count(), "options": self.options.__dict__}


def align(a: PropertyGraph, b: PropertyGraph, options: AlignOptions = AlignOptions()) -> Alignment:
    if options.method not in ("exact", "normalized", "fuzzy"):
        raise ValueError(f"unknown method {options.method!r}")
    none, one = F.lit(None).cast("double"), F.lit(1.0)

    def certain(pairs: DataFrame, method: str) -> DataFrame:
        return pairs.select("label_a", "label_b", F.lit(method).alias("method"), one.alias("label_similarity"), none.alias("structural_similarity"), one.alias("score"), one.alias("confidence"), none.alias("runner_up"))

    pairs = certain(exact_matches(a, b), "exact")
    if options.method != "exact":
        pairs = pairs.unionByName(certain(normalized_matches(residual(a, pairs, "label_a"), residual(b, pairs, "label_b")), "normalized"))
    if options.method == "fuzzy":
        pairs = settled(pairs)
        found = settled(candidates(residual(a, pairs, "label_a"), residual(b, pairs, "label_b"), options))
        for _ in range(options.rounds):
            live = found.join(pairs.select("label_a"), "label_a", "left_anti").join(pairs.select("label_b"), "label_b", "left_anti")
            scored = with_runner_up(blended(structural_scores(live, a, b, pairs), options.label_weight))
            won = confidence(assign(scored, options.threshold)).withColumn("method", F.lit("fuzzy")).select(*pairs.columns)
            won = settled(won)
            if won.isEmpty():
                break
            pairs = settled(pairs.unionByName(won))
    return Alignment(pairs, residual(a, pairs, "label_a"), residual(b, pairs, "label_b"), options)
