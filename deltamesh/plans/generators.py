"""Made-up graphs with known differences: random pairs, block models, renamed copies, snapshots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltamesh.model import PropertyGraph, graph


def random_pair(spark: SparkSession, nodes: int = 200_000, edges: int = 500_000, drop: float = 0.1, reweight: float = 0.2, add: float = 0.1, seed: int = 1) -> tuple[PropertyGraph, PropertyGraph]:
    """A random graph and its copy with edges dropped, reweighted and added, by hashes of the edge's number."""

    def part(salt: int, modulus: int):
        return F.pmod(F.xxhash64("id", F.lit(seed * 100 + salt)), F.lit(modulus))

    def made(frame: DataFrame) -> DataFrame:
        return frame.select(F.concat(F.lit("n"), part(1, nodes)).alias("source"), F.concat(F.lit("t"), part(3, 3)).alias("type"), F.concat(F.lit("n"), part(2, nodes)).alias("target"), (part(4, 1000) / 100.0).alias("weight"), part(5, 10_000).alias("__d"), part(6, 10_000).alias("__r")).dropDuplicates(["source", "type", "target"])

    rows = made(spark.range(edges))
    a = rows.drop("__d", "__r")
    kept = rows.where(F.col("__d") >= drop * 10_000).withColumn("weight", F.col("weight") + F.when(F.col("__r") < reweight * 10_000, 1.0).otherwise(0.0)).drop("__d", "__r")
    extra = made(spark.range(edges, edges + int(edges * add))).drop("__d", "__r").join(a, ["source", "type", "target"], "left_anti")
    return graph(a, name="a"), graph(kept.unionByName(extra), name="b")


def block_pair(spark: SparkSession, blocks: int = 28, size: int = 110, changed: int = 3, seed: int = 5) -> tuple[PropertyGraph, PropertyGraph]:
    """A block model in which half the inner edges of `changed` blocks are rewired in B."""
    rng = np.random.default_rng(seed)
    a, b, seen = [], [], set()
    for c in range(blocks):
        for _ in range(size * 3):
            x, y = rng.integers(0, size, 2).tolist()
            e = (f"b{c:02d}-{x:03d}", "inner", f"b{c:02d}-{y:03d}")
            if x == y or e in seen:
                continue
            seen.add(e)
            a.append((*e, 1.0))
            if c >= changed or rng.random() < 0.5:
                b.append((*e, 1.0))
    for _ in range(blocks * size // 4):
        c, d = rng.integers(0, blocks, 2).tolist()
        x, y = rng.integers(0, size, 2).tolist()
        e = (f"b{c:02d}-{x:03d}", "outer", f"b{d:02d}-{y:03d}")
        if c != d and e not in seen:
            seen.add(e)
            a.append((*e, 1.0))
            b.append((*e, 1.0))
    schema = "source string, type string, target string, weight double"
    return graph(spark.createDataFrame(a, schema), name="a"), graph(spark.createDataFrame(b, schema), name="b")


def renamed_copy(g: PropertyGraph, share: float = 0.1, seed: int = 2) -> tuple[PropertyGraph, DataFrame]:
    """A copy with some labels rewritten by case, suffix, separator or a typo, and the truth (label_a, label_b)."""
    h = F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(10_000))
    kind = F.pmod(F.xxhash64("label", F.lit(seed + 1)), F.lit(4))
    label = F.col("label")
    new = F.when(kind == 0, F.upper(label)).when(kind == 1, F.concat(label, F.lit(" Inc."))).when(kind == 2, F.regexp_replace(label, "[- ]", "_")).otherwise(F.regexp_replace(label, "(.)$", "x$1"))
    truth = g.nodes.select(label.alias("label_a"), F.when(h < share * 10_000, new).otherwise(label).alias("label_b"))
    own = truth.select(F.col("label_a").alias("__old"), F.col("label_b").alias("__new"))

    def renamed(df: DataFrame, c: str) -> DataFrame:
        return df.join(own, df[c] == F.col("__old")).withColumn(c, F.col("__new")).drop("__old", "__new")

    return PropertyGraph(renamed(g.nodes, "label"), renamed(renamed(g.edges, "source"), "target"), g.directed, f"{g.name}-renamed"), truth


def snapshots(spark: SparkSession, steps: int = 6, size: int = 80, event: int = 3, seed: int = 4) -> list[PropertyGraph]:
    """A drifting graph with one large event, a block that changes at every step, and nodes that come and go."""
    rng = np.random.default_rng(seed)
    pair = lambda c: tuple(f"c{c:02d}-{x:03d}" for x in rng.integers(0, size, 2).tolist())
    current = {(x, "link", y) for c in range(6) for _ in range(size * 2) for x, y in [pair(c)] if x != y}
    out = []
    for i in range(steps):
        if i:
            gone = int(len(current) * (0.3 if i == event else 0.01))
            for e in [sorted(current)[k] for k in rng.choice(len(current), gone, replace=False).tolist()]:
                current.discard(e)
            current |= {(x, "link", y) for _ in range(30) for x, y in [pair(1)] if x != y}
        flick = {(f"flick-{k}", "link", f"c02-{k:03d}") for k in range(5)} if i % 2 else set()
        rows = [(*e, 1.0) for e in sorted(current | flick)]
        out.append(graph(spark.createDataFrame(rows, "source string, type string, target string, weight double"), name=f"t{i}"))
    return out
