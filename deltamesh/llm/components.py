"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.llm.common import cut


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every id in links (a, b); component is the smallest id reachable.

    Each round is two shuffles and a written table; the number of rounds grows with the logarithm
    of the longest path. Every step is a minimum per id and a join back, so that an id with very
    many links is pre-aggregated before the shuffle and split by the join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct(), "links")
        # done once every id points at one that points nowhere: one parent each, and no parent has a parent
        flat = edges.select("u").unionByName(edges.select(F.col("v").alias("u")).distinct()).groupBy("u").count().where("count > 1")
        if flat.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return cut(members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
