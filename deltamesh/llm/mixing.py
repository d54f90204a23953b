"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, the targets are levelled in one pass over the (small) source table,
each source's repetition rate is target / size, and a document is taken floor(rate) times plus one
more time by a hash-seeded draw whose probability is the rate's fraction.

The draw compares a document's hash position u, 52 bits in [0, 1), with the fraction: a document is
taken once more if u, moved on by its source's offset around the circle, lies below the fraction.
For every offset that is a draw with the fraction as its probability. Independent draws alone
scatter about the target, widely for small sources, so of OFFSETS evenly spaced offsets each source
takes the one whose words come nearest to fraction * size (the first of equals). The same seed
gives the same documents again, whatever the partitioning.

The plan is a table of one row per source and is levelled in one task; sources are names of
collections, of which a corpus has thousands, not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.llm.common import cut

OFFSETS = 32
WORD = r"[^\x20\x09-\x0D]+"
MOST = 3


def word_count(text: Column) -> Column:
    """Number of words; a word starts where a separator, or the text's start, precedes a word character."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def position(seed: int) -> Column:
    """A document's hash position: the first thirteen hexadecimal digits of an md5 over all it is, as a fraction."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return F.conv(F.substring(F.md5(whole), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def drawn(u: Column, offset: Column, fraction: Column) -> Column:
    """1 where the position, moved on by the offset (in parts of OFFSETS), lies below the fraction, else 0."""
    moved = u + offset.cast("double") / F.lit(float(OFFSETS))
    return F.when(moved - F.floor(moved) < fraction, 1).otherwise(0)


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source: size, target, whole repeats, the fraction and the draw's offset; from rows (source, size, u)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    # water filling: sources in the order in which they reach their cap; the first that can hold
    # its share of what is left fixes the level for itself and all behind it
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    filled = (
        weighed.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * MOST).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.col("capped_before")).cast("double") / F.col("weight_left"))
        .withColumn("holds", F.col("source_size") * MOST >= F.col("level") * F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("holds"), F.struct("place", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("source_size").cast("double") * MOST, F.col("level") * F.col("weight")))
        .withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("fraction", F.col("rate") - F.col("whole"))
        .select("source", "source_size", "target", "whole", "fraction")
    )
    filled = cut(filled, "mix-targets")
    name = filled.select(F.col("source").alias("s"), "fraction")
    sums = [F.sum(F.col("size") * drawn(F.col("u"), F.lit(j), F.col("fraction"))).alias(f"sum{j}") for j in range(OFFSETS)]
    sums = sized.join(name, F.col("source").eqNullSafe(F.col("s"))).groupBy("source", "fraction").agg(F.sum("size").alias("held"), *sums)
    misses = [F.struct(F.abs(F.col(f"sum{j}") - F.col("fraction") * F.col("held")).alias("miss"), F.lit(j).alias("offset")) for j in range(OFFSETS)]
    nearest = sums.select(F.col("source").alias("s"), F.array_min(F.array(*misses))["offset"].alias("offset"))
    return filled.join(nearest, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix_sources(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, source, copies, taken), one for each input row.

    Null texts and texts without words have size 0 and are taken 0 words (0 * copies). A null
    source is a source of its own, weighed last. With no words at all every target is 0. Rows
    alike in id, source and text share their draw. An empty table gives an empty result. Columns
    named like the working ones don't clash: only the three named columns are read.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"))
    sized = cut(slim.select("doc_id", "source", word_count(F.col("text")).alias("size"), position(seed).alias("u")), "mix-sizes")
    plan = cut(source_plan(sized), "mix-sources")
    mixed = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    copies = (F.col("whole") + drawn(F.col("u"), F.col("offset"), F.col("fraction"))).alias("copies")
    return mixed.select("doc_id", "size", "source_size", "target", "source", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emit_mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document of `docs` (doc_id, text, source among its columns) as often as it is taken.

    Null and wordless texts are taken as often as others of their source; a null source is a source
    of its own. Rows alike in id, source and text share their draw. Whatever columns docs has, none
    is mistaken for a working one. Empty docs give an empty mix.
    """
    sized = cut(docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), position(seed).alias("u")), "mix-sizes")
    own = "__mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    plan = cut(source_plan(sized), "mix-sources").select(F.struct("source", "whole", "offset", "fraction").alias(own))
    placed = docs.join(plan, docs["source"].cast("string").eqNullSafe(F.col(f"{own}.source")))
    copies = F.col(f"{own}.whole") + drawn(position(seed), F.col(f"{own}.offset"), F.col(f"{own}.fraction"))
    return placed.withColumn(f"{own}_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[docs[c] for c in docs.columns])


#: The same by DuckDB, with the level as the highest over all guesses of who is capped.
MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '17', doc_id::VARCHAR, source, text)), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
guess AS (
  SELECT max(((SELECT sum(source_size) FROM src) - coalesce(capped, 0))::DOUBLE / open_w) AS level FROM (
    SELECT a.source,
           sum(b.source_size * 3) FILTER (b.source_size / b.w < a.source_size / a.w) AS capped,
           sum(b.w) FILTER (b.source_size / b.w >= a.source_size / a.w) AS open_w
    FROM src a, src b GROUP BY a.source)),
goal AS (
  SELECT source, source_size, least(source_size::DOUBLE * 3, level * w) AS target,
         coalesce(target / nullif(source_size, 0), 0) AS rate, floor(rate)::BIGINT AS whole, rate - whole AS fraction
  FROM src, guess),
tried AS (
  SELECT g.source, j, abs(sum(CASE WHEN u + j::DOUBLE / 32 - floor(u + j::DOUBLE / 32) < g.fraction THEN size ELSE 0 END)::BIGINT - g.fraction * sum(size)::BIGINT) AS miss
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source, (SELECT unnest(range(32)) AS j) GROUP BY g.source, g.fraction, j),
best AS (SELECT source, arg_min(j, (miss, j)) AS j FROM tried GROUP BY source)
SELECT s.doc_id, s.size, g.source_size, g.target,
       (s.size * (g.whole + CASE WHEN u + b.j::DOUBLE / 32 - floor(u + b.j::DOUBLE / 32) < g.fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""
