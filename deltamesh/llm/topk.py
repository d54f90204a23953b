"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are documents whose terms are their components. Rows are cut into document ranges (blocks)
of alike vectors: a range is halved at the median along its main direction until it has at most
BLOCK rows. Every block keeps the largest and the smallest value of each term, its centre and its
radius. For a query the sum of the better of query * maximum and query * minimum bounds every score
in a block, and so does query * centre + |query| * radius; the smaller counts. Blocks are visited
per query in falling order of that bound, in rounds that grow fourfold, each block scored through
its own forward index (its dense rows), until the next bound is below the k-th best score. A score
equal to the k-th still counts, because ties go to the smaller id. The k best are distinct ids,
each with the best of its rows, and are kept over all of a partition's batches.

Queries go to the partitions in sets of at most QUERY_SET rows, whatever their number; each set is
one pass over the vectors. A first look at a bounded number of rows gives each query a k-th score
to start from, so that partitions send on only what can still be in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.llm.common import cut

BLOCK = 64
QUERY_SET = 8192
#: Rows of the first look; they only raise the bar, never decide.
SEED_ROWS = 4096
_LOWEST = -(1 << 62)
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows (vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite values are left out."""
    x = vectors[vec_col].cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(x.isNotNull() & vectors[id_col].isNotNull() & finite).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(column), max(width, int(lengths.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(column.flatten())
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in whole numbers; in doubles where they hold every partial sum exactly."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(n, 1)
    if high < _EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far; an id that repeats has one place, by its best score."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score, self.id = np.full((n, k), _LOWEST), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def bar(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], score], 1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        order = np.lexsort((-score, ids), axis=1)
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        score[:, 1:][ids[:, 1:] == ids[:, :-1]] = _LOWEST
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def ranges(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the starts of ranges of at most `most` alike rows in it."""
    x = v.astype(np.float64)
    order, starts, todo = np.arange(len(v)), [], [(0, len(v))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts += [a] if b > a else []
            continue
        own = x[order[a:b]]
        own = own - own.mean(0)
        # the main direction, by a few steps of the power method from the farthest row
        w = own[np.square(own).sum(1).argmax()]
        for _ in range(4):
            w = own.T @ (own @ (w / (np.abs(w).max() or 1.0)))
        by = np.argsort(own @ w, kind="stable")
        order[a:b] = order[a:b][by]
        todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return order, np.array(sorted(starts), np.int64)


def bounds(q: np.ndarray, v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each query and range a double that no score of the range exceeds."""
    size = np.diff(np.r_[starts, len(v)])
    high, low = np.maximum.reduceat(v, starts).astype(np.float64), np.minimum.reduceat(v, starts).astype(np.float64)
    x, centre = v.astype(np.float64), np.add.reduceat(v.astype(np.float64), starts) / size[:, None]
    radius = np.sqrt(np.maximum.reduceat(np.square(x - np.repeat(centre, size, axis=0)).sum(1), starts))
    n = min(q.shape[1], v.shape[1])
    q = q.astype(np.float64)
    terms = np.maximum(q, 0)[:, :n] @ high[:, :n].T + np.minimum(q, 0)[:, :n] @ low[:, :n].T
    length = np.sqrt(np.square(q).sum(1))[:, None]
    ball = q[:, :n] @ centre[:, :n].T + length * radius
    # room for what doubles round off, in proportion to what was summed
    room = 1e-9 * length * np.sqrt(np.square(np.maximum(np.abs(high), np.abs(low))).sum(1)) + 1
    return np.minimum(terms, ball) + room


def search(best: Best, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """Adds the best of these rows for each query; the number of (query, block) pairs scored, and of all."""
    if not len(ids) or not len(qid):
        return 0, 0
    order, starts = ranges(v, BLOCK)
    ids, v = ids[order], v[order]
    ends = np.r_[starts[1:], len(ids)]
    bound = bounds(q, v, starts)
    visit = np.argsort(-bound, axis=1, kind="stable")
    scored, a, width = 0, 0, 1
    alive = np.arange(len(q))
    while a < len(starts):
        bar = best.bar()
        alive = alive[bound[alive, visit[alive, a]] >= bar[alive]]
        if not len(alive):
            break
        block = visit[alive, a : a + width]
        row = np.repeat(alive, block.shape[1])
        block = block.ravel()
        by = np.argsort(block, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            k, rows = int(block[own[0]]), row[own]
            rows = rows[bound[rows, k] >= best.bar()[rows]]
            if not len(rows):
                continue
            part = ids[starts[k] : ends[k]]
            score = product(q[rows], v[starts[k] : ends[k]])
            score[qid[rows][:, None] == part[None, :]] = _LOWEST
            scored += len(rows)
            use = score.max(1) >= best.bar()[rows]
            if use.any():
                best.add(rows[use], score[use], part)
        a, width = a + width, width * 4
    return scored, len(q) * len(starts)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", query_set: int = QUERY_SET) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest inner products over all other rows.

    Queries are the rows whose id is divisible by `every`; ties go to the smaller id. Rows with a
    null id or an unusable vector take no part; vectors of different length meet as if the shorter
    went on in zeros. Rows that share an id and a vector count once, and a query never meets rows
    of its own id. Components and scores are 64-bit integers; what doesn't fit them wraps. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(integer_vectors(vectors, id_col, vec_col, scale).distinct(), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sets = max(1, -(-asked.count() // query_set))
    seed = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).toArrow()
    seed_rows = spark.sparkContext.broadcast((np.asarray(seed["vec_id"].combine_chunks()), dense(seed["v"], 0)))

    found = None
    for part in range(sets):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(sets)) == part).toArrow()
        if not own.num_rows:
            continue
        qid, q = np.asarray(own["vec_id"].combine_chunks()), dense(own["v"], 0)
        sent = spark.sparkContext.broadcast((qid, q))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            at = np.concatenate([np.asarray(b.column(0)) for b in batches] or [np.zeros(0, np.int64)])
            best = Best(len(at), k, np.full(len(at), _LOWEST))
            search(best, qid[at], q[at], seed_rows.value[0], seed_rows.value[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best.score[:, -1])], ["place", "floor"])

        first = spark.range(len(qid)).repartition(max(1, len(qid) // 256)).mapInArrow(look, "place long, floor long").toArrow()
        floor = np.full(len(qid), _LOWEST)
        floor[np.asarray(first["place"].combine_chunks())] = np.asarray(first["floor"].combine_chunks())
        start = spark.sparkContext.broadcast(floor)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, start=start) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            best = Best(len(qid), k, start.value)
            for batch in batches:
                search(best, qid, q, np.asarray(batch.column(0)), dense(batch.column(1), 0))
            at, place = np.nonzero((best.score > _LOWEST) & (best.score >= start.value[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(best.id[at, place]), pa.array(best.score[at, place])], ["query_id", "vec_id", "score"])

        here = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a row id can stand for several vectors: its best counts
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = cut(found, "candidates").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by DuckDB.
TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, max(list_inner_product(q::DOUBLE[], v::DOUBLE[]))::BIGINT AS score FROM q, v WHERE query_id <> vec_id GROUP BY query_id, vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
