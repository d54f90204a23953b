"""Language-model scores: context-tree weighting over binary-decomposed bytes, beside a unigram base.

A byte is eight binary decisions down a tree of 255 nodes. Each node has a context tree over the
DEPTH bytes before: every context keeps zeros and ones seen, estimates by Krichevsky and Trofimov,
and mixes its own estimate half and half with the product of its longer contexts. The posterior of
that mix at every depth gives the predictive probability of each bit.

What is gathered is a table of grams (DEPTH bytes and the one after) with their counts, which grows
with the corpus. It is dealt by the three nearest bytes of context: all longer contexts of such a
group are its own, so one task folds the group's trees from the deepest contexts up and keeps, for
each gram, the mix of depths 3 to DEPTH. A group has at most 256 ** (DEPTH - 2) grams. Only the
sums of depth 2 and above, of at most 65,536 contexts, go to the driver, whose weights complete
the mix. Grams that only held-out texts have are in the table with the count 0, so every position
scored has its row: frequent grams, at most HEAD_GRAMS of them, go to the executors as an array,
all others are joined.

The base needs the count of every word. Frequent words, at most HEAD of them, go to the executors
as a table; occurrences of all others are joined with the full count table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.llm.common import bucket_crc, cut
from deltamesh.llm.textarrays import Lookup, Slice, mixed, slices_of, words_of

#: Bytes of context.
DEPTH = 5
HEAD, HEAD_GRAMS = 1 << 18, 1 << 19
#: Distinct keys a training task holds before it passes them on.
HELD = 1_000_000
#: Bytes of text handled at once: a gram and what looks it up take some hundred bytes for each.
SLICE = 400_000
#: Grams folded at once, and expected in one task.
FOLDED, TASK_GRAMS = 100_000, 2_000_000
_WORD, _BYTES, _DOCS = 0, 1, 2
#: Depths above a group's trees: 0 to _TOP.
_TOP = 2


def grams(s: Slice, depth: int) -> np.ndarray:
    """Each byte with the `depth` bytes before it (zeros before a document) as one number: nearest byte first, the byte itself last."""
    b = s.body.astype(np.uint64)
    out = b.copy()
    start = s.bounds[:-1][np.diff(s.bounds) > 0]
    for d in range(1, depth + 1):
        before = np.zeros(len(b), np.uint64)
        before[d:] = b[:-d]
        for near in range(min(d, depth)):  # the first d bytes of a document have none so far back
            at = start + near
            before[at[at < len(b)]] = 0
        out |= before << np.uint64(8 * (depth - d + 1))
    return out.view(np.int64)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a string with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: eight steps up, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift += np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y += small
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _half_of(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixed log probability of a node, and the posterior weight of its own estimate."""
    mix = np.log(0.5) + np.logaddexp(own, below)
    return mix, np.exp(np.log(0.5) + own - mix)


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _parents(entry: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Entries with the farthest byte of context dropped, each entry's parent, and the values summed by parent; entries are sorted."""
    up = entry >> 8
    head = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    at = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(up)]))
    return up[head], at, [np.add.reduceat(x, head) for x in sums]


def path_of(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each gram its eight entries (decision node, then context) and the bit taken at each."""
    step = np.arange(8)
    byte = (key & 255)[:, None]
    return (((1 << step) | (byte >> (8 - step))) << (8 * depth)) | (key >> 8)[:, None], (byte >> (7 - step)) & 1


def fold(key: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The trees over whole groups of grams, deepest contexts first.

    Gives the entries of depth 2 (node, two bytes) with their zeros, ones and summed log
    probability of what lies below, and per gram and node the mix of depths 3 to `depth`.
    """
    path, bit = path_of(key, depth)
    entry, at = np.unique(path.ravel(), return_inverse=True)
    weight = np.repeat(n.astype(np.float64), 8)
    bit = bit.ravel().astype(np.float64)
    zeros, ones = np.bincount(at, weight * (1 - bit), len(entry)), np.bincount(at, weight * bit, len(entry))
    mix, p = _log_kt(zeros, ones), _one(zeros, ones)[at]
    for _ in range(depth - 1, _TOP, -1):
        entry, up, (zeros, ones, below) = _parents(entry, zeros, ones, mix)
        mix, stop = _half_of(_log_kt(zeros, ones), below)
        at = up[at]
        p = stop[at] * _one(zeros, ones)[at] + (1 - stop[at]) * p
    entry, _, sums = _parents(entry, zeros, ones, mix)
    return entry, sums, p.reshape(-1, 8)


class Top:
    """The mix of depths 0 to 2 on top of a deeper probability p: a + b * p for each entry of depth 2."""

    def __init__(self, entry: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.entry = entry
        self.a, self.b = np.zeros(len(entry)), np.ones(len(entry))
        at = np.arange(len(entry))
        for depth in range(_TOP, -1, -1):
            mix, stop = _half_of(_log_kt(zeros, ones), below)
            self.a = stop[at] * _one(zeros, ones)[at] + (1 - stop[at]) * self.a
            self.b = (1 - stop[at]) * self.b
            if depth and len(entry):
                entry, up, (zeros, ones, below) = _parents(entry, zeros, ones, mix)
                at = up[at]

    def log10(self, key: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
        """log10 probability of each gram's byte after its context."""
        path, bit = path_of(key, depth)
        at = np.searchsorted(self.entry, path >> (8 * (depth - _TOP)))
        one = self.a[at] + self.b[at] * p
        return np.log10(np.where(bit, one, 1 - one)).sum(1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def corpus_counts(texts: DataFrame, depth: int) -> DataFrame:
    """Rows (kind, key, n) over (text, learn): words by hash, grams, documents; texts not to learn from add grams with the count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_WORD: [], _BYTES: []}
        docs = 0

        def passed(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = _summed(np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]]))
            held[kind] = []
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[a : a + 100_000])], ["kind", "key", "n"])

        for batch in batches:
            for learn in (True, False):
                for s in slices_of(batch.column(0).filter(pc.equal(batch.column(1), learn)), SLICE):
                    found = [(_BYTES, grams(s, depth))]
                    if learn:
                        docs += s.n
                        found.append((_WORD, words_of(s, lower=True).hash.view(np.int64)))
                    for kind, keys in found:
                        k, n = np.unique(keys, return_counts=True)
                        held[kind].append((k, n * learn))
                        if sum(len(x[0]) for x in held[kind]) > HELD:
                            held[kind] = [_summed(np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]]))]
                            if len(held[kind][0][0]) > HELD // 2:
                                yield from passed(kind)
        for kind in held:
            if held[kind]:
                yield from passed(kind)
        yield pa.RecordBatch.from_arrays([pa.array([_DOCS], pa.int8()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], ["kind", "key", "n"])

    return texts.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_scores(counts: DataFrame, depth: int, parts: int) -> DataFrame:
    """Rows (key, n, value): each gram's count and the log10 probability of its last byte, from rows (key, n)."""
    spark = counts.sparkSession
    shift = 8 * (depth - _TOP)

    def folded(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        entry, (zeros, ones, below), p = fold(key, n, depth)
        m, g = len(entry), len(key)
        none = np.zeros(g)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(m, bool), np.ones(g, bool)]), pa.array(np.r_[entry, key]), pa.array(np.r_[np.zeros(m, np.int64), n]), *(pa.array(np.r_[x, none]) for x in (zeros, ones, below)), pa.array([None] * m + [x.tobytes() for x in p.astype(np.float32)], pa.binary())], ["gram", "key", "n", "zeros", "ones", "below", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, held = [], [], 0
        for batch in batches:  # sorted by key: the open group waits for its end
            keys.append(np.asarray(batch.column(0)))
            ns.append(np.asarray(batch.column(1)))
            held += batch.num_rows
            if held > FOLDED:
                key, n = np.concatenate(keys), np.concatenate(ns)
                ready = int(np.searchsorted(key >> shift, key[-1] >> shift))
                if ready:
                    yield from folded(key[:ready], n[:ready])
                keys, ns, held = [key[ready:]], [n[ready:]], len(key) - ready
        if held:
            yield from folded(np.concatenate(keys), np.concatenate(ns))

    group = F.shiftright("key", shift)
    grouped = counts.select("key", "n").repartition(parts, group).sortWithinPartitions("key")
    both = cut(grouped.mapInArrow(run, "gram boolean, key long, n long, zeros double, ones double, below double, p binary"), "folded")
    top = both.where("not gram").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    columns = [np.asarray(top[c].combine_chunks()) for c in ("key", "zeros", "ones", "below")]
    order = np.argsort(columns[0])
    sent = spark.sparkContext.broadcast(Top(*(c[order] for c in columns)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0))
            p = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent.value.log10(key, p, depth))], ["key", "n", "value"])

    return both.where("gram").select("key", "n", "p").mapInArrow(finish, "key long, n long, value double")


def most_frequent(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with the highest n, at most `limit`; of rows with equal n all or none."""
    by_count = rows.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.col("n").desc()).toArrow()
    reached = np.cumsum(np.asarray(by_count["count"])) <= limit if by_count.num_rows else np.zeros(0, bool)
    floor = int(np.asarray(by_count["n"])[reached].min()) if reached.any() else 1 << 62
    return rows.where(F.col("n") >= floor)


def _grouped(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct keys of each of n documents, and how often each has them, as two list columns."""
    by = np.lexsort((key, doc))
    doc, key = doc[by], key[by]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else doc
    times = np.diff(np.r_[first, len(doc)])
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc[first], minlength=n))].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(key[first])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = DEPTH) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one for each input row.

    held_out: crc32 of the id's text modulo `folds` is 0; those rows are scored and not learned
    from. A null text is empty: one token (the end), score 0.0, bits_per_byte null; elsewhere
    bits_per_byte is the code length of the text by the model. Null ids count as the empty text.
    Without training rows every probability is that of an untrained model. Ids may repeat.
    `depth`, 3 to 6, is the number of bytes of context.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held_out = bucket_crc("doc_id", folds) == 0
    counts = cut(corpus_counts(source.select("text", (~held_out).alias("learn")), depth), "corpus-counts")
    sums = {r["kind"]: (r["n"], r["keys"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).collect()}
    n_docs = sums.get(_DOCS, (0, 0))[0]
    n_words, n_distinct = sums.get(_WORD, (0, 0))
    total, distinct = n_words + n_docs, n_distinct + (n_docs > 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sums.get(_BYTES, (0, 0))[1] // TASK_GRAMS + 1)

    words = counts.where(F.col("kind") == _WORD)
    head = most_frequent(words, HEAD).select("key", "n").toArrow()
    key = np.asarray(head["key"].combine_chunks()).view(np.uint64)
    order = np.argsort(key)
    valued = cut(gram_scores(counts.where(F.col("kind") == _BYTES), depth, parts), "grams")
    often = most_frequent(valued, HEAD_GRAMS).select("key", "value").toArrow()
    gram = mixed(np.asarray(often["key"].combine_chunks()).view(np.uint64))
    by = np.argsort(gram)
    sent = spark.sparkContext.broadcast((key[order], np.asarray(head["n"].combine_chunks())[order], gram[by], np.asarray(often["value"].combine_chunks())[by]))
    unit = float(np.log10(total + 0.1 * (distinct + 1)))
    end = float(np.log10(n_docs + 0.1))

    names = ["row", "doc_id", "n_bytes", "n_tokens", "n_known", "base", "score", "rare", "times", "rare_grams", "gram_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, gram, value = sent.value
        look, log, look_gram = Lookup(keys), np.log10(n + 0.1), Lookup(gram)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for s in slices_of(batch.column(1), SLICE):
                w = words_of(s, lower=True)
                tokens, size = np.diff(w.first), np.diff(s.bounds)
                doc = np.repeat(np.arange(s.n), tokens)
                at = look(w.hash)
                hit = at >= 0
                known = np.bincount(doc[hit], minlength=s.n)
                base = np.bincount(doc[hit], log[at[hit]], minlength=s.n)
                rare, times = _grouped(doc[~hit], w.hash[~hit].view(np.int64), s.n)
                g = grams(s, depth)
                at = look_gram(mixed(g.view(np.uint64)))
                summed = np.zeros(len(g) + 1)
                if len(value):
                    np.cumsum(np.where(at >= 0, value[at], 0.0), out=summed[1:])
                miss = np.flatnonzero(at < 0)
                rare_grams, gram_times = _grouped(np.searchsorted(s.bounds, miss, "right") - 1, g[miss], s.n)
                own = batch.column(0).slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(s.n)), own, pa.array(size), pa.array(tokens + 1), pa.array(known + (n_docs > 0)), pa.array(base + end), pa.array(summed[s.bounds[1:]] - summed[s.bounds[:-1]]), rare, times, rare_grams, gram_times], names)
                row += s.n

    scored = cut(source.mapInArrow(run, "row long, doc_id long, n_bytes long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>, rare_grams array<long>, gram_times array<int>"), "scored")
    sent.unpersist()
    t = F.col("t")

    def tail(keys: str, often: str, table: DataFrame) -> DataFrame:
        rare = scored.where(F.size(keys) > 0).select("row", F.inline(F.arrays_zip(F.col(keys).alias("key"), F.col(often).alias("t"))))
        return rare.join(table, "key", "left")

    c = F.coalesce("n", F.lit(0))
    more_words = tail("rare", "times", words.select("key", "n")).groupBy("row").agg(F.sum(t * F.log10(c + 0.1)).alias("more"), F.sum(F.when(c > 0, t).otherwise(0)).alias("known"))
    more_grams = tail("rare_grams", "gram_times", valued.select("key", "value")).groupBy("row").agg(F.sum(t * F.col("value")).alias("more_score"))
    whole = scored.drop("rare", "times", "rare_grams", "gram_times").join(more_words, "row", "left").join(more_grams, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    bits = F.when(F.col("n_bytes") > 0, -score / F.lit(float(np.log10(2))) / F.col("n_bytes"))
    return whole.select("doc_id", held_out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), bits.alias("bits_per_byte"))
