"""Packing documents into sequences: best fit, then a swap-based local search until bins empty.

Bins are never handled one by one. Lengths are whole numbers up to the capacity, so a packing is a
set of patterns (how many pieces of which lengths share a bin) with multiplicities, and the number
of patterns depends on the capacity, not on the corpus. Best fit and the local search work on
patterns in the driver; a move between two patterns is made for as many pairs of bins as there are.

Executors then deal real pieces to the patterns' places: a piece's rank among those of its length
is its rank in its own task plus the count of earlier tasks, and a sorted table of pattern places
turns the rank into bin and offset. Only piece rows of a few numbers are shuffled, never tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.llm.common import cut
from deltamesh.llm.textarrays import slices_of
from deltamesh.llm.tokens import default_path, merger

CAPACITY = 2048
#: Changes that the local search makes at most.
CHANGES = 4000
Pattern = tuple[int, ...]


def best_fit(lengths: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit over decreasing lengths, for all pieces of a length at once.

    A piece goes to the bin with the least room that holds it. For n pieces of one length that
    means: the patterns by room, each bin taking one piece and then standing under its new room.
    """
    by_room: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            room = min((r for r in by_room if r >= length and by_room[r]), default=None)
            if room is None:
                per = capacity // length
                if left >= per:
                    by_room[capacity - per * length][(length,) * per] += left // per
                    left %= per
                else:
                    by_room[capacity - left * length][(length,) * left] += 1
                    left = 0
                continue
            pattern, bins = next(iter(by_room[room].items()))
            fit = min(room // length, left)
            whole = min(bins, left // fit)
            by_room[room][pattern] -= whole
            if not by_room[room][pattern]:
                del by_room[room][pattern]
            by_room[room - fit * length][(*pattern, *(length,) * fit)] += whole
            left -= whole * fit
    out: Counter[Pattern] = Counter()
    for group in by_room.values():
        for pattern, bins in group.items():
            out[tuple(sorted(pattern, reverse=True))] += bins
    return out


class Takers:
    """The underfull patterns as flat arrays: one entry for each length a pattern could give back, and one for none."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.fill, self.out, self.owner = np.zeros((3, 1024), np.int64)
        self.used, self.at, self.patterns = 0, {}, []

    def add(self, pattern: Pattern) -> None:
        if pattern in self.at or sum(pattern) >= self.capacity:
            return
        outs = [0, *sorted(set(pattern))]
        end = self.used + len(outs)
        if end > len(self.fill):
            self.fill, self.out, self.owner = (np.concatenate([x, np.zeros(max(len(x), len(outs)), np.int64)]) for x in (self.fill, self.out, self.owner))
        self.fill[self.used : end], self.out[self.used : end], self.owner[self.used : end] = sum(pattern), outs, len(self.patterns)
        self.at[pattern] = (self.used, end)
        self.patterns.append(pattern)
        self.used = end

    def drop(self, pattern: Pattern) -> None:
        a, b = self.at.pop(pattern, (0, 0))
        self.fill[a:b], self.out[a:b] = self.capacity, 0  # full: nothing can be offered to it
        if self.used > 4 * sum(y - x for x, y in self.at.values()) + 4096:
            kept = list(self.at)
            self.used, self.at, self.patterns = 0, {}, []
            for p in kept:
                self.add(p)

    def best(self, donor: Pattern, alone: bool) -> tuple[Pattern, Pattern, Pattern] | None:
        """The change from this donor with the largest rise of squared fill: taker, lengths given, lengths given back."""
        fill, out = self.fill[: self.used], self.out[: self.used]
        own = Counter(donor)
        ones = sorted(own)
        twos = {x + y: (x, y) for x in ones for y in ones if y < x or (y == x and own[x] > 1)}
        offers = [(np.array([0, *ones]), np.ones(len(fill), bool))]
        if twos:
            offers.append((np.array([0, *sorted(twos)]), out > 0))
        room = self.capacity - fill + out
        given = np.max([np.where(on, sizes[np.searchsorted(sizes, room, "right") - 1], 0) for sizes, on in offers], axis=0)
        gain = given - out
        # (base + g)^2 + (fill - g)^2 - base^2 - fill^2
        rise = np.where(gain > 0, 2 * gain * (fill - sum(donor) + gain), 0)
        if alone:
            rise[slice(*self.at.get(donor, (0, 0)))] = 0
        k = int(rise.argmax()) if len(rise) else 0
        if not len(rise) or rise[k] <= 0:
            return None
        g, back = int(given[k]), int(out[k])
        return self.patterns[self.owner[k]], ((g,) if g in own else twos[g]), ((back,) if back else ())


def improve(bins: Counter[Pattern], capacity: int, changes: int = CHANGES) -> Counter[Pattern]:
    """Local search: moves and one-for-one or two-for-one swaps between underfull bins.

    The emptiest pattern from which a change gains makes the change with the largest rise in
    squared fill over all other underfull patterns, for as many pairs of bins as there are. A donor
    that runs empty is a bin saved. Donors that can't gain wait until all others are done and are
    tried again. It stops when no donor's change gains, when the bins are as few as the total asks,
    or after `changes` changes, which bounds the driver's time on lengths whose lower bound no
    packing reaches; pieces stay whole either way.
    """
    total = sum(sum(p) * n for p, n in bins.items())
    least, held, made = -(-total // capacity), sum(bins.values()), 0
    bins = Counter(bins)
    takers = Takers(capacity)
    for p in bins:
        takers.add(p)
    waiting = [(sum(p), p) for p in takers.at]
    heapify(waiting)
    stuck: list[tuple[int, Pattern]] = []
    moved = False
    while held > least and made < changes:
        if not waiting:
            if not moved:
                break
            waiting, stuck, moved = stuck, [], False
            heapify(waiting)
            continue
        fill, donor = heappop(waiting)
        if not bins[donor]:
            continue
        change = takers.best(donor, bins[donor] < 2)
        if change is None:
            stuck.append((fill, donor))
            continue
        made, moved = made + 1, True
        taker, given, back = change
        n = bins[donor] // 2 if donor == taker else min(bins[donor], bins[taker])
        after_donor, after_taker = list(donor), list(taker)
        for x in given:
            after_donor.remove(x)
            after_taker.append(x)
        for x in back:
            after_taker.remove(x)
            after_donor.append(x)
        for p in (donor, taker):
            bins[p] -= n
        held -= 0 if after_donor else n
        for after in (after_donor, after_taker):
            if after:
                p = tuple(sorted(after, reverse=True))
                if not bins[p] and sum(p) < capacity:
                    heappush(waiting, (sum(p), p))
                bins[p] += n
                takers.add(p)
        for p in {donor, taker}:
            if not bins[p]:
                takers.drop(p)
                del bins[p]
            elif p == donor:
                heappush(waiting, (fill, donor))
    return +bins


def places(bins: Counter[Pattern]) -> dict[int, np.ndarray]:
    """Per length, rows (ranks before, pieces a bin, first bin, offset in the bin), ascending."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    first = 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            out[length].append((used[length], per, first, offset))
            used[length] += per * n
            offset += per * length
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces_of(docs: DataFrame, capacity: int, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: its document, number, start, length, crc32 of its ids, and its rank among its length in its task."""
    vocabulary = path or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task = merger(vocabulary), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for s in slices_of(batch.column(1)):
                r = m.tokens(s, ids=True)
                size = np.diff(r.first) + 1
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(s.n), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                whole = np.zeros(int(size.sum()), "<u4")
                head = r.first[:-1] + np.arange(s.n)
                keep = np.ones(len(whole), bool)
                keep[head + size - 1] = False
                whole[keep] = r.ids
                begin = (head[doc] + start).tolist()
                crc = [zlib.crc32(whole[a : a + n]) for a, n in zip(begin, length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                fresh = np.flatnonzero(np.r_[True, np.diff(sorted_length) != 0]) if len(order) else order
                run_start = np.repeat(fresh, np.diff(np.r_[fresh, len(order)]))
                nth = np.empty(len(order), np.int64)
                nth[order] = met[sorted_length] + np.arange(len(order)) - run_start
                met += np.bincount(length, minlength=capacity + 1)
                ids = batch.column(0).slice(s.first, s.n).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)], names)

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    Each input row is a document: its ids, then id 0. A null or empty text is the one id 0. Ids
    may be null or repeat. An empty table packs into no sequence. The driver gets one count per
    length, at most `capacity` of them.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, capacity, path, id_col, text_col), "pieces")
    counts = cut(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(improve(best_fit(lengths, capacity), capacity)))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                size = int(length[own[0]])
                t = table.value[size]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                q = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + q // row[:, 1]
                offset[own] = row[:, 3] + q % row[:, 1] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(ahead, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ahead")).alias("rank"))
    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
