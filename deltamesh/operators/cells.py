"""Graphs whose edges join the members of common cells: counts row by row, without a table of edges.

Members of a cell are all adjacent to each other, so edges grow with the square of a cell. Here only
the members (node, cell) are gathered: they pass through the driver and are sent to the tasks, which
make the neighbours of a node when they need them. The driver holds the members and arrays as long as
the nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.model import STATUSES, PropertyGraph
from deltamesh.operators.frames import settled

#: Words of 64 neighbours that a task of `Projection.counts` holds of every node, at most.
WORDS = 256
#: Words that are added at once.
STEP = 1 << 14
#: Nodes whose lists are brought in order at once, and nodes on whose words they stay together.
GROUP, TILE = 1024, 2048
#: Neighbours a block of `Projection.blocks` holds, plus those of its last node.
BLOCK = 500_000


@dataclass(frozen=True)
class Cells:
    """Members of each cell in ascending order, one cell after the other, and the cells of each of n nodes.

    place: where a node stands among the members, for each of its cells.
    """

    n: int
    member: np.ndarray
    starts: np.ndarray
    cell: np.ndarray
    first: np.ndarray
    place: np.ndarray

    def neighbours(self) -> Callable[[int], np.ndarray]:
        """A function from a node to its neighbours in ascending order."""
        starts, first, mark = self.starts.tolist(), self.first.tolist(), np.zeros(self.n, bool)
        member = self.member.astype(np.int64)

        def near(u: int) -> np.ndarray:
            own = [member[starts[c] : starts[c + 1]] for c in self.cell[first[u] : first[u + 1]].tolist()]
            if not own:
                return np.zeros(0, np.int64)
            mark[np.concatenate(own)] = True
            mark[u] = False
            out = np.flatnonzero(mark)
            mark[out] = False
            return out

        return near


    def excess(self, after: bool = False) -> Callable[[int], np.ndarray]:
        """A function from a node to the others that it shares more than one cell with, once for each cell beyond the first.

        after: only those of higher numbers.
        """
        last, count = np.zeros(self.n, np.int32), np.arange(len(self.member), dtype=np.int32)
        starts, first = self.starts.tolist(), self.first.tolist()

        def more(u: int) -> np.ndarray:
            at = range(first[u], first[u + 1])
            if not at:
                return np.zeros(0, self.member.dtype)
            low = (self.place[at.start : at.stop] + 1).tolist() if after else [starts[c] for c in self.cell[at.start : at.stop].tolist()]
            x = np.concatenate([self.member[a : starts[c + 1]] for a, c in zip(low, self.cell[at.start : at.stop].tolist(), strict=True)])
            k = count[: len(x)]
            last[x] = k
            x = x[last[x] != k]
            return x if after else x[x != u]

        return more

    def few(self) -> bool:
        """Whether the lists of `excess` are shorter than those of neighbours; a look at some nodes, for the cost only."""
        near, more = self.neighbours(), self.excess()
        some = range(0, self.n, max(1, self.n // 200))
        return sum(len(more(u)) for u in some) < sum(len(near(u)) for u in some)

    def within(self, x: np.ndarray) -> np.ndarray:
        """For each node the sum over its cells of their members' sum, its own share included."""
        out = np.zeros(self.n, x.dtype)
        linked = np.flatnonzero(np.diff(self.first))
        if len(linked):
            out[linked] = np.add.reduceat(np.add.reduceat(x[self.member], self.starts[:-1])[self.cell], self.first[linked])
        return out


class Counters:
    """Totals of bits by their place: words are added, three sums of a weight become one and a carry."""

    def __init__(self, words: int):
        self.words, self.rows = words, max(1, STEP // words)
        self.held: list[list[np.ndarray]] = []

    def add(self, x: np.ndarray) -> None:
        """x: `rows` times `words`; it is changed."""
        for own in self.held:
            if len(own) < 2:
                own.append(x)
                return
            a, b = own
            half = a ^ b
            a &= b
            a |= half & x
            half ^= x
            own[:] = [half]
            x = a
        self.held.append([x])

    def total(self) -> np.ndarray:
        out = np.zeros(64 * self.words, np.int64)
        for weight, own in enumerate(self.held):
            for x in own:
                out += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) << weight
        return out


def column_counts(x: np.ndarray) -> np.ndarray:
    """How many rows have each bit set."""
    out = np.zeros(64 * x.shape[1], np.int64)
    weight = 0
    while len(x):
        up = []
        while len(x) > 2:
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            half = a ^ b
            up.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * k :]])
        for row in x:
            out += np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64) << weight
        x = np.concatenate(up) if up else x[:0]
        weight += 1
    return out


class Projection:
    """A graph given by its cells, with nodes numbered in the order of their labels."""

    def __init__(self, g: PropertyGraph):
        self.spark = g.nodes.sparkSession
        labels = g.nodes.select("label").toArrow()["label"].combine_chunks()
        self.labels = labels.take(pc.sort_indices(labels))
        self.n = len(self.labels)
        ids = self.spark.createDataFrame(pa.table({"label": self.labels, "id": pa.array(np.arange(self.n, dtype=np.int32))}))
        kinds = [c for c in g.cells.columns if c not in ("label", "cell")]
        found = g.cells.join(ids, "label").groupBy("cell", *kinds).agg(F.sort_array(F.collect_set("id")).alias("own")).where(F.size("own") > 1).select("own", *kinds).toArrow()
        self.kinds = {c: found[c].to_pylist() for c in kinds}
        own = found["own"].combine_chunks()
        starts = np.asarray(own.offsets).astype(np.int64)
        member = np.asarray(own.flatten())
        order = np.argsort(member, kind="stable")
        cell = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(starts))[order]
        self.cells = Cells(self.n, member, starts, cell, np.searchsorted(member[order], np.arange(self.n + 1)), order)
        self.sent = self.spark.sparkContext.broadcast(self.cells)
        self.tasks = 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def numbers(self) -> DataFrame:
        return self.frame(id=np.arange(self.n))

    def frame(self, **columns: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"label": self.labels, **{k: pa.array(v) for k, v in columns.items()}}))

    def sums(self, *x: np.ndarray) -> list[np.ndarray]:
        """For each array as long as the nodes, its sum over each node's neighbours."""
        n, cells, given = self.n, self.sent, self.spark.sparkContext.broadcast(x)
        parts = max(1, min(self.tasks, n // 64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = cells.value.neighbours()
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    low, high = n * p // parts, n * (p + 1) // parts
                    out = [np.empty(high - low, v.dtype) for v in given.value]
                    for u in range(low, high):
                        at = near(u)
                        for v, o in zip(given.value, out, strict=True):
                            o[u - low] = v[at].sum()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), *(pa.array(o.view(np.int64) if o.dtype == np.uint64 else o) for o in out)], names)

        names = ["id", *(f"x{i}" for i in range(len(x)))]
        kinds = ["double" if v.dtype == np.float64 else "long" for v in x]
        got = self.spark.range(0, parts, 1, parts).mapInArrow(run, "id long, " + ", ".join(f"x{i} {k}" for i, k in enumerate(kinds))).toArrow()
        given.destroy()
        out = [np.zeros(n, v.dtype) for v in x]
        at = got["id"].to_numpy()
        for i, o in enumerate(out):
            o[at] = got[f"x{i}"].to_numpy().view(o.dtype)
        return out

    def degrees(self) -> np.ndarray:
        return self.sums(np.ones(self.n, np.int64))[0]

    def counts(self, two_hop: bool = True) -> DataFrame:
        """Rows (id, degree, triangles), and two_hop if it is asked for, of every node.

        The number of cells that two nodes share is 1 and their excess if they are adjacent, else 0. So
        the adjacent pairs around a node, twice its triangles, are the sum of the squares of how many
        neighbours it has in each cell, less the pairs of a neighbour with itself and the excess
        of pairs of neighbours; that is counted pair by pair, as there are fewer than edges. Where
        cells overlap so much that there are not, edges are counted instead.

        A task holds, for some of the nodes, which others have them as neighbours, as bits, and takes
        a share of the cells and pairs. What lies within two steps of a node is what the members of
        its cells have as neighbours, so each cell's bits are laid over each other once.
        """
        n, cells, few = self.n, self.sent, self.cells.few()
        blocks = max(1, -(-n // (64 * WORDS)))
        words = max(1, -(-n // (64 * blocks)))
        shares = -(-2 * self.spark.sparkContext.defaultParallelism // blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = cells.value
            near, more = own.neighbours(), own.excess(after=True)
            many = np.diff(own.first)
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    p, share = p // shares, p % shares
                    low, high = min(n, 64 * words * p), min(n, 64 * words * (p + 1))
                    part = lambda size, q=share: (size * q // shares, size * (q + 1) // shares)
                    m = np.zeros((n, words), np.uint64)
                    degree, alone = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
                    for w in range(-(-(high - low) // 64)):
                        bits = np.zeros((64, n), np.uint8)
                        for i, u in enumerate(range(low + 64 * w, min(high, low + 64 * w + 64))):
                            at = near(u)
                            bits[i, at] = 1
                            degree[u - low], alone[u - low] = len(at), many[at].sum()
                        m[:, w] = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)[:, 0]
                    pairs = Counters(words)
                    first, end = part(n)
                    for g in range(first, end, GROUP):
                        lists = [more(u) if few else (x := near(u))[np.searchsorted(x, u) :] for u in range(g, min(end, g + GROUP))]
                        x, y = np.concatenate(lists), np.repeat(np.arange(g, g + len(lists)), [len(a) for a in lists])
                        order = np.argsort((x // TILE).astype(np.uint16), kind="stable")
                        x, y = x[order], y[order]
                        for a in range(0, len(x), pairs.rows):
                            both = np.take(m, x[a : a + pairs.rows], axis=0)
                            both &= np.take(m, y[a : a + pairs.rows], axis=0)
                            if len(both) < pairs.rows:
                                both = np.concatenate([both, np.zeros((pairs.rows - len(both), words), np.uint64)])
                            pairs.add(both)
                    twice = 2 * pairs.total()[: high - low]
                    if few:
                        twice = -twice - (alone if share == 0 else 0)
                        for c in range(*part(len(own.starts) - 1)):
                            twice += column_counts(m[own.member[own.starts[c] : own.starts[c + 1]]])[: high - low] ** 2
                    none = np.zeros(high - low, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(none if share else degree), pa.array(twice), pa.array(none)], names)
                    if two_hop:
                        by_cell = np.zeros((len(own.starts) - 1, words), np.uint64)
                        for c in range(len(by_cell)):
                            by_cell[c] = np.bitwise_or.reduce(m[own.member[own.starts[c] : own.starts[c + 1]]], axis=0)
                        first, end = part(n)
                        within = np.zeros(end - first, np.int64)
                        for u in range(first, end):
                            mine = own.cell[own.first[u] : own.first[u + 1]]
                            if len(mine):
                                within[u - first] = int(np.bitwise_count(np.bitwise_or.reduce(by_cell[mine], axis=0)).sum(dtype=np.int64))
                        none = np.zeros(end - first, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, end)), pa.array(none), pa.array(none), pa.array(within)], names)

        names = ["id", "degree", "twice", "within"]
        got = self.spark.range(0, blocks * shares, 1, blocks * shares).mapInArrow(run, "id long, degree long, twice long, within long")
        total = got.groupBy("id").agg(*(F.sum(c).alias(c) for c in names[1:]))
        # within two steps are the node itself and its neighbours too, if it has any
        far = F.when(F.col("degree") > 0, F.col("within") - F.col("degree") - 1).otherwise(0)
        return total.select("id", "degree", F.expr("twice div 2").alias("triangles"), *([far.cast("long").alias("two_hop")] if two_hop else []))

    def product(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from an array to its sums over each node's neighbours, for many calls.

        Sums over cells are made in the driver. What these count more than once is taken off by the
        tasks, from lists that are kept in the checkpoint folder (the neighbours' lists where those are shorter).
        """
        n, cells, few = self.n, self.sent, self.cells.few()
        parts = max(1, min(self.tasks, n // 64))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = cells.value.excess() if few else cells.value.neighbours()
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    for low in range(n * p // parts, n * (p + 1) // parts, GROUP):
                        lists = [near(u) for u in range(low, min(low + GROUP, n * (p + 1) // parts))]
                        length = np.fromiter(map(len, lists), np.int32, len(lists))
                        yield pa.RecordBatch.from_arrays([pa.array([low]), *(pa.array([x.tobytes()], pa.binary()) for x in (length, np.concatenate(lists).astype(np.int32)))], ["low", "length", "near"])

        packed = settled(self.spark.range(0, parts, 1, parts).mapInArrow(pack, "low long, length binary, near binary"))
        many = np.diff(self.cells.first)

        def times(x: np.ndarray) -> np.ndarray:
            given = self.spark.sparkContext.broadcast(x)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for low, length, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        length = np.frombuffer(length, np.int32)
                        y, some = np.zeros(len(length)), np.flatnonzero(length)
                        if len(some):
                            y[some] = np.add.reduceat(given.value[np.frombuffer(near, np.int32)], np.r_[0, np.cumsum(length)][some])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(y))), pa.array(y)], ["id", "y"])

            got = packed.mapInArrow(run, "id long, y double").toArrow()
            given.destroy()
            out = np.zeros(n)
            out[got["id"].to_numpy()] = got["y"].to_numpy()
            return self.cells.within(x) - many * x - out if few else out

        return times

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges (u, v, 1) in order, in blocks of whole nodes."""
        near, held, nodes, size = self.cells.neighbours(), [], [], 0
        for u in range(self.n):
            at = near(u)
            held.append(at)
            nodes.append(u)
            size += len(at)
            if size >= BLOCK or (u == self.n - 1 and size):
                yield np.repeat(np.array(nodes), [len(x) for x in held]), np.concatenate(held), np.ones(size)
                held, nodes, size = [], [], 0

    def merged(self, own: np.ndarray) -> DataFrame:
        """Edges (u, v, w) between the groups of their ends, w their number."""
        n, cells = self.n, self.sent
        given = self.spark.sparkContext.broadcast((own, np.argsort(own, kind="stable")))
        k, parts = int(own.max()) + 1, max(1, min(self.tasks, n // 64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, (group, order) = cells.value.neighbours(), given.value
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    nodes = order[n * p // parts : n * (p + 1) // parts]
                    for some in np.split(nodes, np.flatnonzero(np.diff(group[nodes])) + 1):
                        total = np.zeros(k)
                        for u in some.tolist():
                            total += np.bincount(group[near(u)], minlength=k)
                        v = np.flatnonzero(total)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), group[some[0]])), pa.array(v), pa.array(total[v])], ["u", "v", "w"])

        return settled(self.spark.range(0, parts, 1, parts).mapInArrow(run, "u long, v long, w double").groupBy("u", "v").agg(F.sum("w").alias("w")))

    def changes(self, group: np.ndarray) -> dict[str, np.ndarray]:
        """For cells of a kind `type` on the sides a and b: each node's union edges, and those to its own group by status.

        An edge of a type has the number of common cells of this type as its weight on a side.
        """
        n, cells = self.n, self.sent
        types = {t: i for i, t in enumerate(sorted(set(self.kinds["type"])))}
        kinds = np.array([types[t] for t in self.kinds["type"]], np.int64), np.array([x == "b" for x in self.kinds["side"]], bool)
        given = self.spark.sparkContext.broadcast((group, *kinds))
        parts = max(1, min(self.tasks, n // 64))
        names = ["id", "degree", *STATUSES]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, (group, kind, in_b) = cells.value, given.value
            starts = own.starts.tolist()

            def edges(u: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if not len(mine):
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
                lists = [own.member[starts[c] : starts[c + 1]] for c in mine.tolist()]
                key, weight = np.unique(np.repeat(kind[mine] * n, [len(x) for x in lists]) + np.concatenate(lists), return_counts=True)
                other = key % n != u
                return key[other], weight[other]

            for batch in batches:
                for p in batch.column(0).to_pylist():
                    low, high = n * p // parts, n * (p + 1) // parts
                    out = np.zeros((5, high - low), np.int64)
                    for u in range(low, high):
                        mine = own.cell[own.first[u] : own.first[u + 1]]
                        (a, x), (b, y) = (edges(u, mine[in_b[mine] == side]) for side in (False, True))
                        _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                        inner_a, inner_b = (group[k % n] == group[u] for k in (a, b))
                        same, both = x[at] == y[to], inner_a[at]
                        shared, changed = np.count_nonzero(both & same), np.count_nonzero(both & ~same)
                        out[:, u - low] = len(a) + len(b) - len(at), shared, changed, inner_a.sum() - both.sum(), inner_b.sum() - both.sum()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), *(pa.array(x) for x in out)], names)

        got = self.spark.range(0, parts, 1, parts).mapInArrow(run, ", ".join(f"{c} long" for c in names)).toArrow().sort_by("id")
        given.destroy()
        return {c: got[c].to_numpy() for c in names[1:]}

    def components(self, group: np.ndarray | None = None) -> np.ndarray:
        """For each node the smallest number that it is connected with, by way of its own group if groups are given."""
        own, label = self.cells, np.arange(self.n)
        if len(own.member) == 0:
            return label
        key = np.repeat(np.arange(len(own.starts) - 1), np.diff(own.starts))
        if group is not None:
            key = key * (int(group.max()) + 1) + group[own.member]
        order = np.argsort(key, kind="stable")
        member, key = own.member[order], key[order]
        starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        back = np.argsort(member, kind="stable")
        cell = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(member)]))[back]
        first = np.searchsorted(member[back], np.arange(self.n + 1))
        linked = np.flatnonzero(np.diff(first))
        while True:
            new = label.copy()
            new[linked] = np.minimum.reduceat(np.minimum.reduceat(label[member], starts)[cell], first[linked])
            new = new[new]
            if (new == label).all():
                return label
            label = new
