"""Near-duplicate documents: an exact join on the Jaccard similarity of word shingles.

Which pairs are looked at
    Documents with equal shingle sets form one class and go on as one. Two sets of similarity t or
    more share an element among the first n - ceil(t n) + 1 of each, in any order common to all.
    The order used puts elements that are frequent in a sample of the documents last, the most
    frequent at the end, and goes by hash otherwise; the sample only shapes the order, so it can't
    lose a pair. Documents that share such an element form a tile.

    An element at place p (from 0) of a set of n can be the first one shared only with sets of at
    most 7 (n - p) / 3 - n elements: beyond that too few are left for the overlap 3 (n + m) / 7.
    That size is the element's reach. A pair is looked for in the tile of its first shared element,
    where both sizes lie within the other's reach, so rows without such a partner leave their tile.

How a tile is searched
    First each tile ties its documents, per band of sizes, to the one with the most frequent
    elements (a group of edited copies has its original there). Those pairs are verified and
    joined to components. Rows stay in a tile only if it holds a possible partner of another
    component; of tiles that are left with the same rows one is searched. There, bit counts of
    hashed bitmap signatures bound each overlap from above, and only rows that have a possible
    partner by them bring their sets. The sets meet in the tile's own task, which intersects them
    exactly and passes on the links that join two components, fewer than it has rows: no list of
    pairs is ever written. Within a component nothing more is to be found, so no link between
    components is lost.

    Time in a tile grows with the square of its rows of other components, as every such pair has
    to be looked at; large tiles are dealt to many tasks in cells of at most BLOCK by BLOCK rows.

Verification is the intersection of sorted arrays of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deltamesh.llm.common import cut, dropped, release
from deltamesh.llm.components import connected
from deltamesh.llm.textarrays import Lookup, Slice, mixed, slices_of, windows, words_of

WIDTH = 5
#: Similarity as a fraction, so that the test is in whole numbers.
NUM, DEN = 3, 4
#: One document in so many is read to find frequent elements; met so often there, one goes last.
SAMPLE, OFTEN, MOST_FREQUENT = 8, 3, 400_000
#: A tile expected to hold more rows is tied in parts; rows and shingles on one side of a cell of a tile's search.
PART_ROWS, BLOCK, BLOCK_SHINGLES = 512, 1024, 1 << 20
#: Tiles of up to so many rows are tested pair by pair for partners of a possible size.
SMALL_TILE = 64
KEY_BITS = 48
#: Bits of the array that marks wanted documents: 16 for each up to the larger number (16 MB).
SLOTS, MOST_SLOTS = 1 << 23, 1 << 27
#: Bytes of documents, and postings, that one task gathers.
TASK_BYTES, TASK_POSTINGS = 32 << 20, 1_500_000
#: Postings that a task sorts by their partition at once: few at once would make many short rows.
DEALT_POSTINGS = 300_000
#: Rows that Spark hands over at once: sets and signatures are wide, and both sides hold a whole batch beside the heap.
BATCH_ROWS = 500
_BANDS = 2.41  # bands per factor e: sizes within the similarity lie in the same or neighbouring bands


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUM * n + DEN - 1) // DEN + 1


def reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest set with which the element at this place can be the first one shared."""
    return (NUM + DEN) * (n - place) // NUM - n


def shingle_sets(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a slice's documents, and where each document's begin."""
    w = words_of(s, lower=True)
    count = np.diff(w.first)
    h, begin = windows(w.hash, w.first, WIDTH)
    doc = np.repeat(np.arange(s.n), np.diff(begin))
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if short.size:
        extra = count[short].astype(np.uint64)
        for k in range(WIDTH - 1):
            has = count[short] > k
            step = w.hash[np.minimum(w.first[short] + k, len(w.hash) - 1)]
            extra = np.where(has, mixed((extra ^ step) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), extra)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(s.n + 1))


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set: sums of two functions of its elements."""
    a = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    b = (h ^ (h >> np.uint64(27))) * np.uint64(0xA0761D6478BD642F)
    return _sum(a ^ (a >> np.uint64(32)), first).view(np.int64), _sum(b ^ (b >> np.uint64(29)), first).view(np.int64)


def bitmap_width(n: int) -> int:
    """Bits of a signature: the power of two from four times the set's size on, 64 to 65536."""
    return min(65536, max(64, 1 << (4 * int(n) - 1).bit_length()))


def bitmap(h: np.ndarray) -> bytes:
    width = bitmap_width(len(h))
    bits = np.zeros(width, np.uint8)
    bits[((h >> np.uint64(40)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(raw: bytes, width: int) -> np.ndarray:
    """A signature at a smaller width: its halves laid over each other."""
    x = np.frombuffer(raw, "<u8")
    while len(x) * 64 > width:
        half = len(x) // 2
        x = x[:half] | x[half:]
    return x


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most BATCH_ROWS rows for the jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    most = int(before)
    spark.conf.set(key, str(min(most, BATCH_ROWS) if most > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def size_of(df: DataFrame) -> int:
    """Bytes of input as Spark's planner knows them; 0 where it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def frequent(source: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the elements to put last and their counts in the sample; at most MOST_FREQUENT, the most frequent ones."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices_of(batch.column(0)):
                h, n = np.unique(shingle_sets(s)[0], return_counts=True)
                part = (mixed(h) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(h) else np.zeros(1, np.int64)
                own = [order[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[o[0]]) for o in own], pa.int32()), pa.array([h[o].tobytes() for o in own], pa.binary()), pa.array([n[o].astype("<u4").tobytes() for o in own], pa.binary())], ["part", "keys", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            keys.append(np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<u8"))
            counts.append(np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4"))
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(key)
        key, n = key[order], n[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(n, head) if len(head) else n
        often = sums >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(key[head][often].view(np.int64)), pa.array(sums[often])], ["h", "n"])

    sample = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    packed = sample.mapInArrow(gather, "part int, keys binary, counts binary").repartition(parts, "part")
    rows = packed.mapInArrow(total, "h long, n long").orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT).toArrow()
    h, n = np.asarray(rows.column("h").combine_chunks()).view(np.uint64), np.asarray(rows.column("n").combine_chunks())
    order = np.argsort(h)
    return h[order], n[order]


def profiles(source: DataFrame, hot) -> DataFrame:
    """Per row: its number, set size, set key, share of frequent elements, signature, and prefix keys (six bytes each)."""
    names = ["row", "doc_id", "n", "s1", "s2", "central", "bits", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = hot.value
        look = Lookup(hashes)
        level = np.r_[np.int64(1) + np.log2(np.maximum(often, 1)).astype(np.int64), 0]  # the last stands for absent ones
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for s in slices_of(batch.column(1)):
                h, first = shingle_sets(s)
                n = np.diff(first)
                s1, s2 = set_keys(h, first)
                how_hot = level[look(h)]
                n_hot = _sum((how_hot > 0).astype(np.int64), first)
                # rare before frequent, by hash within a level: a stable order on (document, level)
                doc = np.repeat(np.arange(s.n), n)
                order = np.argsort(doc * 64 + how_hot, kind="stable")
                rank = np.arange(len(h)) - np.repeat(first[:-1], n)
                chosen = h[order][rank < np.repeat(prefix_length(n), n)] >> np.uint64(64 - KEY_BITS)
                packed = np.ascontiguousarray(chosen.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()
                ends = np.cumsum(np.where(n > 0, prefix_length(n), 0)) * (KEY_BITS // 8)
                begins = np.r_[0, ends[:-1]]
                prefixes = [packed[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                bits = [bitmap(h[a:b]) if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                central = n_hot * 1000 // np.maximum(n, 1)
                columns = [pa.array(row + np.arange(s.n)), batch.column(0).slice(s.first, s.n), pa.array(n), pa.array(s1), pa.array(s2), pa.array(central), pa.array(bits, pa.binary()), pa.array(prefixes, pa.binary())]
                row += s.n
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, "row long, doc_id long, n long, s1 long, s2 long, central long, bits binary, prefix binary")


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of whole numbers, byte by byte: those that hardly change lie together and compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def packed_postings(key: np.ndarray, salt: np.ndarray, cid: np.ndarray, n: np.ndarray, place: np.ndarray, central: np.ndarray) -> bytes:
    return b"".join([planes(key, KEY_BITS // 8), planes(salt, 2), planes(np.diff(cid, prepend=0), 8), planes(n, 4), planes(place, 4), planes(central, 2)])


def unpacked_postings(raw: bytes) -> list[np.ndarray]:
    """The columns of packed_postings, with key and salt as one number: key, cid, n, place, central."""
    sizes = (KEY_BITS // 8, 2, 8, 4, 4, 2)
    rows = np.frombuffer(raw, np.uint8).reshape(sum(sizes), -1)
    out, at = [], 0
    for size in sizes:
        whole = np.zeros((rows.shape[1], 8), np.uint8)
        whole[:, :size] = rows[at : at + size].T
        out.append(whole.view("<u8").ravel())
        at += size
    key, salt, cid, n, place, central = out
    return [key | (salt << np.uint64(KEY_BITS)), np.cumsum(cid.view(np.int64)), n.astype(np.int32), place.astype(np.int32), central.astype(np.int16)]


def deal(classes: DataFrame, hot, parts: int) -> DataFrame:
    """Postings of the classes, packed by the partition that gets a key; tiles expected to be large are split by salts."""
    in_part = PART_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = hot.value
        many = often * SAMPLE > in_part
        large, at = np.unique(hashes[many] >> np.uint64(64 - KEY_BITS), return_index=True)
        splits = np.r_[-(-often[many][at] * SAMPLE // in_part), 0]  # the last stands for absent ones
        look = Lookup(large << np.uint64(64 - KEY_BITS))

        def spread(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            raw = t["prefix"].to_pylist()
            key = _unpacked(b"".join(raw))
            count = np.array([len(x) // 6 for x in raw])
            cid, n, central = (np.repeat(t[c].to_numpy(), count) for c in ("cid", "n", "central"))
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            split = splits[look(key << np.uint64(64 - KEY_BITS))]
            salt = np.where(split > 0, (mixed(cid.astype(np.uint64)) % np.maximum(split, 1).astype(np.uint64)).astype(np.int64) % ((1 << 16) - 1) + 1, 0).astype(np.uint64)
            part = ((key * np.uint64(0x9E3779B97F4A7C15) + salt * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
            for x in range(0, len(edges) - 1, 100):
                own = [order[i:j] for i, j in zip(edges[x : x + 100].tolist(), edges[x + 1 : x + 101].tolist(), strict=False)]
                data = [packed_postings(*(c[o] for c in (key, salt, cid, n, place, central))) for o in own]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[o[0]]) for o in own], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("prefix").nbytes // 6
            if size >= DEALT_POSTINGS:
                yield from spread(held)
                held, size = [], 0
        if held:
            yield from spread(held)

    return classes.select("cid", "n", "central", "prefix").mapInArrow(run, "part int, data binary").repartition(parts, "part")


def partnered(tile: np.ndarray, n: np.ndarray, far: np.ndarray, comp: np.ndarray | None = None) -> np.ndarray:
    """Which rows have, in their tile, another row (of another component) such that each one's size is within the other's reach.

    `tile` is sorted. In tiles of more than SMALL_TILE rows only the row's own reach is tested.
    """
    edges = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else np.zeros(1, np.int64)
    length = np.repeat(np.diff(edges), np.diff(edges))
    after = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(tile)) - 1
    keep = np.zeros(len(tile), bool)
    at = np.flatnonzero((length <= SMALL_TILE) & (after > 0))
    step = 1
    while len(at):
        to = at + step
        hit = (n[to] <= far[at]) & (n[at] <= far[to])
        if comp is not None:
            hit &= comp[to] != comp[at]
        keep[at[hit]] = True
        keep[to[hit]] = True
        step += 1
        at = at[after[at] >= step]
    big = np.flatnonzero(length > SMALL_TILE)
    if len(big):
        size, most = n[big].astype(np.int64), far[big].astype(np.int64)
        least = -(-NUM * size // DEN)

        def within(group: np.ndarray) -> np.ndarray:
            """For each row, how many rows of its group have a size it can be paired with."""
            code = np.sort(group * (1 << 32) + size)
            return np.maximum(np.searchsorted(code, group * (1 << 32) + most, "right") - np.searchsorted(code, group * (1 << 32) + least, "left"), 0)

        _, own = np.unique(tile[big], return_inverse=True)
        own = own.ravel().astype(np.int64)
        if comp is None:
            itself = (size <= most).astype(np.int64)
            keep[big] = within(own) > itself
        else:
            _, part = np.unique(np.stack([own, comp[big]]), axis=1, return_inverse=True)
            keep[big] = within(own) > within(part.ravel().astype(np.int64))
    return keep


def tie(dealt: DataFrame) -> DataFrame:
    """Rows of tiles (key, salted, id, n, far, central): members that may have a partner, each with its tile's centre in two systems of bands."""
    names = ["key", "salted", "id", "n", "far", "central", "centre1", "centre2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            for raw in batch.column("data"):
                for h, x in zip(held, unpacked_postings(raw.as_py()), strict=True):
                    h.append(x)
        if not held[0]:
            return
        key = np.concatenate(held[0])
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.r_[False, key[1:] == key[:-1], False]
        few = same[1:] | same[:-1] | (key >> np.uint64(KEY_BITS) > 0)
        key, order = key[few], order[few]
        cid, n, place, central = (np.concatenate(x)[order] for x in held[1:])
        far = reach(n, place)
        keep = partnered(key, n, far) | (key >> np.uint64(KEY_BITS) > 0)
        key, cid, n, far, central = (x[keep] for x in (key, cid, n, far, central))
        if not len(key):
            return
        centres = []
        for shift in (0.0, 0.5):
            band = np.floor(np.log(n) * _BANDS + shift).astype(np.int64)
            by = np.lexsort((cid, -central.astype(np.int64), band, key))
            head = np.r_[True, (key[by][1:] != key[by][:-1]) | (band[by][1:] != band[by][:-1])]
            length = np.diff(np.r_[np.flatnonzero(head), len(key)])
            own, of_centre = by, np.repeat(by[head], length)
            centre = np.empty(len(key), np.int64)
            near = (n[own] <= far[of_centre]) & (n[of_centre] <= far[own])
            centre[own] = cid[np.where(near, of_centre, own)]  # one out of reach stands alone
            centres.append(centre)
        salted = (key >> np.uint64(KEY_BITS)) > 0
        plain = (key & np.uint64((1 << KEY_BITS) - 1)).view(np.int64)
        for a in range(0, len(key), 50_000):
            cols = [plain, salted, cid, n, far, central, *centres]
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in cols], names)

    return dealt.mapInArrow(run, "key long, salted boolean, id long, n int, far int, central short, centre1 long, centre2 long")


def marked(ids: DataFrame) -> dict[int, bytes]:
    """Bits of the row numbers in the one column of ids, by runs of 32768 rows."""
    row = ids.columns[0]
    # Spark's bitmaps: value 1 is the first bit of bucket 1
    bits = ids.groupBy(F.expr(f"bitmap_bucket_number({row} + 1) - 1").alias("run")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({row} + 1))").alias("bits"))
    return {r["run"]: bytes(r["bits"]) for r in bits.collect()}


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose number, their first column, is among the ids: the others never leave their task."""
    runs = rows.sparkSession.sparkContext.broadcast(marked(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = runs.value
        for batch in batches:
            own = np.asarray(batch.column(0))
            keep = np.zeros(len(own), bool)
            for r in np.unique(own >> 15).tolist():
                if r in bits:
                    at = np.flatnonzero(own >> 15 == r)
                    place = own[at] & 32767
                    keep[at] = (np.frombuffer(bits[r], np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def needed_slots(ids: DataFrame) -> tuple[int, np.ndarray]:
    """The number of bits, and a bit array over hashes of the ids: 16 bits an id, one megabyte at least and 16 at most."""
    count = ids.count()
    bits = min(MOST_SLOTS, max(SLOTS, 1 << (16 * count).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    out = np.zeros(bits // 32768 + 2, dtype="V4096")
    for r in rows:
        out[r["bucket"]] = bytes(r["bits"])
    return bits, out.view(np.uint8)


def sets_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (cid, hashes) of the wanted classes (cid, doc_id, s1, s2): their documents are found by a bit array and shingled again."""
    spark = source.sparkSession
    n_slots, bits = needed_slots(wanted)
    slots = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = slots.value
        for batch in batches:
            # Spark's bitmaps: positive values fill buckets of 32768 from 1 on, zero stands alone in bucket 0
            slot = np.asarray(batch.column(0))
            bucket, bit = np.where(slot == 0, 0, 1 + (slot - 1) // 32768), np.where(slot == 0, 0, (slot - 1) % 32768)
            hit = (bits[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            own = batch.column(1).filter(pa.array(hit > 0))
            for s in slices_of(own):
                h, first = shingle_sets(s)
                s1, s2 = set_keys(h, first)
                raw = h.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(sets, pa.binary())], ["s1", "s2", "hashes"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(n_slots))
    found = source.select(slot.alias("slot"), "text").mapInArrow(run, "s1 long, s2 long, hashes binary")
    return found.join(wanted.select("cid", "s1", "s2"), ["s1", "s2"]).groupBy("s1", "s2", "cid").agg(F.any_value("hashes").alias("hashes")).select("cid", "hashes")


def verified(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold: first by bit counts, then exactly."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(k)) for k in ("na", "nb"))
            keep = DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)
            left, right = batch.column("xa").to_pylist(), batch.column("xb").to_pylist()
            for i in np.flatnonzero(keep).tolist():
                width = 8 * min(len(left[i]), len(right[i]))
                keep[i] = _possible(folded(left[i], width), na[i], folded(right[i], width)[None], nb[i : i + 1])[0]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    signed = classes.select("cid", "n", "bits")
    left = only(signed, pairs.select("a")).toDF("a", "na", "xa")
    right = only(signed, pairs.select("b")).toDF("b", "nb", "xb")
    hopeful = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, "a long, b long"), "hopeful")
    ids = hopeful.select(F.col("a").alias("cid")).unionByName(hopeful.select(F.col("b").alias("cid"))).distinct()
    wanted = cut(classes.join(ids, "cid").select("cid", "doc_id", "s1", "s2"), "wanted")
    sets = cut(sets_of(source, wanted), "sets")
    dropped(wanted)
    with_a = hopeful.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("xa")), "a")
    with_both = with_a.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("xb")), "b").select("a", "b", "xa", "xb")
    links = cut(with_both.mapInArrow(exact, "a long, b long"), "links")
    dropped(hopeful)
    dropped(sets)
    release(source.sparkSession)
    return links


def _possible(x: np.ndarray, n: int, ys: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Whether signatures leave room for the similarity: an element in one bitmap only is in one set only."""
    only_x = np.bitwise_count(x & ~ys).sum(1, dtype=np.int64)
    only_y = np.bitwise_count(ys & ~x).sum(1, dtype=np.int64)
    overlap = np.minimum(n - only_x, ns - only_y)
    return DEN * overlap >= NUM * (n + ns - overlap)


def unsettled_rows(label: DataFrame, parts: int) -> DataFrame:
    """Rows (key, id, comp, n) that have, in their tile, a partner of another component within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        order = np.argsort(t["key"].to_numpy(), kind="stable")
        key, comp, n, far = (t[c].to_numpy()[order] for c in ("key", "comp", "n", "far"))
        chosen = np.sort(order[partnered(key, n, far, comp)])
        for batch in t.take(pa.array(chosen)).to_batches(max_chunksize=50_000):
            yield batch

    plain = label.where("not salted").repartition(parts, "key").mapInArrow(run, label.schema)
    # tiles in parts may be of any size: their rows are held against a summary of the tile by bands of sizes
    large = label.where("salted")
    band = F.floor(F.log(F.col("n")) * 32).alias("band")
    bands = large.groupBy("key", band).agg(F.min("n").alias("least"), F.max("far").alias("most"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    summary = bands.groupBy("key").agg(F.collect_list(F.struct("least", "most", "one", "other")).alias("bands"))
    other = F.exists("bands", lambda z: (z["least"] <= F.col("far")) & (F.col("n") <= z["most"]) & ((z["one"] != F.col("comp")) | (z["other"] != F.col("comp"))))
    kept = large.join(summary, "key").where(other)
    columns = ["key", "id", "comp", "n"]
    return plain.select(*columns).unionByName(kept.select(*columns))


def in_cells(rows: DataFrame) -> DataFrame:
    """The rows (key, id, comp, n, members, shingles, major, ..) of tiles, dealt to cells (block) with a role.

    Role 1 is to look for partners, 2 to be found, 3 both. A small tile is one cell that holds each
    row once; of larger ones every block of seekers meets every block of rows. Rows of the tile's
    largest component don't seek.
    """
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("long")
    cells = F.sequence(F.lit(0), blocks - 1)

    def place(block: Column, role: int) -> Column:
        return F.struct(block.cast("long").alias("block"), F.lit(role).alias("role"))

    seek, sought = F.transform(cells, lambda c: place(own * 1_000_000 + c, 1)), F.transform(cells, lambda c: place(c * 1_000_000 + own, 2))
    one = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.when(F.col("major"), 2).otherwise(3).alias("role")))
    places = F.when(blocks <= 1, one).when(F.col("major"), sought).otherwise(F.concat(seek, sought))
    return rows.withColumn("p", F.explode(places)).select("key", "p.block", "id", "comp", "n", F.col("p.role").alias("role"))


def by_cell(rows: DataFrame, payload: str, parts: int, search, schema: str) -> DataFrame:
    """Cells (key, block) whole to one task each, one after the other: `search(table)` gives a record batch or none."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        key, block = t["key"].to_numpy(), t["block"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(block) != 0), True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found = search(t.slice(a, b - a))
            if found is not None and found.num_rows:
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:  # sorted by cell: keep the open cell, search what is complete
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                if held:
                    last = (held[-1].column("key")[-1].as_py(), held[-1].column("block")[-1].as_py())
                    new = np.flatnonzero((np.asarray(batch.column("key")) != last[0]) | (np.asarray(batch.column("block")) != last[1]))
                    if len(new):
                        held.append(batch.slice(0, int(new[0])))
                        yield from flush(held)
                        held, batch = [], batch.slice(int(new[0]))
                held.append(batch)
        if held:
            yield from flush(held)

    dealt = rows.select("key", "block", "id", "comp", "n", "role", payload).repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, schema)


def suspects(cell: pa.Table) -> pa.RecordBatch | None:
    """The rows of a cell that have, by their signatures, a possible partner of another component."""
    comp, n, role = (cell[c].to_numpy() for c in ("comp", "n", "role"))
    n = n.astype(np.int64)
    bits = cell["bits"].to_pylist()
    width = np.array([8 * len(x) for x in bits])
    flagged = np.zeros(len(n), bool)
    for w in np.unique(width[(role & 1) > 0]).tolist():
        for v in (w // 2, w, 2 * w):
            xs, ys = np.flatnonzero((role & 1 > 0) & (width == w)), np.flatnonzero((role & 2 > 0) & (width == v))
            if not len(xs) or not len(ys):
                continue
            u = min(w, v)
            left, right = (np.stack([folded(bits[j], u) for j in own.tolist()]) for own in (xs, ys))
            count_left, count_right = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (left, right))
            step = max(1, 2_000_000 // (len(ys) * left.shape[1]))
            for a in range(0, len(xs), step):
                x = xs[a : a + step]
                both = np.bitwise_count(left[a : a + step, None] & right[None]).sum(2, dtype=np.int64)
                # an element in one bitmap only is in one set only
                overlap = np.minimum(n[x][:, None] - (count_left[a : a + step, None] - both), n[ys][None] - (count_right[None] - both))
                hit = (DEN * overlap >= NUM * (n[x][:, None] + n[ys][None] - overlap)) & (comp[x][:, None] != comp[ys][None])
                flagged[x] |= hit.any(1)
                flagged[ys] |= hit.any(0)
    if not flagged.any():
        return None
    return cell.select(["key", "block", "id", "comp", "n", "role"]).filter(pa.array(flagged)).combine_chunks().to_batches()[0]


def joining_links(cell: pa.Table) -> pa.RecordBatch | None:
    """Pairs (a, b) of components that a link between two sets of the cell joins; fewer than it has components."""
    comp, role = cell["comp"].to_numpy().copy(), cell["role"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in cell["hashes"].to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    xs, ys = np.flatnonzero(role & 1 > 0), np.flatnonzero(role & 2 > 0)
    if not len(xs) or not len(ys):
        return None
    element = np.concatenate([sets[j] for j in ys.tolist()])
    owner = np.repeat(np.arange(len(ys)), n[ys])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    found, at = [], 0
    while at < len(xs):
        # seekers whose elements meet about four million postings at once
        stop = at + max(1, int(np.searchsorted(np.cumsum(n[xs[at : at + 256]]), 4_000_000 // len(ys) + 1)))
        own = xs[at:stop]
        h = np.concatenate([sets[i] for i in own.tolist()])
        low, high = np.searchsorted(element, h, "left"), np.searchsorted(element, h, "right")
        times = high - low
        seeker = np.repeat(np.repeat(np.arange(len(own)), n[own]), times)
        posting = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        overlap = np.bincount(seeker * len(ys) + owner[posting], minlength=len(own) * len(ys)).reshape(len(own), len(ys))
        similar = DEN * overlap >= NUM * (n[own][:, None] + n[ys][None] - overlap)
        for i, row in zip(own.tolist(), similar, strict=True):
            for other in np.unique(comp[ys[row]]).tolist():
                if other != comp[i]:
                    found.append((min(other, int(comp[i])), max(other, int(comp[i]))))
                    comp[comp == found[-1][1]] = found[-1][0]
        at = stop
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def components_of(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles of (doc_id, text) rows, and rows (cid, s1, s2, n, doc_id, comp): each distinct non-empty set, its smallest id and its component."""
    with small_batches(source.sparkSession):
        return _components_of(source)


def _components_of(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = source.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = spark.sparkContext.broadcast(frequent(source, max(least, size_of(source) // SAMPLE // TASK_BYTES + 1)))
    full = cut(profiles(source, hot), "profiles")
    # signatures and prefixes are wide: sets are told apart without them, and their first rows picked where they are
    grouped = cut(full.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("cid"), F.min("doc_id").alias("doc_id")), "keys")
    classes = cut(only(full, grouped.select("cid")).withColumnRenamed("row", "cid"), "classes")
    rows = cut(full.select("doc_id", "n", "s1", "s2"), "rows")
    dropped(full)
    postings = classes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    parts = max(least, postings // (KEY_BITS // 8) // TASK_POSTINGS + 1)

    tiles = cut(tie(deal(classes, hot, parts)), "tiles")
    release(spark)
    centres = tiles.select(F.col("centre1").alias("a"), F.col("id").alias("b")).unionByName(tiles.select(F.col("centre2").alias("a"), F.col("id").alias("b")))
    # centres of the parts of a large tile are tied to the most central of them
    part_centres = tiles.where("salted and (id = centre1 or id = centre2)").select("key", F.floor(F.log(F.col("n")) * _BANDS).alias("band"), "id", "n", "central").distinct()
    top = part_centres.groupBy("key", "band").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), F.col("n").alias("m"))).alias("top"))
    across = part_centres.join(top, ["key", "band"]).where(F.least("n", "top.m") * DEN >= F.greatest("n", "top.m") * NUM).select((-F.col("top.minus")).alias("a"), F.col("id").alias("b"))
    ties = cut(centres.unionByName(across).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ties")
    components = connected(verified(ties, classes, source))

    label = tiles.select("key", "salted", "id", "n", "far").join(components, "id", "left").withColumn("comp", F.coalesce("component", "id")).select("key", "salted", "id", "n", "far", "comp")
    label = cut(unsettled_rows(label, parts), "unsettled")
    dropped(tiles)
    mark = F.xxhash64("id")
    sizes = label.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("shingles"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 40))).alias("y"))
    per_key = sizes.groupBy("key").agg(F.sum("held").alias("members"), F.sum("shingles").alias("shingles"), F.max(F.struct("held", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).where("comps > 1")
    # tiles with the same members hold the same pairs: one of them is searched
    per_key = per_key.groupBy("members", "shingles", "x", "y").agg(F.min(F.struct("key", "top")).alias("one")).select("one.key", "members", "shingles", "one.top")
    open_rows = cut(in_cells(label.join(per_key, "key").withColumn("major", F.col("comp") == F.col("top.comp"))), "open")
    signed = open_rows.join(only(classes.select("cid", "bits"), open_rows.select("id")).withColumnRenamed("cid", "id"), "id")
    hopeful = cut(by_cell(signed, "bits", parts, suspects, "key long, block long, id long, comp long, n int, role int"), "suspects")
    wanted = cut(classes.join(hopeful.select(F.col("id").alias("cid")).distinct(), "cid").select("cid", "doc_id", "s1", "s2"), "wanted")
    sets = cut(sets_of(source, wanted), "sets").withColumnRenamed("cid", "id")
    joined = connected(cut(by_cell(hopeful.join(sets, "id"), "hashes", parts, joining_links, "a long, b long"), "joining"))

    for one in (label, open_rows, hopeful, wanted, sets, classes):
        dropped(one)
    release(spark)

    first = grouped.join(components.withColumnRenamed("id", "cid"), "cid", "left").withColumn("first", F.coalesce("component", "cid"))
    last = first.join(joined.select(F.col("id").alias("first"), F.col("component").alias("merged")), "first", "left")
    return rows, last.select("cid", "s1", "s2", "n", "doc_id", F.coalesce("merged", "first").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each input row.

    Words are runs of characters other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a set holds
    the distinct five-word shingles, or the whole sequence where there are fewer words. Texts that
    are null or have no word have an empty set and are linked with nothing, so their component is
    their own id. Ids may be null (never the smallest) or repeat. Links join documents at
    100 * intersection >= 75 * union; component_id is the smallest id reachable by them.
    """
    rows, grouped = components_of(_text(docs, id_col, text_col))
    by_set = ["s1", "s2", "n"]
    lowest = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = cut(grouped.join(lowest, "comp").select("s1", "s2", "n", "component_id"), "named")
    full = rows.where("n > 0").select("doc_id", *by_set).join(named, by_set).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs with their set's size and key beside (__n, __s1, __s2); one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices_of(batch.column(text_col)):
                h, first = shingle_sets(s)
                s1, s2 = set_keys(h, first)
                own = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.diff(first)), pa.array(s1), pa.array(s2)], [*own.schema.names, "__n", "__s1", "__s2"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("__n", "__s1", "__s2"))]))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates one row of docs, with all its columns; rows without words are in no group and all stay.

    Groups are the components of near_duplicates, decided by text: rows that share an id and not a
    component are decided apart. The smallest id stays, null ids only where a group has no other;
    of several rows with that id the one with the smallest set (size, then key), then the smallest row.
    """
    rows, grouped = components_of(_text(docs, id_col, text_col))
    # by set and id, both of which a row tells by itself; ids that are null are equal
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n", "s1", "s2")).alias("one")
    keep = cut(grouped.groupBy("comp").agg(lowest).select(*[F.col(f"one.{c}").alias(f"__keep_{c}") for c in ("doc_id", "n", "s1", "s2")]), "kept-sets")

    def kept(df: DataFrame, doc_id: Column, n: str, s1: str, s2: str) -> DataFrame:
        same = doc_id.eqNullSafe(keep["__keep_doc_id"])
        for own, c in ((n, "n"), (s1, "s1"), (s2, "s2")):
            same &= df[own] == keep[f"__keep_{c}"]
        return df.join(keep, same, "left_semi")

    wordless = ~F.coalesce(docs[text_col].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    with_keys = keyed(docs.where(~wordless), text_col)
    out = kept(with_keys, with_keys[id_col].cast("long"), "__n", "__s1", "__s2")
    found = rows.where("n > 0").select("doc_id", "n", "s1", "s2")
    if not kept(found, found["doc_id"], "n", "s1", "s2").groupBy("doc_id", "n", "s1", "s2").count().where("count > 1").isEmpty():
        names = docs.columns
        out = out.groupBy(F.col(id_col).cast("long"), "__n", "__s1", "__s2").agg(F.min(F.struct(*names)).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in names])
    return docs.where(wordless).unionByName(out.select(*docs.columns))
