from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from deltamesh.llm import ngram_join
from deltamesh.llm.common import scratch_root
from deltamesh.llm.ngram_join import near_duplicates, partnered, reach, shingle_sets
from deltamesh.llm.textarrays import slices_of

SCHEMA = "lang string, doc_id long, text string, n long, s1 string"


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """(id, set size, component) per row, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([("x", d, t, 3, "clash") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    hub = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):  # copies with few and with many edits around one original
        w = list(hub)
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, passage + " " + " ".join(r.choice(words) for _ in range(r.choice([5, 15, 20, 90])))) for i in range(60)]
    rows += [(200 + i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "One\tTWO"), (305, "one two"), (305, "one two"), (None, "one two"), (None, "alone here"), (306, "\x0bone\x0ctwo ")]
    rows += [(310, "long " * 3000 + " ".join(words)), (311, "long " * 3000 + " ".join(words) + " x")]
    return rows


def test_same_components_as_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_sets_have_the_sizes_of_python_sets():
    texts = [t for _, t in corpus()] + ["é È ç " * 5, "A a A a A a"]
    sizes = []
    for s in slices_of(pa.array(texts, pa.string()), limit=5000):
        sizes += np.diff(shingle_sets(s)[1]).tolist()
    assert sizes == [len(shingles(t)) for t in texts]


def near_misses(seed):
    """A large group whose members are mostly a little too different from each other, and a chain through it."""
    r = random.Random(seed)
    hub = [f"h{i}" for i in range(90)]
    rows = []
    for i in range(260):
        w = list(hub[: r.choice([60, 75, 90])])
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(30):
        rows.append((500 - i, " ".join(chain)))
        chain[(7 * i) % 60] = f"x{i}"
    return rows


def test_large_tiles_in_parts_and_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_misses(3)
    want = brute(rows)
    assert 20 < len({c for _, _, c in want}) < len(rows) - 20
    assert run(spark, rows) == want


def test_partners_within_reach_as_all_pairs(monkeypatch):
    r = np.random.default_rng(2)
    for small in (64, 3):
        monkeypatch.setattr(ngram_join, "SMALL_TILE", small)
        tile = np.sort(r.integers(0, 60, 400))
        n = r.integers(5, 60, 400)
        far = reach(n, r.integers(0, 1 + n // 4))
        for comp in (None, r.integers(0, 9, 400)):
            one = (tile[:, None] == tile) & (n[None] <= far[:, None]) & (4 * n[None] >= 3 * n[:, None])
            one &= ~np.eye(400, dtype=bool) if comp is None else comp[:, None] != comp
            got = partnered(tile, n, far, comp)
            assert (got >= (one & one.T).any(1)).all() and (got <= one.any(1)).all()
            if small == 64:
                assert (got == (one & one.T).any(1)).all()


def test_cells_pass_on_fewer_links_than_rows():
    r = random.Random(8)
    sets = [np.unique(np.array([r.randrange(1, 130) for _ in range(400)], "<u8")) for _ in range(150)]
    cell = pa.table({"comp": np.arange(150), "role": np.full(150, 3, np.int32), "hashes": pa.array([x.tobytes() for x in sets], pa.binary())})
    links = ngram_join.joining_links(cell)
    assert links.num_rows == 149 and all(a < b for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True))


def test_wide_rows_come_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    whole = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda *a: seen.append(int(spark.conf.get(key))) or whole(*a))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i % 2}") for i in range(4)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    assert seen == [ngram_join.BATCH_ROWS] and spark.conf.get(key) == before


def test_wide_tables_go_when_they_are_read(spark):
    folder = Path(scratch_root(spark).removeprefix("file:").replace("//", "/"), "deltamesh")
    before = set(folder.glob("*"))
    rows = near_misses(4)
    assert run(spark, rows) == brute(rows)
    left = {x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - before}
    assert "rows" in left and not left & {"profiles", "classes", "tiles", "unsettled", "hopeful", "suspects", "open", "wanted", "sets"}


def test_postings_come_back_from_their_bytes():
    r = np.random.default_rng(6)
    key, salt = r.integers(0, 1 << 48, 99, dtype=np.uint64), r.integers(0, 1 << 16, 99, dtype=np.uint64)
    cid, n, place, central = r.integers(0, 1 << 62, 99), r.integers(0, 1 << 31, 99), r.integers(0, 1 << 31, 99), r.integers(0, 1001, 99)
    got = ngram_join.unpacked_postings(ngram_join.packed_postings(key, salt, cid, n, place, central))
    for x, y in zip(got, (key | (salt << np.uint64(48)), cid, n, place, central), strict=True):
        assert (x == y).all()


def test_only_the_rows_asked_for(spark):
    numbers = [0, 1, 32767, 32768, 65535, (1 << 33) - 1, 1 << 33, (5 << 33) + 40000]
    rows = spark.createDataFrame([(x, f"r{x}") for x in numbers], "row long, name string")
    for want in ([], [0], [32767, 1 << 33], numbers[1::2]):
        ids = spark.createDataFrame([(x,) for x in [*want, *want, 77]], "id long")
        assert sorted(r.row for r in ngram_join.only(rows, ids).collect()) == sorted(want)
