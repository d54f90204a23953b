"""Token counts, packing, quality rules, mixing, top-k, archives and chats against brute force or the libraries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from deltamesh.llm import chat, mixing, packing, quality, tokens, topk, warc
from deltamesh.llm.common import scratch
from deltamesh.llm.textarrays import slices_of

DOCS = "n_words string, doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(7)
    odd = ["été", "ÀÉÎ", "don't", "it's", "<|endoftext|>", "a<|endoftext|>b", "日本語", "É́x", "x" * 300, "1234", "#$%&|", "aaaaaaa", "ΑΣ", "\x1c", "\x85", "🙂🙂", "İ"]
    out = [None, "", " \n\t", "one", "ONE two\nONE two\n\nthree", "w " * 60, "long " * 4000]
    for _ in range(120):
        words = [r.choice(odd) if r.random() < 0.2 else "".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 90))]
        out.append(r.choice([" ", "\n", "  "]).join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    ids = list(range(len(texts()))) + [5, 5, None]
    ts = texts() + ["same id", "same id", "no id"]
    return [(i, t, f"s{(i or 0) % 4}" if (i or 0) % 5 else None) for i, t in zip(ids, ts, strict=True)]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([("x", *d) for d in docs], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_token_counts_as_the_library(frame, docs, none):
    t = Tokenizer.from_file(tokens.default_path())
    n = [len(e.ids) for e in t.encode_batch([d[1] or "" for d in docs], add_special_tokens=False)]
    same(tokens.token_counts(frame, limit=100).collect(), [(d[0], len((d[1] or "").encode()), k, k > 100) for d, k in zip(docs, n, strict=True)])
    assert tokens.token_counts(none).count() == 0


def test_token_ids_with_a_small_table(monkeypatch):
    t = Tokenizer.from_file(tokens.default_path())
    m = tokens.RankMerger(tokens.default_path())
    monkeypatch.setattr(tokens, "POOLED", 500)
    for _ in range(2):
        for s in slices_of(pa.array(texts()), limit=700):
            r = m.tokens(s, ids=True)
            for k in range(s.n):
                assert r.ids[r.first[k] : r.first[k + 1]].tolist() == t.encode(texts()[s.first + k] or "", add_special_tokens=False).ids


def test_packing_is_whole_and_tight(frame, docs, none):
    t = Tokenizer.from_file(tokens.default_path())
    rows = packing.pack_documents(frame, capacity=64).collect()
    want = []
    for d in docs:
        ids = t.encode(d[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want.append((d[0], k // 64, k, len(part), zlib.crc32(part.tobytes())))
    same([r[:5] for r in rows], want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(w[3] for w in want) // 64) + 1
    assert packing.pack_documents(none).count() == 0


def test_local_search_saves_bins():
    start = Counter({(40,): 2, (30, 20): 1, (14, 10): 1})
    done = packing.improve(start, 64)
    assert sum(done.values()) == 3
    flat = lambda c: Counter(x for p, n in c.items() for x in p * n)
    assert flat(done) == flat(start) and all(sum(p) <= 64 for p in done)
    r = random.Random(1)
    lengths = Counter(r.randrange(1, 200) for _ in range(3000))
    bins = packing.improve(packing.best_fit(lengths, 256), 256)
    assert flat(bins) == lengths and all(sum(p) <= 256 for p in bins)
    assert sum(bins.values()) <= -(-sum(k * n for k, n in lengths.items()) // 256) * 1.01 + 1


def test_local_search_ends_where_no_change_gains():
    r = random.Random(2)
    lengths = Counter(r.randrange(200, 900) for _ in range(300))
    bins = packing.improve(packing.best_fit(lengths, 2048), 2048)
    assert sum((Counter(x for p, n in bins.items() for x in p * n) - lengths).values()) == 0 and all(sum(p) <= 2048 for p in bins)
    under = [p for p, n in bins.items() if sum(p) < 2048]
    for donor in under:
        given = {x for x in donor} | {donor[i] + donor[j] for i in range(len(donor)) for j in range(i)}
        for taker in under:
            if taker != donor or bins[donor] > 1:
                gains = [g - out for g in given for out in {0, *taker} if out < g <= 2048 - sum(taker) + out and (out or g in donor)]
                assert all(sum(taker) - sum(donor) + gain <= 0 for gain in gains)


def judged(d):
    text = d[1] or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, symbols, dup, rep = len(words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    chars = sum(map(len, words))
    base = n < 50 or 100 * rep > 50 * n
    upper = sum("A" <= c <= "Z" for c in text)
    bad = 10 * symbols > n or 100 * dup > 40 * len(lines) or chars > 12 * n or chars < 2 * n or 100 * upper > 60 * chars
    return d[0], n, chars, symbols, dup, rep, base, not (base or bad)


def test_quality_as_brute_force(frame, docs, none):
    same(quality.judge_quality(frame).collect(), [judged(d) for d in docs])
    kept = [d for d in docs if judged(d)[-1]]
    same([(r.doc_id, r.text, r.source) for r in quality.keep_rows(frame).collect()], kept)
    assert quality.judge_quality(none).count() == 0
    rows = {r.rule: r for r in quality.ablations(quality.ledger(frame), "standard-1").collect()}
    assert rows["too_few_words"].n_failed == sum(judged(d)[1] < 50 for d in docs)
    assert all(r.n_kept_without >= len(kept) for r in rows.values())


def test_mixing_as_sql_and_near_the_targets(spark, frame, none):
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sources(frame).collect()]
    want = con.execute(mixing.MIXING_SQL).fetchall()
    same(got, [(a, b, c, round(d, 6), e) for a, b, c, d, e in want])
    assert all(t <= 3 * s for _, s, _, _, t in got)
    assert mixing.mix_sources(none).count() == 0 and mixing.emit_mixed(none.drop("n_words")).count() == 0
    big = spark.range(4000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 40 as int)) text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end source")
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix_sources(big).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - goal) <= 0.005 * goal + 40 for t, goal in by.values())
    assert mixing.emit_mixed(big).count() == sum(r.copies for r in mixing.mix_sources(big).collect())
    clashing = big.selectExpr("*", "1 whole", "2 bins_drawn", "3 fraction", "4 offset", "5 u", "6 size", "7 s", "8 __mix", "9 __MIX_copy")
    mixed = mixing.emit_mixed(clashing)
    assert mixed.columns == clashing.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.emit_mixed(big).collect())
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(wordless).collect()] == [(0.0, 0)] * 2


def test_every_document_has_the_fraction_as_its_chance(spark):
    docs = spark.range(300).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 40 as int)) text", "if(id < 100, 'a', 'b') source")
    runs = [mixing.mix_sources(docs, seed=k).collect() for k in range(12)]
    fraction = {r.source: r.target / r.source_size % 1 for r in runs[0]}
    whole = {r.source: r.target // r.source_size for r in runs[0]}
    for source in "ab":
        more = np.array([[r.copies - whole[source] for r in sorted(run) if r.source == source] for run in runs])
        assert ((more == 0) | (more == 1)).all() and abs(more.mean() - fraction[source]) < 0.05
        small, large = more[:, np.arange(more.shape[1]) % 40 < 20].mean(), more[:, np.arange(more.shape[1]) % 40 >= 20].mean()
        assert abs(small - large) < 0.12


def test_top_k_as_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 6)).astype("float32")
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(700, None), (720, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (740, [float("nan")] * 6), (760, [float("inf")] * 6), (None, [1.0] * 6), (780, [0.5, 0.5]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = {i: np.floor(64 * v[i].astype(float)).astype(int) for i in range(700)} | {780: np.array([32, 32, 0, 0, 0, 0])}
    want = []
    for a in (i for i in q if i % 20 == 0):
        near = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:20]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(near)]
    same(topk.top_k(df).collect(), want)
    same(topk.top_k(df, query_set=8).collect(), want)
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_with_one_id_of_many_vectors(spark):
    r = np.random.default_rng(5)
    v = r.integers(-3, 4, size=(400, 4))
    ids = np.where(np.arange(400) < 150, 7, np.arange(400) % 130)
    v[:150] += 6
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.execute(topk.TOPK_SQL).fetchall()
    same(topk.top_k(df.repartition(2)).collect(), want)
    assert max(Counter(w[0] for w in want).values()) == 20


def test_search_prunes_blocks():
    r = np.random.default_rng(1)
    centre = r.normal(size=(20, 16)) * 40
    v = np.floor(centre[r.integers(0, 20, 8000)] + r.normal(size=(8000, 16))).astype(np.int64)
    s = v[:10] @ v.T
    s[np.arange(10), np.arange(10)] = topk._LOWEST
    want = np.sort(s, 1)[:, ::-1][:, :5]
    best = topk.Best(10, 5, np.full(10, topk._LOWEST))
    scored = [topk.search(best, np.arange(10), v[:10], np.arange(a, a + 2000), v[a : a + 2000]) for a in range(0, 8000, 2000)]
    assert (want == best.score).all()
    assert sum(x for x, _ in scored) < sum(x for _, x in scored) / 4


def test_bounds_hold_and_large_components_do_not_wrap():
    r = np.random.default_rng(4)
    for scale, kind in ((1 << 28, "uniform"), (50, "normal")):
        v = (r.uniform(-1, 1, (500, 64)) if kind == "uniform" else r.normal(size=(500, 64))) * scale
        v = np.floor(v).astype(np.int64)
        order, starts = topk.ranges(v, 32)
        assert sorted(order.tolist()) == list(range(500)) and np.diff(np.r_[starts, 500]).max() <= 32
        v = v[order]
        score = np.maximum.reduceat(v.astype(object) @ v[:40].T.astype(object), starts).T
        assert (topk.bounds(v[:40], v, starts) >= score.astype(float)).all()


def test_archives(spark):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (1, "u", "x" * 100000), (None, "u", "only"), (7, "u", "<p>é</p>"), (2, "u", "tiny")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        want.append((i, len(b), warc.base32_sha1(b), "response" if i == f else "revisit", None if i == f else f))
    same(warc.archive_round_trip(df).collect(), want)
    assert all(r.record_type == "response" for r in warc.archive_round_trip(df, min_bytes=1 << 30).collect())
    assert warc.archive_round_trip(df.where("false")).count() == 0
    root = scratch(spark, "warc-test")
    index = warc.write_archives(df, root)
    got = warc.read_archives(index.where("page_id = 1"), root).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(1, b"x" * 100000)]


def test_chats_round_trip(spark):
    r = random.Random(2)
    bits = ["###", "### user: ", " </turn>\n", "\\", "\\#", ":", "<", "a\n", "é🙂", " "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "x: </turn>", None]), r.choice([None, ""] + ["".join(r.choice(bits) for _ in range(r.randrange(9)))] * 5)) for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [(99, None, "user", "null turn"), (None, 0, "assistant", "no id"), (50, 1, "user", "twice"), (50, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows + [(-7, i, a, b) for i, (a, b) in enumerate(chat.PROBE)]:
        groups[c].append((t is not None, t or 0, role or "", hashlib.sha1((text or "").encode()).hexdigest(), text or ""))
    assert set(got) == set(groups)
    for c, own in groups.items():
        own.sort()
        loss = "".join(x[4] for x in own if x[2] == "assistant")
        g = got[c]
        assert g.n_turns == len(own) and g.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[4]}\n" for x in own).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.render(x[2], x[4])[0]) for x in own)
    assert [x.conv_id for x in chat.format_conversations(df.where("false")).collect()] == [-7]


def test_folding_edits_and_regenerations(spark):
    log = [(1, 0, 0, "delta", "user", "he"), (1, 0, 1, "delta", "user", "y"), (1, 0, 5, "edit", "user", "hello"), (1, 0, 6, "delta", "user", "!"), (1, 1, 2, "delta", "assistant", "bad"), (1, 1, 3, "regenerate", "assistant", None), (1, 1, 4, "delta", "assistant", "good")]
    df = spark.createDataFrame(log, "conv_id long, place long, seq long, kind string, role string, text string")
    same(chat.fold(df).collect(), [(1, 0, "user", "hello!"), (1, 1, "assistant", "good")])
    with pytest.raises(ValueError):
        chat.parse("### user: a </turn>\nstray")
