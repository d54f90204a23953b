from __future__ import annotations

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from deltamesh.llm import mixing, tokens, toxicity
from deltamesh.llm.stages import ngram_jaccard, quality_rules
from tests.llm.test_ngram_join import brute, shingles
from tests.llm.test_simple_operators import judged

BAD = ["zorkish", "blarfen", "idiot"]


def corpus():
    r = random.Random(4)
    words = [f"word{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randrange(20, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(r.randrange(2, 6)):
                text.insert(r.randrange(len(text)), r.choice(BAD))
        rows.append((i, " ".join(text), "en", "s", 1.0))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    rows += [(5000, None, "en", "s", 1.0), (5001, "", "en", "s", 1.0), (None, "you idiot idiot", "en", "s", 1.0), (5002, "word " * 30000 + "zorkish blarfen " * 300, "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels + [(0, 1, None), (None, 1, 1), (1, 1, 7)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(tables):
    docs, labels = tables
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: int(i % 6 == 0) for i in range(900)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == by[5001].predicted == 0 and by[5002].predicted == 1 and by[5000].score == by[5001].score
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_without_labels_or_rows(tables):
    docs, labels = tables
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels.where("false")).collect()}
    assert got[None] == 1 and got[1] == 0
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_label_model_finds_accuracies_and_shares():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    vote = lambda acc: np.where(r.random(4000) < acc, y, ~y) * 2 - 1
    one = vote(0.8)
    votes = np.stack([vote(0.95), vote(0.9), vote(0.7), one, one], 1).astype(np.int8)
    m = toxicity.fit_label_model(votes, 0.3)
    a = m.accuracies()
    assert abs(a[0] - 0.95) < 0.04 and abs(a[1] - 0.9) < 0.05 and a[2] < a[1]
    assert m.share[3] < 0.6 and m.share[4] < 0.6 and m.share[0] > m.share[3]
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.93


def test_filter_stages_as_brute_force(spark):
    r = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    base = [" ".join(r.choice(words) for _ in range(80)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " extra") for i, t in enumerate(base[:6])] + [(200, base[0]), (200, base[0]), (201, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = ngram_jaccard(spark, df, "")
    comp = brute(rows)
    assert out.columns == df.columns
    assert sorted(x.doc_id for x in out.collect()) == sorted({d for d, n, c in comp if n == 0 or d == c})
    assert {x.doc_id for x in quality_rules(spark, df, "").collect()} == {i for i, t in rows if t}


def groups(texts):
    """A group's number per text, all pairs compared; None without words."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [g if s else None for g, s in zip(group, sets, strict=True)]


def lowest_of_groups(rows):
    """Per group the smallest id (None last), and which texts it may come with; all wordless rows."""
    group = groups([t for _, t in rows])
    ids = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if g is not None:
            ids[g] = min(ids.get(g, (True, 0)), (d is None, d or 0))
    return ids, group


def assert_one_per_group(spark, rows):
    df = spark.createDataFrame([(t, "s", d, 1, 2) for d, t in rows], "text string, source string, doc_id long, n int, s1 long")
    out = ngram_jaccard(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    ids, group = lowest_of_groups(rows)
    at = {(d, t): g for g, (d, t) in zip(group, rows, strict=True)}
    assert sorted((x for x in got if at[x] is None), key=str) == sorted((x for x, g in zip(rows, group, strict=True) if g is None), key=str)
    left = [(at[x], (x[0] is None, x[0] or 0)) for x in got if at[x] is not None]
    assert sorted(left) == sorted(ids.items())
    return got


def passages(seed, n):
    r = random.Random(seed)
    words = [f"u{i}" for i in range(600)]
    return [" ".join(r.choice(words) for _ in range(70)) for _ in range(n)]


def test_null_ids_keep_one_row_per_group(spark):
    a, b, c, d = passages(1, 4)
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (3, c), (None, c + " more"), (4, d), (None, None), (None, " "), (9, "")]
    got = assert_one_per_group(spark, rows)
    assert sum(x is None for x, t in got if (t or " ").strip()) == 2 and len(got) == 7


def test_repeated_ids_are_decided_by_their_texts(spark):
    a, b, c, d, e = passages(2, 5)
    rows = [(2, b), (5, a), (5, b + " more"), (6, c), (6, d), (6, c + " more"), (6, c), (7, e), (7, e), (8, None), (8, None), (8, ""), (None, d + " more")]
    got = assert_one_per_group(spark, rows)
    assert {(2, b), (5, a), (6, d)} <= set(got) and len(got) == 8


def test_pipeline_from_end_to_end(spark, tmp_path):
    r = random.Random(11)
    words = [f"word{i}x" for i in range(300)]
    clean = [" ".join(r.choice(words) for _ in range(r.randrange(60, 120))) for _ in range(240)]
    bad = [" ".join(w if k % 12 else r.choice(BAD) for k, w in enumerate(t.split())) for t in clean[:80]]
    a, b, c, d = clean[100:104]
    odd = [(None, a + " more"), (None, b + " more"), (900, b), (None, "first " + " ".join(reversed(c.split()))), (None, "first " + " ".join(reversed(c.split())))]
    odd += [(3000, " ".join(sorted(d.split()))), (3000, "last " + clean[104]), (3000, " ".join(sorted(clean[105].split()))), (None, bad[0]), (3001, None), (3001, ""), (3002, "few words"), (3002, "few words")]
    rows = [*((i, t) for i, t in enumerate(clean)), *((1000 + i, t) for i, t in enumerate(bad)), *odd]
    docs = [(d, t, "en", f"src{len(t or '') % 3}", 1.0, 5, "x") for d, t in rows]
    # `score` and `n` are names that stages use too
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double, n int, s1 string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d >= 1000)) for d, _ in rows if d is not None and d < 2000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    left = [x for x in docs if not any(w in (x[1] or "").split() for w in BAD)]
    left = [x for x in left if judged((x[0], x[1]))[-1]]
    ids, group = lowest_of_groups([x[:2] for x in left])
    kept = {g: x for g, x in reversed(list(zip(group, left, strict=True))) if (x[0] is None, x[0] or 0) == ids[g]}
    assert len(kept) < len(left) and sum(x[0] is None for x in kept.values()) == 1 and sum(x[0] == 3000 for x in kept.values()) == 2
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([x[0] for x in kept.values()], pa.int64()), "text": [x[1] for x in kept.values()], "source": [x[3] for x in kept.values()]}))
    tokenizer, text_of = Tokenizer.from_file(tokens.default_path()), defaultdict(list)
    for x in kept.values():
        text_of[x[0], len(x[1].split())].append(x[1])
    want = []
    for doc, size, _, _, taken in con.execute(mixing.MIXING_SQL).fetchall():
        (text,) = text_of[doc, size]
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want += [(doc, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] * (taken // size)
    assert sorted(got, key=str) == sorted(want, key=str)
