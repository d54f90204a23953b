from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deltamesh.llm import ctw
from deltamesh.llm.textarrays import slices_of

SCHEMA = "base double, doc_id long, text string, n long"
ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog sat", None, "", " \n", "été à côté", "x" * 5000, "the the THE the", "zebra!", "dog dog cat", "the cat sat on the mat", "mat"] * 3)] + [(None, "cat"), (4, "the dog sat")]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


def tokens(t):
    return (t or "").encode().lower().split() + [b"\0end"]


def tree_score(train, text, depth):
    """The context tree, node by node and without arrays."""
    counts = Counter()
    for t in train:
        b = b"\0" * depth + t
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                node = 1
                for k in range(8):
                    bit = b[i] >> (7 - k) & 1
                    counts[b[i - d : i], node, bit] += 1
                    node = node * 2 + bit
    kt = lambda a, c: math.lgamma(a + 0.5) + math.lgamma(c + 0.5) - math.lgamma(a + c + 1) - math.log(math.pi)
    own = {}
    for ctx, node, _ in counts:
        own[ctx, node] = kt(counts[ctx, node, 0], counts[ctx, node, 1])
    mix = {k: v for k, v in own.items() if len(k[0]) == depth}
    for d in range(depth - 1, -1, -1):
        below = Counter()
        for (ctx, node), v in mix.items():
            if len(ctx) == d + 1:
                below[ctx[1:], node] += v
        for (ctx, node), v in own.items():
            if len(ctx) == d:
                mix[ctx, node] = math.log(0.5) + np.logaddexp(v, below[ctx, node])
    total = 0.0
    b = b"\0" * depth + text
    for i in range(depth, len(b)):
        node = 1
        for k in range(8):
            bit = b[i] >> (7 - k) & 1
            p = None
            for d in range(depth, -1, -1):
                ctx = b[i - d : i]
                z, o = counts[ctx, node, 0], counts[ctx, node, 1]
                e = (o + 0.5) / (z + o + 1)
                if d == depth:
                    p = e
                else:
                    stop = math.exp(math.log(0.5) + own[ctx, node] - mix[ctx, node]) if (ctx, node) in own else 0.5
                    p = stop * e + (1 - stop) * p
            total += math.log10(p if bit else 1 - p)
            node = node * 2 + bit
    return total


@pytest.mark.parametrize("depth", [5, 3])
def test_same_as_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(ctw, "HEAD", 3)
    monkeypatch.setattr(ctw, "HEAD_GRAMS", 40)
    df = spark.createDataFrame([(0.5, d, t, 1) for d, t in ROWS], SCHEMA)
    got = sorted((tuple(r) for r in ctw.score_texts(df, depth=depth).collect()), key=str)
    train = [t or "" for d, t in ROWS if not held(d)]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in ROWS:
        ws = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws)
        want.append((d, held(d), len(ws), sum(c[x] > 0 for x in ws), n, base, tree_score([x.encode() for x in train], (t or "").encode(), depth)))
    want.sort(key=str)
    for g, w in zip(sorted(got, key=lambda r: (str(r[:4]), r[6])), sorted(want, key=lambda r: (str(r[:4]), r[6])), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g[6], w[6], rel_tol=1e-4, abs_tol=1e-6)
    for r in ctw.score_texts(df).where("n_tokens = 1 or doc_id = 6").collect():
        assert r.bits_per_byte is None if r.score == 0 else math.isclose(r.bits_per_byte, -r.score / math.log10(2) / (5000 if r.doc_id == 6 else 2), rel_tol=1e-9)


def test_empty_and_untrained(spark):
    assert ctw.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    only = next(i for i in range(1000) if held(i))
    r = ctw.score_texts(spark.createDataFrame([(0.0, only, "ab", 1)], SCHEMA)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 2, 0, 0)
    assert math.isclose(r.base_score, 0.0, abs_tol=1e-12) and math.isclose(r.score, 16 * math.log10(0.5), rel_tol=1e-5)


def test_probabilities_sum_to_one():
    (s,) = slices_of(pa.array(["some text, some more text; the same text"]))
    key, n = np.unique(ctw.grams(s, 4), return_counts=True)
    for context in np.unique(key >> 8)[::7]:
        every = np.unique(np.r_[key, (context << 8) | np.arange(256)])
        count = np.zeros(len(every))
        count[np.searchsorted(every, key)] = n
        entry, sums, p = ctw.fold(every, count, 4)
        log = ctw.Top(entry, *sums).log10(every, p, 4)
        assert math.isclose((10.0 ** log[every >> 8 == context]).sum(), 1, rel_tol=1e-9)


def test_deeper_contexts_tell_more(spark):
    r = random.Random(1)
    words = [f"{x}ing{x}" for x in "abcdefgh"]
    rows = [(0.5, i, " ".join(r.choice(words) for _ in range(60)), 1) for i in range(400)]
    bits = [ctw.score_texts(spark.createDataFrame(rows, SCHEMA), depth=d).where("held_out").agg({"bits_per_byte": "avg"}).first()[0] for d in (3, 5)]
    assert bits[1] < bits[0] - 0.1
