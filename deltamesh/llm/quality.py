"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document, right after its measurements. The ledger row holds the
measurements and a 64-bit mask of the rules that failed, and is written to the shared folder. A
policy is a versioned mask of rules that reject, so a policy's verdict and the effect of leaving
one rule out are bitwise expressions over the ledger: no text is read again. The pipeline's stage
carries the same mask beside its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deltamesh.llm.common import cut
from deltamesh.llm.textarrays import IS_SPACE, Slice, slices_of, windows, words_of

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


Measures = dict[str, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """A named failure condition over arrays of measurements; its bit is its place in RULES."""

    name: str
    failed: Callable[[Measures], np.ndarray]


#: Order is part of the ledger's format: rules are only ever added at the end.
RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("mostly_repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    Rule("words_too_long", lambda m: m["word_chars"] > 12 * m["n_words"]),
    Rule("words_too_short", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 60 * m["word_chars"]),
    Rule("some_repeats", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
BIT = {r.name: i for i, r in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


BASE = mask_of("too_few_words", "mostly_repeats")
#: Versioned policies: the rules that reject under each.
POLICIES = {
    "base-1": BASE,
    "standard-1": BASE | mask_of("symbols", "repeated_lines", "words_too_long", "words_too_short", "shouting"),
    "strict-1": (1 << len(RULES)) - 1,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(s: Slice) -> Measures:
    """All measurements of a slice's documents."""
    raw = s.body
    w = words_of(s)
    space = IS_SPACE[raw]
    chars = _per_document(~space & ((raw & 0xC0) != 0x80), s.bounds)
    out = {"n_words": np.diff(w.first), "word_chars": chars, "n_symbols": _per_document(_IS_SYMBOL[raw], s.bounds)}
    out["n_upper"] = _per_document((raw >= 65) & (raw <= 90), s.bounds)

    # three-word windows: sort (document, window), mark those met twice, spread over three words
    h, begin = windows(w.hash, w.first, 3)
    doc = np.repeat(np.arange(s.n), np.diff(begin))
    key = h ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    hit = np.flatnonzero(twice)
    at = hit - begin[doc[hit]] + w.first[doc[hit]]
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[at + k] = True
    out["n_repeat_words"] = _per_document(covered, w.first)

    # lines: split at \n; with a word: holding a byte that is no white space
    n_lines, n_dup = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
    newline = np.flatnonzero(raw == 10)
    for d in np.unique(np.searchsorted(s.bounds, newline, "right") - 1).tolist():
        lines = raw[s.bounds[d] : s.bounds[d + 1]].tobytes().split(b"\n")
        full = [x for x in lines if x and not x.isspace()]
        n_lines[d], n_dup[d] = len(full), len(full) - len(set(full))
    single = (n_lines == 0) & (out["n_words"] > 0)
    n_lines[single] = 1
    return out | {"n_lines": n_lines, "n_dup_lines": n_dup}


def mask(m: Measures) -> np.ndarray:
    """The failed rules of each document as bits."""
    out = np.zeros(len(m["n_words"]), np.int64)
    for i, r in enumerate(RULES):
        out |= r.failed(m).astype(np.int64) << i
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, the measurements, failed bigint), one for each input row, written once.

    Null texts measure 0 everywhere, as empty ones do, and fail by their word count. Ids may be
    null or repeat. The text leaves the scan once; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices_of(batch.column(1)):
                m = measure(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(mask(m))], ["doc_id", *MEASURES, "failed"])

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cut(source.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES) + ", failed long"), "quality-ledger")


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row survives a policy."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that pass once it is left out."""
    total = F.count(F.lit(1))
    rejecting = POLICIES[policy]
    found = F.col("failed").bitwiseAND(F.lit(rejecting))
    parts = []
    for i, r in enumerate(RULES):
        if rejecting >> i & 1:
            fails = F.count_if(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0)
            alone = F.count_if(found == (1 << i))
            without = F.count_if(F.col("failed").bitwiseAND(F.lit(rejecting & ~(1 << i))) == 0)
            parts.append(F.struct(F.lit(r.name).alias("rule"), fails.alias("n_failed"), alone.alias("n_only"), without.alias("n_kept_without"), total.alias("n_documents")))
    return rows.agg(F.array(*parts).alias("rules")).select(F.inline("rules"))


def judge_quality(docs: DataFrame, policy: str = "standard-1") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (passes(policy) & ~base).alias("kept"))


def keep_rows(docs: DataFrame, policy: str = "standard-1", text_col: str = "text") -> DataFrame:
    """The rows of docs that a policy passes, with all their columns.

    Each row gets its mask in one map, and the policy is applied to the mask; nothing is joined. A
    null or empty text fails by its word count; equal rows are decided alike; no column's name is
    taken. Empty docs give an empty result.
    """
    own = "__failed"
    while any(c.lower() == own for c in docs.columns):
        own += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices_of(batch.column(text_col)):
                rows = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(mask(measure(s)))], [*rows.schema.names, own])

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(own, LongType())]))
    return marked.where(passes(policy, own)).drop(own)


#: The same by DuckDB.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_words, ws,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
g AS (SELECT r, i, (ws[i], ws[i + 1], ws[i + 2]) AS gram FROM (SELECT r, ws, unnest(generate_series(1, n_words - 2)) AS i FROM m)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_upper, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars > 12 * n_words
            OR word_chars < 2 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM b
"""
