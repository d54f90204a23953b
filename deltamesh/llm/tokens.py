"""Token counts and ids by rank-synchronous array merging.

Pre-tokens wait in batches as one ragged numpy array of symbols. In every round each pre-token
finds its own lowest-ranked adjacent pair, all of them merge at the same moment, and pre-tokens
without a mergeable pair leave. What survives are the tokens. Within one pre-token all places of
its lowest pair merge left to right, which is what merging one place at a time gives, because a
merge can only make pairs of a higher rank.

Pre-tokens are cut out of whole slices of text with byte classes. Chunks between white space that
hold an apostrophe, a special token or a character beyond Latin-1 letters go through the
vocabulary's own pattern one by one. Results of earlier pre-tokens are looked up in a table of
fixed size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from deltamesh.llm.textarrays import IS_SPACE, TO_LOWER, Slice, hashes, owners, runs, slices_of

#: Slots of a worker's table of pre-tokens seen, and the ids it may hold before it starts anew.
SLOTS = 1 << 21
POOLED = 6_000_000
_NONE = np.int32(1 << 30)
_SPACE_CLASS, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[IS_SPACE] = _SPACE_CLASS
_CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Ragged:
    """Token ids of consecutive documents: document k has ids[first[k]:first[k + 1]]."""

    ids: np.ndarray
    first: np.ndarray


class RankMerger:
    """Tokens of a word-end byte-pair vocabulary, for slices of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.forget()

    def forget(self) -> None:
        self.seen = np.zeros(SLOTS, np.uint64)
        self.count = np.zeros(SLOTS, np.int32)
        self.start = np.zeros(SLOTS, np.int32)
        self.pool, self.pooled = np.zeros(POOLED, np.int32), 0

    def odd_chunk(self, raw: bytes) -> list[bytes | int]:
        """A chunk's pre-tokens by the vocabulary's pattern; special tokens as their ids."""
        found: list[bytes | int] = []
        for k, part in enumerate(self.parts.split(raw.decode("utf-8", "replace")) if self.special else [raw.decode("utf-8", "replace")]):
            if k % 2:
                found.append(self.special[part])
            else:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += [w.encode() for w in self.words.findall(plain)]
        return found

    def cut(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, starts and ends of all pre-tokens in order, their places in the slice, ids of special ones (else -1)."""
        raw = s.body
        data = TO_LOWER[s.data]
        kind = _CLASS[data[:-8]]
        odd = raw >= 0x80
        lead = np.flatnonzero(raw == 0xC3)
        if lead.size:
            follow = data[lead + 1]
            kind[lead] = kind[lead + 1] = np.where((follow == 0x97) | (follow == 0xB7), _OTHER, _LETTER)
            upper = lead[(follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)] + 1
            data[upper] += 0x20
            odd[lead] = odd[lead + 1] = False
        odd |= raw == 0x27
        less = np.flatnonzero(raw == 0x3C)
        odd[less[s.data[less + 1] == 0x7C]] = True
        digits = kind == _DIGIT
        strange = np.flatnonzero(odd)
        chunks: list[tuple[int, int]] = []
        if strange.size:
            starts, ends = runs(kind != _SPACE_CLASS, s.bounds)
            own = np.unique(np.searchsorted(starts, strange, "right") - 1)
            chunks = list(zip(starts[own].tolist(), ends[own].tolist(), strict=True))
            for a, b in chunks:
                kind[a:b] = _SPACE_CLASS
            digits &= kind == _DIGIT
        places = []
        for which in (_LETTER, _OTHER):
            places.append(runs(kind == which, s.bounds))
        ones = np.flatnonzero(digits)
        places.append((ones, ones + 1))
        starts, ends = np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places])
        at, special = starts, None
        if chunks:
            more, sizes, where, ids = [], [], [], []
            for a, b in chunks:
                for x in self.odd_chunk(raw[a:b].tobytes()):
                    more.append(b"" if isinstance(x, int) else x)
                    ids.append(x if isinstance(x, int) else -1)
                    sizes.append(len(more[-1]))
                    where.append(a)
            ends2 = np.cumsum(np.array(sizes, np.int64)) + len(data)
            starts2 = ends2 - np.array(sizes, np.int64)
            data = np.concatenate([data, np.frombuffer(b"".join(more) + bytes(8), np.uint8)])
            special = np.concatenate([np.full(len(starts), -1, np.int64), np.array(ids, np.int64)])
            at = np.concatenate([starts, np.array(where, np.int64)])
            starts, ends = np.concatenate([starts, starts2]), np.concatenate([ends, ends2])
        order = np.argsort(at, kind="stable")
        special = special[order] if special is not None else np.full(len(order), -1, np.int64)
        return data, starts[order], ends[order], at[order], special

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ragged:
        """Ids of each byte run."""
        n = len(starts)
        sizes = ends - starts
        total = int(sizes.sum())
        if not total:
            return Ragged(np.zeros(0, np.int32), np.zeros(n + 1, np.int64))
        head = np.cumsum(sizes) - sizes
        flat = data[np.repeat(starts - head, sizes) + np.arange(total)]
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        symbols = self.inner[flat]
        tail = (head + sizes - 1)[sizes > 0]
        symbols[tail] = self.last[flat[tail]]
        rank, made = np.full(total, _NONE, np.int32), np.zeros(total, np.int32)
        look = np.flatnonzero(owner[1:] == owner[:-1])
        out_owner, out_ids = [], []
        while symbols.size:
            key = symbols[look].astype(np.int64) << 20 | symbols[look + 1]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = self.keys[at] == key
            rank[look] = np.where(hit, self.rank[at], _NONE)
            made[look] = self.made[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[first, symbols.size])
            lowest = np.repeat(np.minimum.reduceat(rank, first), length)
            active = lowest != _NONE
            out_owner.append(owner[~active])
            out_ids.append(symbols[~active])
            places = np.flatnonzero(active & (rank == lowest))
            # of a run of touching places (a a a) every other one merges, from the left
            if places.size:
                count = np.arange(places.size)
                begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(places) != 1], count, 0))
                places = places[(count - begin) % 2 == 0]
            symbols[places] = made[places]
            rank[places] = _NONE
            active[places + 1] = False
            new = np.cumsum(active) - 1
            changed = new[places]
            symbols, owner, rank, made = symbols[active], owner[active], rank[active], made[active]
            look = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            rank[look] = _NONE
            look = look[look + 1 < symbols.size]
            look = look[owner[look] == owner[look + 1]]
        own = np.concatenate(out_owner)
        order = np.argsort(own, kind="stable")
        return Ragged(np.concatenate(out_ids)[order], np.r_[0, np.cumsum(np.bincount(own, minlength=n))])

    def tokens(self, s: Slice, ids: bool) -> Ragged:
        """Ids of a slice's documents in order; without `ids` only `first` is filled."""
        data, starts, ends, at, special = self.cut(s)
        h = hashes(data, starts, ends) | np.uint64(1)
        chosen = special >= 0
        h[chosen] = special[chosen].astype(np.uint64) << np.uint64(1)
        slot = (h >> np.uint64(20) & np.uint64(SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.seen[slot] != h)
        count, start = self.count[slot], self.start[slot].astype(np.int64)
        pool = self.pool
        if miss.size:
            _, pick, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[pick]
            new = self.merge(data, starts[pick], ends[pick])
            sizes, made = np.diff(new.first), new.ids
            named = np.flatnonzero(special[pick] >= 0)
            if named.size:
                made = np.insert(made, new.first[named], special[pick[named]].astype(np.int32))
                sizes[named] = 1
            begin = np.cumsum(sizes) - sizes
            if self.pooled + made.size <= POOLED:
                self.pool[self.pooled : self.pooled + made.size] = made
                begin, base = begin + self.pooled, self.pooled
                self.pooled = base + made.size
                where = slot[pick]
                self.seen[where], self.count[where], self.start[where] = h[pick], sizes, begin
                # two new ones in one slot: the last write stands in all three
                count[miss], start[miss] = sizes[back], begin[back]
            else:
                pool = np.concatenate([self.pool[: self.pooled], made])
                count[miss], start[miss] = sizes[back], begin[back] + self.pooled
                self.forget()
        doc = owners(at, s.bounds)
        per = np.bincount(doc, count, minlength=s.n).astype(np.int64) if len(doc) else np.zeros(s.n, np.int64)
        first = np.r_[0, np.cumsum(per)]
        if not ids:
            return Ragged(np.zeros(0, np.int32), first)
        before = np.cumsum(count, dtype=np.int64) - count
        return Ragged(pool[np.repeat(start - before, count) + np.arange(first[-1])], first)


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each input row.

    A null or empty text has 0 bytes and 0 tokens. Ids may be null or repeat: rows are counted
    on their own. Other columns are not read. No shuffle; the plan is one scan and one map.
    """
    vocabulary = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            for s in slices_of(batch.column(1)):
                n = np.diff(m.tokens(s, ids=False).first)
                columns = [batch.column(0).slice(s.first, s.n), pa.array(np.diff(s.bounds)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
