"""Texts as flat byte arrays: word borders and word hashes for a whole slice of documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text in one slice; a longer text is a slice of its own.
SLICE = 6_000_000
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


@dataclass
class Slice:
    """Documents first .. first + n of a batch: their bytes (eight zero bytes behind) and borders."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    @property
    def body(self) -> np.ndarray:
        return self.data[:-8]


def slices_of(texts: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """A string or binary column in slices of about `limit` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    whole = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        part = np.zeros(bounds[to] - bounds[at] + 8, np.uint8)
        part[:-8] = whole[bounds[at] : bounds[to]]
        yield Slice(at, part, bounds[at : to + 1] - bounds[at])
        at = to


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a document's border ends a run."""
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = bounds[(bounds > 0) & (bounds < inside.size)]
    before, after = np.empty(inside.size, bool), np.empty(inside.size, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    before[edge] = True
    after[edge - 1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _B
    h = (h ^ (h >> _U(27))) * _C
    return h ^ (h >> _U(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes a step; data has eight bytes behind the last run."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = ends - starts
    h = mixed((length.astype(np.uint64) + _A) ^ (view[starts] & _MASK[np.minimum(length, 8)]) * _A)
    more = np.flatnonzero(length > 8)
    done = 8
    while more.size:
        v = view[starts[more] + done] & _MASK[np.minimum(length[more] - done, 8)]
        h[more] = mixed(h[more] * _A + v)
        done += 8
        more = more[length[more] > done]
    return h


def owners(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The document each run is in."""
    return np.searchsorted(bounds, starts, "right") - 1


@dataclass
class Words:
    """The words of a slice: hashes in order, and where each document's words begin."""

    hash: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(s: Slice, lower: bool = False) -> Words:
    """Runs of bytes other than 0x20 and 0x09-0x0D; `lower` turns A-Z into a-z before hashing."""
    starts, ends = runs(~IS_SPACE[s.body], s.bounds)
    data = TO_LOWER[s.data] if lower else s.data
    return Words(hashes(data, starts, ends), np.searchsorted(starts, s.bounds), starts, ends)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within documents, and where each document's begin."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _A + h[k : k + n]
    count = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.r_[0, np.cumsum(count)]
    keep = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    return mixed(out[keep]), begin


class Lookup:
    """Positions of 64-bit keys in a sorted array of distinct ones, -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(24, int(len(keys)).bit_length()))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << _U(64 - self.bits)
        self.begin = np.searchsorted(keys, edges).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return found
        at = self.begin[(h >> _U(64 - self.bits)).astype(np.int64)]
        todo = np.flatnonzero(at < len(self.keys))
        at = at[todo]
        while todo.size:
            key = self.keys[at]
            want = h[todo]
            hit = key == want
            found[todo[hit]] = at[hit]
            on = key < want
            todo, at = todo[on], at[on] + 1
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
        return found
