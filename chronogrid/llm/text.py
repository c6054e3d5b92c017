"""Vectorised tokenising and hashing of Arrow string columns.

Texts stay in their Arrow buffers: a slice of documents is one byte array, and words, word hashes, n-gram
and window hashes are numpy arrays over all documents of the slice.  A slice holds about SLICE_BYTES, or
one document where that is longer, so memory is bounded by the longest single text.

A word is a run of bytes outside 0x20 and 0x09-0x0D; every other byte, multi-byte characters included,
belongs to words.  Hashes are 64-bit polynomials over random byte values and depend on content only, so
all executors agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(4096, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the entropy over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Some consecutive documents of a batch: rows lo..hi, their bytes and their words."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash for each word, or for its first `prefix` bytes."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lengths = self.ends - self.starts
        if prefix is not None:
            lengths = np.minimum(lengths, prefix)
        begin = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=begin[1:])
        total = int(begin[-1] + lengths[-1])
        at = np.arange(total) - np.repeat(begin, lengths)
        letters = self.data[~_SPACE[self.data]] if prefix is None else self.data[at + np.repeat(self.starts, lengths)]
        value = _BYTE[letters]
        value *= powers(_BASE, int(lengths.max()))[at]
        return mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self, doc: int) -> list[bytes]:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes().split()


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)), offsets


def cut(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Slice:
    own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    n = len(own)
    space = _SPACE[own]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return Slice(lo, hi, own, off, starts, ends, np.searchsorted(starts, off))


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's documents in order, in slices of about `size` bytes."""
    data, offsets = column(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield cut(data, offsets, lo, hi)
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEPT = np.ones(256, bool)
_KEPT[[x for x in range(33, 127) if not chr(x).isalnum()]] = False


def normalised_slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """As slices(), of the texts with A-Z lower-cased and ASCII punctuation taken out."""
    data, offsets = column(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        own = data[offsets[lo] : offsets[hi]]
        kept = _KEPT[own]
        total = np.zeros(len(own) + 1, np.int64)
        np.cumsum(kept, out=total[1:])
        s = cut(_LOWER[own[kept]], total[offsets[lo : hi + 1] - offsets[lo]], 0, hi - lo)
        s.lo, s.hi = lo, hi
        yield s
        lo = hi


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k elements from each position on; n - k + 1 of them, or none."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n - k + 1))


def window_docs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k elements of one document start, and their documents."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(doc)) - np.repeat(begin, counts) + first[:-1][doc], doc


def occurrence_labels(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones precede it in its document."""
    n = len(h)
    order = np.lexsort((h, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.arange(n)
    label = np.empty(n, np.int64)
    label[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return label
