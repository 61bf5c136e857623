"""Vectorised text kernel: words and their 64-bit digests straight from Arrow buffers.

A batch's UTF-8 bytes are one numpy array; no Python string is made per word. A
word is a maximal run of bytes other than the six ASCII white-space bytes, which
in UTF-8 never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint64)
LOWER = SAME.copy()
LOWER[65:91] += np.uint64(32)

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _powers
    if base != _BASE:
        out = np.full(n, base, dtype=np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if large else np.int32, count=len(column) + 1, offset=column.offset * (8 if large else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): whole rows, of about `limit` bytes together unless one row alone has more."""
    data, offsets = column_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a chunk: starts and ends in its bytes, and first[d]..first[d+1] are document d's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        edges = offsets[1:-1]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[edges[edges < len(inside)]] = False
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def digests(self, fold: np.ndarray = SAME) -> np.ndarray:
        """A 64-bit digest of each word: a polynomial in its bytes, with its length, mixed."""
        if not len(self):
            return np.empty(0, np.uint64)
        lengths = self.ends - self.starts
        body = self.data[self._inside]
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(body), dtype=np.int32) - np.repeat(begin.astype(np.int32), lengths)
        terms = (fold[body] + U(1)) * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, begin) ^ (lengths.astype(np.uint64) << U(48)))


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Digest of every k consecutive words, by first word (the caller masks those that cross documents)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    base = U(mix_int(salt + 77) | 1)
    if k <= 12:
        p = powers(k, base)
        out = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * p[i]
        return mix(out)
    # prefix sums of h[i] * base**i; a window is a difference, moved back to power 0
    p = powers(len(h) + 1, base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:-1], dtype=np.uint64)])
    inverse = powers(len(h) - k + 1, U(pow(int(base), -1, 2**64)))
    return mix((sums[k:] - sums[:-k]) * inverse)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
