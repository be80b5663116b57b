"""Vectorised word tables over the UTF-8 buffers of Arrow string columns.

A *word class* is a table of 256 flags: the bytes that belong to words. All classes used here keep bytes of
0x80 and more, so that a code point is never cut. Words never span two rows.

Memory: :func:`groups` hands out rows in groups of about ``GROUP_BYTES`` of text, so a task holds some 30 bytes
for each byte of one group, or of the longest single text when that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 2 << 20
_STEP = 1 << 18

_rng = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fold() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = _fold()

#: Everything except the space and 0x09 to 0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Digits, letters and all that is not ASCII, for text in which A-Z count as a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, _STEP + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


@dataclass
class Group:
    """Rows ``lo`` to ``hi`` of a batch. ``ptr[i]:ptr[i+1]`` are the words of row lo + i; starts and ends are byte offsets into data."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in a class, cut at row offsets."""
    flags = inside[data].astype(np.int8)
    before = np.empty_like(flags)
    before[:1] = 0
    before[1:] = flags[:-1]
    after = np.empty_like(flags)
    after[-1:] = 0
    after[:-1] = flags[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = 0
    after[cuts - 1] = 0
    return np.flatnonzero(flags > before), np.flatnonzero(flags > after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    code = _BYTE_CODE if fold is None else _BYTE_CODE[fold]
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _STEP, "right")))
        n = int(ends[j - 1] - lo)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code[data[lo : lo + n]] * up[:n], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def groups(column: pa.Array, inside: np.ndarray, fold: np.ndarray | None = None, size: int = GROUP_BYTES) -> Iterator[Group]:
    """The rows of a string column with their words, in groups of about ``size`` bytes."""
    data, at = utf8(column)
    lo, rows = 0, len(column)
    while lo < rows:
        hi = max(lo + 1, min(rows, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        part, offsets = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends = spans(part, offsets, inside)
        yield Group(lo, hi, part, offsets, starts, ends, span_hashes(part, starts, ends, fold), np.searchsorted(starts, offsets))
        lo = hi


_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of the k words from each position on, for positions that have k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        total = words[:n] * _GRAM[salt]
        for j in range(1, k):
            total += words[j : j + n] * _GRAM[(salt + j) % 64]
        return mix(total)
    out = np.empty(n, np.uint64)
    source = mix(words + _GRAM[salt]) if salt else words
    for lo in range(0, n, _STEP):
        hi = min(n, lo + _STEP)
        up, down = powers(hi - lo + k)
        sums = np.zeros(hi - lo + k, np.uint64)
        np.cumsum(source[lo : hi + k - 1] * up[: hi - lo + k - 1], out=sums[1:])
        out[lo:hi] = (sums[k:] - sums[: hi - lo]) * down[: hi - lo]
    return mix(out)


def row_grams(words: np.ndarray, ptr: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words within one row, and the position of each among all words."""
    every = gram_hashes(words, k, salt)
    if not len(every):
        return every, np.zeros(0, np.int64)
    end = np.repeat(ptr[1:], np.diff(ptr))[: len(every)]
    at = np.flatnonzero(np.arange(len(every)) + k <= end)
    return every[at], at
