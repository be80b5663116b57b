"""Hashes in blocks by their leading bits: few large rows instead of many small ones, and bitmaps of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: 64 Mbit: 8 MB.
BITMAP_BITS = 1 << 26


def block_bits(docs: DataFrame) -> int:
    """As many blocks as keep one of them small: four to eight for each partition of the input."""
    return min(20, max(4, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))


def in_blocks(keys: np.ndarray, bits: int, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    block = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, values = block[order], values[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(block)]]), strict=True):
        if b > a:
            yield int(block[a]), values[a:b].tobytes()


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """From batches sorted by their first column: each key with its blobs."""
    key, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if blobs:
                    yield key, blobs
                key, blobs = k, []
            blobs.append(blob)
    if blobs:
        yield key, blobs


def records(names: list[str], rows: Iterator[tuple], types: list[pa.DataType], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def flags(inner: np.ndarray, bits: int, each: int = 0) -> bytes:
    """A block's segment of the bitmap, with the bits of 32-bit inner hashes set; it has ``each`` bits a hash at least."""
    width = max(8, BITMAP_BITS >> bits, -(-each * len(inner) // 8) * 8)
    out = np.zeros(width, np.uint8)
    out[((inner.astype(np.uint64) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def inner_hash(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits that follow the block's."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


class Bits:
    """A bitmap over hashes. A bit may be set for another hash's sake, so a full one lets all pass and stays right."""

    def __init__(self, bits: int, segments: dict[int, bytes]) -> None:
        self.bits, self.width = bits, max(8, BITMAP_BITS >> bits)
        empty = bytes(self.width // 8)
        self.map = np.frombuffer(b"".join(segments.get(i, empty) for i in range(1 << bits)), np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        block = hashes >> np.uint64(64 - self.bits)
        at = (block * np.uint64(self.width) + ((inner_hash(hashes, self.bits).astype(np.uint64) * np.uint64(self.width)) >> np.uint64(32))).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Pieces:
    """Segments of some blocks that follow each other, each as wide as it is; blocks without one let nothing pass."""

    def __init__(self, bits: int, segments: dict[int, bytes]) -> None:
        self.bits, self.first, self.last = bits, min(segments), max(segments)
        parts = [segments.get(i, bytes(1)) for i in range(self.first, self.last + 1)]
        self.width = np.array([8 * len(x) for x in parts], np.uint64)
        self.start = np.cumsum(self.width) - self.width
        self.map = np.frombuffer(b"".join(parts), np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes must lie in the blocks from first to last."""
        block = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) - self.first
        at = (self.start[block] + ((inner_hash(hashes, self.bits).astype(np.uint64) * self.width[block]) >> np.uint64(32))).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
