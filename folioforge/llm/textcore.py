"""Vectorised text primitives over Arrow string columns.

A batch of texts is treated as one run of UTF-8 bytes, so that finding words,
hashing them and combining hashes are a few numpy passes whatever the number
of rows.  Words are maximal runs without the bytes 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for 0..n."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n, BLOCK_BYTES) + 1
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if n > 4 * BLOCK_BYTES:  # a giant text: don't keep tables of its length
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


@dataclass
class Block:
    """Some consecutive texts of a batch: rows first..last-1 as one byte run."""

    first: int
    last: int
    data: np.ndarray  #: uint8
    offsets: np.ndarray  #: int64, one more than rows

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the index of each row's first word (one more than rows)."""
        inside = ~_SPACE[self.data]
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        forward, back = _power_tables(len(self.data))
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * forward[: len(self.data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``size`` bytes at row ends."""
    texts = string_array(column)
    n = len(texts)
    if not n:
        return
    _, ends, raw = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        if lower:  # a block at a time: no copy of the whole batch
            (part,) = blocks(pc.utf8_lower(texts.slice(first, last - first)), size=1 << 62)
            yield Block(first, last, part.data, part.offsets)
        else:
            yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    if size == BLOCK_BYTES:
        pa.default_memory_pool().release_unused()


def shingles(words: np.ndarray, row_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words, and the index of each row's first shingle (one more than rows).

    A row with fewer than ``k`` words, but some, has one shingle: all its words.
    """
    counts = np.diff(row_words)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row_first = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(rows)) - row_first[rows] + row_words[rows]
    limit = row_words[rows + 1]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        step = padded[at + i]
        if len(counts) and counts.min() < k:
            step = np.where(at + i < limit, step, np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + step
    return mix(out), row_first
