"""Words, hashes and shingles of many texts at once, with numpy on the UTF-8
bytes of an Arrow string column.

A word is a run of bytes outside 0x20 and 0x09-0x0D, so all work stays on bytes
and non-ASCII letters pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows and bytes handled at a time; rows must fit the 12 bits of a shingle key.
SLICE_ROWS, SLICE_BYTES = 4096, 2 << 20
ROW_SHIFT = np.uint64(52)
VALUE_MASK = np.uint64((1 << 52) - 1)

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """``LOWER[buf]``, without a lookup."""
    return buf + (((buf - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def word_bytes(buf: np.ndarray) -> np.ndarray:
    """``IS_WORD[buf]``, without a lookup."""
    return (buf != 32) & ((buf - np.uint8(9)) > 4)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    counts: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        lens = self.end - self.start
        if not len(lens):
            return np.zeros(0, np.uint64)
        chars = self.buf[word_bytes(self.buf)]
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(len(chars)) - np.repeat(first, lens)
        value = _BYTE[chars] * _PLACE[place & 4095]
        if len(lens) and lens.max() > 4096:
            value *= (2 * (place >> 12) + 1).astype(np.uint64)
        return mix64(np.add.reduceat(value, first) + lens.astype(np.uint64))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, max_rows: int = SLICE_ROWS, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """The words of consecutive texts; ``offsets`` may start anywhere in ``data``."""
    buf = data[offsets[0] : offsets[-1]]
    buf = lowered(buf) if lower else buf
    off = offsets - offsets[0]
    inside = word_bytes(buf)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(buf):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(start, off))
    return Words(buf, off, start, end, np.repeat(np.arange(len(counts)), counts), counts)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 52-bit value) of each row's distinct n-word shingles, sorted by
    both. A row of 1 to n-1 words has its whole sequence as one shingle."""
    h = w.hashes()
    total = len(h)
    rows, values = [], []
    if total >= n:
        same = w.row[: total - n + 1] == w.row[n - 1 :]
        acc = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            acc += h[j : total - n + 1 + j] * _GRAM[j]
        rows.append(w.row[: total - n + 1][same])
        values.append(mix64(acc[same]))
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        first = np.searchsorted(w.row, short)
        acc = w.counts[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(n - 1):
            has = w.counts[short] > j
            acc[has] += h[first[has] + j] * _GRAM[j]
        rows.append(short)
        values.append(mix64(acc))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = (np.concatenate(rows).astype(np.uint64) << ROW_SHIFT) | (np.concatenate(values) >> np.uint64(12))
    key.sort()
    if len(key) > 1:
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> ROW_SHIFT).astype(np.int64), key & VALUE_MASK
