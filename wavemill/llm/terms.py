"""Terms of many texts at once, as Arrow strings with their places.

A term is a maximal run of bytes of one class: letters or letters and digits,
with every byte from 0x80 on, so that all non-ASCII characters belong to terms.
Only A-Z are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textnum import LOWER

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True


@dataclass
class Terms:
    """``values`` in text order with the row and the byte range of each, and the
    number of each row's terms."""

    values: pa.StringArray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray


def strings(offsets: np.ndarray, chars: np.ndarray) -> pa.StringArray:
    """Strings from their offsets and bytes."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(chars)))


def terms(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Terms:
    """The terms of consecutive texts; ``offsets`` may start anywhere in ``data``,
    and byte ranges count from there."""
    buf, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    is_in = inside[buf]
    step = np.zeros(len(buf) + 1, bool)
    step[off] = True  # a text ends its last term
    starts, ends = step[:-1].copy(), step[1:].copy()
    starts[1:] |= ~is_in[:-1]
    ends[:-1] |= ~is_in[1:]
    start, end = np.flatnonzero(is_in & starts), np.flatnonzero(is_in & ends) + 1
    row = np.searchsorted(off, start, "right") - 1
    values = strings(np.concatenate(([0], np.cumsum(end - start))), LOWER[buf[is_in]])
    return Terms(values, row, start, end, np.bincount(row, minlength=len(off) - 1))


def code_points(buf: np.ndarray) -> np.ndarray:
    """At each byte offset, the number of characters that begin before it."""
    return np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
