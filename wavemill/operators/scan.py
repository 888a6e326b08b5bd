"""Sequential walks over sorted rows, without one task for a key.

Rows are dealt by ranges of key and order, so that a large key takes its share of
tasks only. The rows of a key in one Arrow batch are a piece. For a piece the
walk is made from every state that may enter it, as a function that composes:
a clamp, or a table of entries and exits. The pieces' functions, one small row
each, are then composed in order to give every piece its state of entry, which
joins back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavemill.store import cut

#: A state that no row follows.
DEAD = -1


def numbered(run: Callable[[pa.RecordBatch, int], Iterator[pa.RecordBatch]]):
    """``run(batch, base)`` for ``mapInArrow`` with a number for each batch of the job,
    which rises in the order of rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(b for b in batches if b.num_rows):
            yield from run(batch, part << 32 | i)

    return each


def pieces(rows: DataFrame, by: str, order: list[str], run, added: str) -> DataFrame:
    """``rows`` in order through ``run``, written once: its piece numbers depend on the
    ranges drawn, which a second run might draw anew."""
    schema = T.StructType(rows.schema.fields + T._parse_datatype_string(added).fields)
    return cut(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).mapInArrow(numbered(run), schema))


def starts(key: pa.Array) -> np.ndarray:
    """Where a new key begins in a sorted column."""
    codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


def entered(functions: DataFrame, by: str, first: int, step: Callable[[int, tuple], tuple[int | None, int]]) -> DataFrame:
    """(by, piece, entry) of ``functions(by, piece, ...)``, one row a piece: ``step(state,
    row)`` gives what enters the piece and the state after it. Rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), first
        for b in batches:
            out = []
            for key, _, *own in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    now, state = key, first
                entry, state = step(state, own)
                out.append(entry)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], [by, "piece", "entry"])

    kind = functions.schema[by].dataType.simpleString()
    return functions.repartition(by).sortWithinPartitions(by, "piece").mapInArrow(run, f"`{by}` {kind}, piece long, entry long")


def clamp_prefixes(step: np.ndarray, begin: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the composition (shift, lo, hi) of its piece's walk up to it, a state
    s becoming min(hi, max(lo, s + shift)); rows of one piece start at ``begin``."""
    n = len(step)
    piece = np.zeros(n, np.int64)
    piece[begin] = 1
    piece = np.cumsum(piece)
    shift, lo, hi = step.astype(np.int64), np.full(n, low), np.full(n, high)
    d = 1
    while d < n:
        i = d + np.flatnonzero(piece[d:] == piece[:-d])
        if not len(i):
            break
        j = i - d
        lo_, hi_ = np.clip(lo[j] + shift[i], lo[i], hi[i]), np.clip(hi[j] + shift[i], lo[i], hi[i])
        shift_ = shift[j] + shift[i]
        shift[i], lo[i], hi[i] = shift_, lo_, hi_
        d *= 2
    return shift, lo, hi


def jumps(begin: np.ndarray, frame: np.ndarray, step: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks that go from a frame to ``frame + step`` in pieces of rising frames.

    Returns a bit mask for each row, of the entries o from 0 to longest - 1 from
    which a walk that enters at its piece's first frame + o comes by, and for
    each piece and entry the frame at which it goes on, or DEAD where a frame is
    missing. Paths are followed by doubling.
    """
    n = len(frame)
    own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    last = frame[np.append(begin[1:], n) - 1]
    wide = int(frame.max()) + longest + 2
    places = own * wide + frame

    def at(piece: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The row of a frame in a piece, or n."""
        found = np.searchsorted(places, piece * wide + target)
        return np.where((found < n) & (places[np.minimum(found, n - 1)] == piece * wide + target), found, n)

    target = frame + step
    follow = np.append(at(own, target), n)
    leaves = np.where(target > last[own], target, DEAD)
    rounds = int(np.diff(np.append(begin, n)).max()).bit_length()
    final = np.where(follow < n, follow, np.arange(n + 1))
    for _ in range(rounds):
        final = final[final]
    mask, exits = np.zeros(n, np.int64), np.zeros((len(begin), longest), np.int64)
    for o in range(longest):
        entry = at(np.arange(len(begin)), frame[begin] + o)
        seen, jump = np.zeros(n + 1, bool), follow
        seen[entry] = True
        for _ in range(rounds):
            seen[jump[np.flatnonzero(seen)]] = True
            jump = jump[jump]
        mask |= seen[:n].astype(np.int64) << o
        exits[:, o] = np.where(entry < n, leaves[np.minimum(final[entry], n - 1)], np.where(frame[begin] + o > last, frame[begin] + o, DEAD))
    return mask, exits
