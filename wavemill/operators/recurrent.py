"""Recurrent frame scores for many sources at once.

A cell's state follows a source from frame to frame, so a source's frames are
sequential; sources are not. Frames are sorted by stretch of time first and by
source second: a batch holds a stretch of many sources, which make one step
together, and the states stay with the worker from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.clock import div

#: Frames of a stretch of time.
STRETCH = 64


@dataclass(frozen=True)
class Cell:
    """h' = tanh(W h + U x + b) and a score 1 / (1 + exp(-(v h' + c)))."""

    w: tuple[tuple[float, ...], ...]
    u: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    v: tuple[float, ...]
    c: float

    def start(self, n: int) -> np.ndarray:
        return np.zeros((n, len(self.b)))

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[source, state] and [source, input] to the next states and the scores."""
        h = np.tanh(h @ np.array(self.w).T + x @ np.array(self.u).T + np.array(self.b))
        return h, 1 / (1 + np.exp(-(h @ np.array(self.v) + self.c)))


#: A small cell of fixed weights.
FIXED = Cell(((0.6, -0.3), (0.2, 0.5)), ((2.0,), (1.0,)), (-0.4, 0.1), (3.0, -1.0), 0.2)


def score(frames: DataFrame, cell: Cell = FIXED, by: str = "source_id", inputs: str = "x") -> DataFrame:
    """``frames(by, i, inputs)`` -> ``(by, i, prob)``; ``inputs`` is a number or an array of
    them. Frames of a source go by i; a null input leaves the state alone and gives
    a null score. A worker keeps one state for each of its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}
        state = cell.start(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(3).dictionary_encode(null_encoding="encode")
            new = [k for k in known.dictionary.to_pylist() if k not in place]
            place.update({k: len(place) + j for j, k in enumerate(new)})
            state = np.concatenate((state, cell.start(len(new))))
            source = np.array([place[k] for k in known.dictionary.to_pylist()])[known.indices.to_numpy()]
            x, valid = batch.column(2), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            if pa.types.is_list(x.type):
                values = np.zeros((len(x), len(cell.u[0])))
                values[valid] = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cell.u[0]))
            else:
                values = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            rows = np.flatnonzero(valid)
            by_source = np.argsort(source[rows], kind="stable")
            sorted_ = source[rows][by_source]
            begin = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(rows) else np.zeros(0, np.int64)
            turn = np.empty(len(rows), np.int64)
            turn[by_source] = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
            out = np.full(batch.num_rows, np.nan)
            order = np.argsort(turn, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1) if len(order) else ():
                at = rows[some]  # the next frame of each source in this batch
                state[source[at]], out[at] = cell.step(state[source[at]], values[at])
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), pa.array(out, mask=~valid)], [by, "i", "prob"])

    kind = frames.schema[by].dataType.simpleString()
    x = frames.select(div(F.col("i"), STRETCH).alias("__t"), F.col("i").cast("long").alias("i"), inputs, by)
    return x.repartition(by).sortWithinPartitions("__t", by, "i").mapInArrow(run, f"`{by}` {kind}, i long, prob double")
