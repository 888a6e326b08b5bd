"""A source's samples in chunks, as they came, over a keyed store.

Chunks are written once and dropped whole when all their samples are behind what
is still needed; a chunk that comes and goes between two commits is never
written. So what a trigger writes grows with its new audio only, however long
the open segment is.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np


class RangeError(ValueError):
    """Samples outside the buffer, or an empty range, were asked for."""

    code = "vad"


class ChunkStore(Protocol):
    def get(self, start: int) -> np.ndarray: ...

    def put(self, start: int, samples: np.ndarray) -> None: ...

    def remove(self, start: int) -> None: ...


class Buffer:
    """Samples from place ``base`` to ``end``; stored chunks begin at ``first``, at or before
    ``base``. Chunks follow each other, so each is found from the one before."""

    def __init__(self, base: int = 0, end: int = 0, first: int = 0, store: ChunkStore | None = None):
        self.base, self.end, self.first, self.store = base, end, first, store
        self.fresh: dict[int, np.ndarray] = {}
        self.read: dict[int, np.ndarray] = {}
        self.gone: list[int] = []

    def __len__(self) -> int:
        return self.end - self.base

    def append(self, start: int, samples: np.ndarray) -> None:
        """Adds samples at the end; ``start`` counts only if the buffer is empty."""
        if not len(self):
            self.trim(self.end)
            self.base = self.end = self.first = start
        if len(samples):
            self.fresh[self.end] = np.asarray(samples, np.float32)
            self.end += len(samples)

    def _chunk(self, start: int) -> np.ndarray:
        if start in self.fresh:
            return self.fresh[start]
        if start not in self.read:
            self.read[start] = self.store.get(start)
        return self.read[start]

    def take(self, start: int, end: int) -> np.ndarray:
        """The samples of a range, which must lie in the buffer and hold some; all
        before ``end`` is dropped."""
        if not self.base <= start < end <= self.end:
            raise RangeError(f"samples {start} to {end} of a buffer from {self.base} to {self.end}")
        parts, at = [], self.first
        while at < end:
            chunk = self._chunk(at)
            parts.append(chunk[max(start - at, 0) : end - at])
            at += len(chunk)
        self.trim(end)
        return np.concatenate(parts)

    def trim(self, keep: int) -> None:
        """Forgets what lies before ``keep``."""
        self.base = min(max(keep, self.base), self.end)
        while self.first < self.base:
            chunk = self._chunk(self.first)
            if self.first + len(chunk) > self.base:
                break
            if self.fresh.pop(self.first, None) is None:
                self.gone.append(self.first)
            self.first += len(chunk)

    def commit(self) -> None:
        """Brings the store up to date with the buffer."""
        for start in self.gone:
            self.store.remove(start)
        for start, samples in self.fresh.items():
            self.store.put(start, samples)
        self.read |= self.fresh
        self.fresh, self.gone = {}, []
