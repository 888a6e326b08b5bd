"""WAV files as PCM chunk rows, read by Spark's binary file source."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wavemill.schema import SAMPLE_RATE

#: Samples of a chunk: 100 ms.
CHUNK = 1_600
WAV_SCHEMA = "path string, seq long, n_samples long, samples array<float>, error string"


@dataclass(frozen=True)
class Header:
    """What a file holds: samples of ``bits`` each (kind 1 whole numbers, 3 floats), from
    byte ``start`` on, ``size`` bytes in all."""

    kind: int
    bits: int
    start: int
    size: int

    @property
    def frames(self) -> int:
        return self.size // (self.bits // 8)


def header(file: BinaryIO, length: int) -> Header:
    """Walks the file's chunks, reading nothing but their heads; ValueError says what is
    not supported. A data chunk that claims more than the file holds ends with it."""
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(size, 40))
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            fmt = (struct.unpack("<H", body[24:26])[0] if kind == 0xFFFE else kind, channels, rate, bits)
        elif name == b"data":
            break
        at += 8 + size + (size & 1)
    else:
        raise ValueError("no data chunk")
    if fmt is None:
        raise ValueError("no format chunk")
    kind, channels, rate, bits = fmt
    if channels != 1:
        raise ValueError(f"expected mono, found {channels} channels")
    if rate != SAMPLE_RATE:
        raise ValueError(f"expected {SAMPLE_RATE} Hz, found {rate}")
    if (kind, bits) not in ((3, 32), (1, 8), (1, 16), (1, 24), (1, 32)):
        raise ValueError(f"unsupported sample format {kind} of {bits} bits")
    return Header(kind, bits, at + 8, min(size, length - at - 8))


def samples_of(body: bytes, kind: int, bits: int) -> np.ndarray:
    """Whole samples of a stretch of data as float32."""
    width = bits // 8
    body = body[: len(body) // width * width]
    if kind == 3:
        return np.frombuffer(body, "<f4").astype(np.float32)
    if bits == 8:  # the only unsigned width
        whole = np.frombuffer(body, np.uint8).astype(np.int64) - 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        whole = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        whole = np.where(whole >= 1 << 23, whole - (1 << 24), whole)
    else:
        whole = np.frombuffer(body, f"<i{width}").astype(np.int64)
    return (whole / float(1 << (bits - 1))).astype(np.float32)


def decode(data: bytes) -> np.ndarray:
    """A whole file's mono 16 kHz samples as float32."""
    h = header(BytesIO(data), len(data))
    return samples_of(data[h.start : h.start + h.size], h.kind, h.bits)


def read_wav(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Files under ``path`` in chunks of ``chunk`` samples, the last shorter; a file
    that cannot be read gives one row with its error. For stores that only Spark
    can open: a file is one task's memory. ``wav_pcm`` of wav_source.py splits files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    x, error = decode(data), None
                except (ValueError, struct.error) as e:
                    x, error = np.zeros(0, np.float32), str(e)
                for lo in range(0, max(len(x), 1 if error else 0), chunk * 64):
                    parts = [x[i : i + chunk] for i in range(lo, min(lo + chunk * 64, len(x)), chunk)] or [x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(parts)), pa.array([lo // chunk + i for i in range(len(parts))], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.float32())), pa.array([error] * len(parts), pa.string())],
                        ["path", "seq", "n_samples", "samples", "error"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, WAV_SCHEMA)
