"""WAV files as a Spark data source: byte ranges of one file are read apart, by tasks
of their own or several by one, batch and streaming; and a writer.

    spark.dataSource.register(WavSource)
    spark.read.format("wav_pcm").option("split", 1 << 20).load(folder)

Files are opened with pyarrow's file systems, by path or URI.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wavemill.schema import SAMPLE_RATE
from wavemill.sources.wav import CHUNK, Header, header, samples_of

#: Samples of a split unless the ``split`` option says else.
SPLIT = 1 << 22
#: Tasks that smaller splits are dealt to, as long as none has more than ``SPLIT`` samples.
TASKS = 64


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Range:
    """Samples ``first`` to ``last`` of a file, or the reason why it has none."""

    path: str
    form: Header | None
    first: int = 0
    last: int = 0
    error: str | None = None


class Splits(InputPartition):
    """Splits that one task reads, one after another."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class _Ranges:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.split = max(1, int(options.get("split", SPLIT)) // self.chunk) * self.chunk

    def files(self) -> list[tuple[int, str]]:
        """(modification time, name) of the files under the path, in this order."""
        store, root = opened(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.path.lower().endswith(".wav"))

    def dealt(self, ranges: list[Range]) -> list[Splits]:
        """Neighbouring splits by tasks: a task for each of them costs more than they
        hold where they are small and many."""
        sizes = [max(r.last - r.first, self.chunk) for r in ranges]
        most = min(SPLIT, -(-sum(sizes) // TASKS)) if len(ranges) > TASKS else 0
        out, held = [], most
        for r, size in zip(ranges, sizes):
            if held >= most:
                out.append(Splits([]))
                held = 0
            out[-1].ranges.append(r)
            held += size
        return out

    def ranges(self, names: list[str]) -> list[Range]:
        """Splits of whole chunks; heads are read here, samples are not."""
        store, _ = opened(self.path)
        out = []
        for name in names:
            try:
                with store.open_input_file(name) as f:
                    form = header(f, f.size())
            except (ValueError, struct.error) as e:
                out.append(Range(name, None, error=str(e)))
                continue
            out += [Range(name, form, lo, min(lo + self.split, form.frames)) for lo in range(0, form.frames, self.split)]
        return out

    def read(self, task: Splits) -> Iterator[pa.RecordBatch]:
        for part in task.ranges:
            yield from self.rows(part)

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["path", "seq", "n_samples", "samples", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.string()]
        if part.form is None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part.path, 0, 0, [], part.error), kinds)], names)
            return
        store, _ = opened(self.path)
        width, step = part.form.bits // 8, self.chunk * 64
        with store.open_input_file(part.path) as f:
            for lo in range(part.first, part.last, step):
                n = min(step, part.last - lo)
                x = samples_of(f.read_at(n * width, part.form.start + lo * width), part.form.kind, part.form.bits)
                ends = np.append(np.arange(0, n, self.chunk), n)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
                rows = len(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * rows), pa.array(lo // self.chunk + np.arange(rows)), pa.array(np.diff(ends)), lists, pa.nulls(rows, pa.string())], names)


class WavReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Splits]:
        return self.dealt(self.ranges([name for _, name in self.files()]) or [Range(self.path, Header(1, 8, 0, 0))])


class WavStreamReader(_Ranges, DataSourceStreamReader):
    """Offsets are the modification time and name of the last file taken, so a file
    is read once however often the stream restarts; files must be moved in whole."""

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Splits]:
        after, upto = ((o["time"], o["name"]) for o in (start, end))
        return self.dealt(self.ranges([name for time, name in self.files() if after < (time, name) <= upto]))


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_pcm"

    def schema(self) -> str:
        return "path string, seq long, n_samples long, samples array<float>, error string"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def streamReader(self, schema) -> WavStreamReader:
        return WavStreamReader(self.options)


def write_wav(chunks: DataFrame, folder: str, by: str = "source_id", order: str = "seq", rows: int = 1 << 16) -> DataFrame:
    """Writes ``chunks(by, order, samples)`` as 16-bit mono WAV files ``<by>-<part>.wav``, a
    part being the chunks of ``order`` div ``rows``, so that a long source is many
    files. Returns (by, part, file, n_samples), one row a file, when read; samples
    stream by. A file is written under another name and moved, so a task that
    runs twice leaves one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        now, out, n, temporary = None, None, 0, ""

        def closed() -> pa.RecordBatch:
            name = f"{root}/{now[0]}-{now[1]}.wav"
            out.close()
            _sized(store, temporary, name, n)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (now[0], now[1], name, n)], [by, "part", "file", "n_samples"])

        for batch in batches:
            for key, part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (key, part) != now:
                    if now is not None:
                        yield closed()
                    now, n, temporary = (key, part), 0, f"{root}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                if x.is_valid:
                    values = np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * 32768 + 0.5)
                    out.write(np.clip(values, -32768, 32767).astype("<i2").tobytes())
                    n += len(values)
        if now is not None:
            yield closed()

    kind = chunks.schema[by].dataType.simpleString()
    x = chunks.where(F.col(by).isNotNull()).select(by, F.expr(f"CAST(`{order}` AS BIGINT) div {rows}").alias("part"), order, "samples")
    x = x.repartition(by, "part").sortWithinPartitions(by, "part", order).select(by, "part", "samples")
    return x.mapInArrow(run, f"`{by}` {kind}, part long, file string, n_samples long")


def _sized(store: fs.FileSystem, body: str, name: str, n: int) -> None:
    """The file of a body whose length is known by now."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, 2 * SAMPLE_RATE, 2, 16, b"data", 2 * n)
    whole = f"{body}.whole"
    with store.open_input_stream(body) as source, store.open_output_stream(whole) as out:
        out.write(head)
        while block := source.read(1 << 20):
            out.write(block)
    store.delete_file(body)
    store.move(whole, name)
