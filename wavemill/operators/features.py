"""Spectral features: framed power spectra, mel projection, log and normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions import pcm
from wavemill.operators.blocks import halo_blocks
from wavemill.store import cut

LOG_FLOOR, NORM_EPS = 2.0**-24, 1e-5


def preemphasise(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32).copy()
    y[1:] -= np.float32(pcm.EMPHASIS) * x[:-1].astype(np.float32)
    return y


def hann(n: int = pcm.WINDOW) -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))).astype(np.float32) if n > 1 else np.ones(n, np.float32)


def power_frames(x: np.ndarray, n_fft: int = pcm.N_FFT, hop: int = pcm.HOP, window: np.ndarray | None = None) -> np.ndarray:
    """[bin, frame] power; the signal is padded by half a frame of zeros and the
    window stands in the middle of the frame."""
    window = hann() if window is None else window.astype(np.float32)
    padded = np.pad(x.astype(np.float32), n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][: len(x) // hop + 1]
    shaped = np.zeros(n_fft, np.float32)
    at = (n_fft - len(window)) // 2
    shaped[at : at + len(window)] = window
    spectrum = np.fft.rfft(frames * shaped, axis=1)
    return (spectrum.real**2 + spectrum.imag**2).T.astype(np.float32)


@lru_cache(maxsize=8)
def mel_basis(n_mels: int, n_fft: int = pcm.N_FFT, rate: int = 16_000, exact: bool = False) -> np.ndarray:
    """Triangles of equal area on the Slaney scale, from 0 to half the rate."""
    step = 0.06875177742094912

    def to_hz(m: np.ndarray) -> np.ndarray:
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))

    top = 15 + np.log(rate / 2 / 1000) / step if rate / 2 >= 1000 else rate / 2 * 3 / 200
    points = to_hz(np.linspace(0, top, n_mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins[None] - points[:-2, None]) / np.diff(points)[:-1, None]
    fall = (points[2:, None] - bins[None]) / np.diff(points)[1:, None]
    return (np.maximum(0, np.minimum(rise, fall)) * (2 / (points[2:] - points[:-2]))[:, None]).astype(np.float64 if exact else np.float32)


def normalise_rows(x: np.ndarray, valid: int) -> np.ndarray:
    """Each row over its first ``valid`` frames: mean 0, deviation (n - 1) 1; zeros after."""
    if valid > x.shape[1]:
        raise ValueError(f"{valid} valid frames of {x.shape[1]}")
    out = np.zeros_like(x, dtype=np.float32)
    if valid:
        part = x[:, :valid].astype(np.float32)
        spread = part.std(1, ddof=1, keepdims=True) if valid > 1 else np.zeros((len(x), 1), np.float32)
        out[:, :valid] = (part - part.mean(1, keepdims=True)) / (spread + np.float32(NORM_EPS))
    return out


def log_mel(x: np.ndarray, n_mels: int = 80) -> np.ndarray:
    """[mel, frame] features of one utterance."""
    mel = mel_basis(n_mels) @ power_frames(preemphasise(x))
    return normalise_rows(np.log(mel + np.float32(LOG_FLOOR)), len(x) // pcm.HOP)


def power_spectrum(rows: DataFrame, key: str, samples: str) -> DataFrame:
    """``(key, bin, power)`` of each row's samples as one frame, by Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):  # rows of one length at a time
                at = np.flatnonzero(sizes == size)
                x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
                s = np.fft.rfft(x, axis=1)
                p = s.real**2 + s.imag**2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[at], p.shape[1])), pa.array(np.tile(np.arange(p.shape[1]), len(at))), pa.array(p.ravel())], ["key", "bin", "power"])

    return rows.select(F.col(key).cast("long"), samples).mapInArrow(run, "key long, bin long, power double").withColumnRenamed("key", key)


def framed_log_mel(rows: DataFrame, key: str, samples: str, n_mels: int = 80, n_fft: int = pcm.N_FFT, hop: int = pcm.HOP, window: int = pcm.WINDOW) -> DataFrame:
    """``(key, frame, mel, feature)``: log-mel features of each row's samples as one
    utterance, in double precision. Rows are pre-emphasised, padded by half a frame,
    cut into windowed frames every ``hop`` samples, projected and normalised over the
    valid frames; the tail is 0. A null or empty row has one frame of zeros."""
    basis, shape = mel_basis(n_mels, n_fft, exact=True), np.zeros(n_fft)
    at = (n_fft - window) // 2
    shape[at : at + window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / (window - 1))

    def features_of(x: np.ndarray) -> np.ndarray:
        y = x.copy()
        y[1:] -= pcm.EMPHASIS * x[:-1]
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(y, n_fft // 2), n_fft)[::hop][: len(x) // hop + 1]
        power = np.abs(np.fft.rfft(frames * shape, axis=1)) ** 2
        logs, valid = np.log(power @ basis.T + LOG_FLOOR), len(x) // hop
        out = np.zeros_like(logs)
        if valid:
            spread = logs[:valid].std(0, ddof=1) if valid > 1 else 0.0
            out[:valid] = (logs[:valid] - logs[:valid].mean(0)) / (spread + NORM_EPS)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features_of(np.array(x or [], np.float64))
                n = len(f)
                yield pa.RecordBatch.from_arrays([pa.array([k] * f.size, pa.int64()), pa.array(np.repeat(np.arange(n), n_mels)), pa.array(np.tile(np.arange(n_mels), n)), pa.array(f.ravel())], ["key", "frame", "mel", "feature"])

    return rows.select(F.col(key).cast("long"), samples).mapInArrow(run, "key long, frame long, mel long, feature double").withColumnRenamed("key", key)


def framed_blocks(parts: DataFrame, by: list[str], n_mels: int = 80, n_fft: int = pcm.N_FFT, hop: int = pcm.HOP, window: int = pcm.WINDOW, frames: int = 64, start: str = "at", total: str = "total") -> DataFrame:
    """Log-mel frames of utterances that arrive in parts, by blocks of ``frames``.

    ``parts(by, start, samples, total)``: parts of an utterance follow each other
    from place 0 to its ``total`` samples. A block gets the samples around its
    frames, so frames reach over the borders of parts and no utterance is held
    whole. Returns (by, block, first, frames, n, mean, m2): the block's frames
    from ``first`` on, and count, means and squared deviations of its valid ones.
    An utterance without samples has no rows.
    """
    size, before, after = frames * hop, n_fft // 2 + 1, max(0, n_fft // 2 - hop)
    basis, shape = mel_basis(n_mels, n_fft, exact=True).T, np.zeros(n_fft)
    shape[(n_fft - window) // 2 :][:window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / (window - 1))
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                b = whole.slice(at, 32)
                block, lo, total = (b.column(k + i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                x = np.zeros((b.num_rows, before + size + after))
                for r, part in enumerate(b.column(k + 2)):
                    own = part.values.to_numpy(zero_copy_only=False)
                    first = lo[r] - (block[r] * size - before)
                    x[r, first : first + len(own)] = own
                y = x[:, 1:] - pcm.EMPHASIS * x[:, :-1]
                y[np.arange(y.shape[1]) + (block * size - before + 1)[:, None] >= total[:, None]] = 0
                cut = np.lib.stride_tricks.sliding_window_view(y, n_fft, axis=1)[:, ::hop][:, :frames]
                logs = np.log(np.abs(np.fft.rfft(cut * shape, axis=2)) ** 2 @ basis + LOG_FLOOR)
                count = np.clip(total // hop + 1 - block * frames, 0, frames)
                valid = np.clip(total // hop - block * frames, 0, frames)
                listed = logs[np.arange(frames) < count[:, None]]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(listed) + 1) * n_mels, pa.int32()), pa.array(listed.ravel()))
                outer = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), inner)
                mask = (np.arange(frames) < valid[:, None])[:, :, None]
                mean = np.where(mask, logs, 0).sum(1) / np.maximum(valid, 1)[:, None]
                m2 = (np.where(mask, logs - mean[:, None], 0) ** 2).sum(1)
                each = pa.array(np.arange(b.num_rows + 1) * n_mels, pa.int32())
                added = [pa.array(block * frames), outer, pa.array(valid), *[pa.ListArray.from_arrays(each, pa.array(v.ravel())) for v in (mean, m2)]]
                yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], *added], [*by, "block", "first", "frames", "n", "mean", "m2"]).filter(pa.array(count > 0))

    x = halo_blocks(parts.select(*by, F.col(start).cast("long").alias("__at"), "samples", F.col(total).cast("long").alias("__total")), by, size, before, after, start="__at", carry=("__total",))
    kinds = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in by)
    x = x.select(*by, "block", "lo", F.col("samples").cast("array<double>").alias("samples"), "__total")
    return x.mapInArrow(run, f"{kinds}, block long, first long, frames array<array<double>>, n long, mean array<double>, m2 array<double>")


def normalised_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """``framed_blocks`` rows -> (by, block, first, features): each mel over its
    utterance's valid frames, mean 0 and deviation (n - 1) 1, and zeros after. The
    blocks' moments are merged: means by their counts, squared deviations with the
    shift of each block's mean."""
    blocks = cut(blocks)
    each = blocks.where("n > 0").select(*by, "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("mel", "__v")).select(*by, "n", "mel", "__v.mean", "__v.m2")
    mu = F.sum(F.col("n") * F.col("mean")).over(W.partitionBy(*by, "mel")) / F.sum("n").over(W.partitionBy(*by, "mel"))
    merged = each.withColumn("mu", mu).groupBy(*by, "mel").agg(F.first("mu").alias("mu"), F.sum("n").alias("n"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mu")) ** 2).alias("m2"))
    scale = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0) + NORM_EPS
    known = merged.groupBy(*by).agg(F.max("n").alias("__valid"), F.sort_array(F.collect_list(F.struct("mel", "mu", scale.alias("scale")))).alias("__m"))
    x = blocks.select(*by, "block", "first", "frames").join(known, by, "left")

    def one(frame, i):
        scaled = F.zip_with(frame, "__m", lambda v, m: (v - m["mu"]) / m["scale"])
        return F.when(F.col("first") + i < F.coalesce("__valid", F.lit(0)), scaled).otherwise(F.transform(frame, lambda v: F.lit(0.0)))

    return x.select(*by, "block", "first", F.transform("frames", one).alias("features"))


def log_normalised(power: DataFrame, by: list[str], order: str, valid: str = "valid") -> DataFrame:
    """Log power over the rows of ``by``, normalised over rows flagged ``valid``;
    the rest are 0. Needs columns power and ``valid``."""
    logged = power.withColumn("log_power", F.ln(F.col("power") + F.lit(LOG_FLOOR)))
    w = W.partitionBy(*by)
    x = F.when(F.col(valid), F.col("log_power"))
    spread = F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    return logged.withColumn("feature", F.when(F.col(valid), (F.col("log_power") - F.avg(x).over(w)) / (spread + NORM_EPS)).otherwise(F.lit(0.0)))


def mel_filterbank(spark: SparkSession, n_mels: int = 80, n_fft: int = pcm.N_FFT, rate: int = 16_000) -> DataFrame:
    """The basis as ``(mel, bin, weight)``: a fixed table of n_mels x (n_fft / 2 + 1) rows."""
    bins = n_fft // 2 + 1
    top = pcm.hz_to_mel(F.lit(rate / 2))
    point = lambda k: pcm.mel_to_hz(top * (F.col("mel") + k) / F.lit(n_mels + 1))
    cells = spark.range(n_mels * bins).select(F.call_function("div", F.col("id"), F.lit(bins).cast("long")).alias("mel"), F.pmod("id", F.lit(bins)).alias("bin"))
    x = cells.withColumns({"lo": point(0), "mid": point(1), "hi": point(2), "hz": F.col("bin") * F.lit(rate / 2) / F.lit(bins - 1)})
    rise, fall = (F.col("hz") - F.col("lo")) / (F.col("mid") - F.col("lo")), (F.col("hi") - F.col("hz")) / (F.col("hi") - F.col("mid"))
    return x.select("mel", "bin", (F.greatest(F.lit(0.0), F.least(rise, fall)) * 2 / (F.col("hi") - F.col("lo"))).alias("weight"))
