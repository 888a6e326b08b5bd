"""Resampling to 16 kHz by overlap-save blocks.

Output sample m is the sum over input samples k of x[k] h(m / 16000 - k / rate) /
rate, with h(t) = 2 c sinc(2 c t) exp(-t^2 / 2 s^2): a low pass of cutoff c, 0.45
of the lower rate, under a bell of s = 12.8 periods of it, taken to 8.5 s on both
sides. A block of whole periods of both rates is filtered in the frequency
domain together with a halo of that reach, which its neighbours send. Outside a
source all is silence; 16 kHz passes unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.blocks import halo_blocks, place
from wavemill.schema import SAMPLE_RATE

#: Output samples of a block, about; the filter's cutoff, bell and reach.
OUT, CUTOFF, BELL, REACH = 1280, 0.45, 12.8, 8.5


@dataclass(frozen=True)
class Layout:
    """Blocks at one input rate: ``size`` samples and ``halo`` on both sides give
    ``out`` samples."""

    rate: int
    up: int
    down: int
    size: int
    halo: int
    out: int


@lru_cache(maxsize=64)
def layout(rate: int) -> Layout:
    g = math.gcd(rate, SAMPLE_RATE)
    up, down = SAMPLE_RATE // g, rate // g
    units = max(1, OUT // up)
    halo = 0 if rate == SAMPLE_RATE else down * math.ceil(REACH * BELL * rate / min(rate, SAMPLE_RATE) / down)
    return Layout(rate, up, down, down * units, halo, up * units)


@lru_cache(maxsize=16)
def _response(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed frequency bins of a block with its halo and the filter's gain there."""
    x = layout(rate)
    n, low = x.size + 2 * x.halo, min(rate, SAMPLE_RATE)
    cutoff, width = CUTOFF * low, low / (2 * math.pi * BELL)
    most = int((cutoff + 9 * width) * n / rate)
    bins = np.arange(-most, most + 1)
    edge = np.vectorize(math.erf)
    gain = (edge((bins * rate / n + cutoff) / (math.sqrt(2) * width)) - edge((bins * rate / n - cutoff) / (math.sqrt(2) * width))) / 2
    return bins, gain


def filter_blocks(x: np.ndarray, rate: int) -> np.ndarray:
    """[block, size + 2 halo] input samples to [block, out] samples at 16 kHz."""
    if rate == SAMPLE_RATE:
        return x
    form = layout(rate)
    n = x.shape[1]
    wide = n * form.up // form.down
    bins, gain = _response(rate)
    spectrum, out = np.fft.fft(x, axis=1), np.zeros((len(x), wide), complex)
    for fold in range(int(bins[0]) // wide, int(bins[-1]) // wide + 1):  # what lies past the new range comes back in
        own = bins // wide == fold
        out[:, bins[own] - fold * wide] += gain[own] * spectrum[:, bins[own] % n]
    first = form.halo * form.up // form.down
    return (np.fft.ifft(out, axis=1).real * (wide / n))[:, first : first + form.out]


def resample_array(x: np.ndarray, rate: int) -> np.ndarray:
    """A whole signal in one array; its length is the quotient rounded up."""
    form = layout(rate)
    blocks = -(-len(x) // form.size)
    padded = np.pad(np.asarray(x, np.float64), (form.halo, form.halo + blocks * form.size - len(x)))
    cut = [filter_blocks(padded[None, k * form.size : (k + 1) * form.size + 2 * form.halo], rate)[0] for k in range(blocks)]
    return np.concatenate(cut or [np.zeros(0)])[: -(-len(x) * SAMPLE_RATE // rate)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, block, lo, samples, rate, total) rows to (source, start_sample, samples)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, lo, rate, total = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5))
        data = batch.column(3)
        ends = np.concatenate(([0], np.cumsum(data.value_lengths().to_numpy())))
        flat = data.flatten().to_numpy(zero_copy_only=False)
        for one in np.unique(rate):
            form = layout(int(one))
            for rows in np.array_split(np.flatnonzero(rate == one), np.count_nonzero(rate == one) // 256 + 1):
                x = np.zeros((len(rows), form.size + 2 * form.halo))
                for i, r in enumerate(rows):
                    at = lo[r] - (block[r] * form.size - form.halo)
                    x[i, at : at + ends[r + 1] - ends[r]] = flat[ends[r] : ends[r + 1]]
                start = block[rows] * form.out
                n = np.clip(-(-total[rows] * form.up // form.down) - start, 0, form.out)
                y = filter_blocks(x, int(one))[np.arange(form.out) < n[:, None]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(y))
                some = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(block[rows]), pa.array(start), lists], ["source", "block", "start_sample", "samples"])
                yield some.filter(pa.array(n > 0))


def resample(chunks: DataFrame, by: str = "source_id", order: str = "seq", rate: str = "rate") -> DataFrame:
    """``chunks(by, order, rate, samples)`` -> ``(by, seq, start_sample, samples)`` at 16 kHz.

    A source has one rate above 0; its chunks may have any lengths, and null or
    empty ones add nothing. In all a source of n samples gives n 16000 / rate
    samples, rounded up, dealt to chunks of ``layout(rate).out``. A source spreads
    over tasks by its blocks.
    """
    divisors = F.array(*[F.lit(d) for d in range(1, SAMPLE_RATE + 1) if SAMPLE_RATE % d == 0])
    g = F.array_max(F.filter(divisors, lambda d: F.col(rate) % d == 0))
    down, up = F.col(rate) / g, F.lit(SAMPLE_RATE) / g
    size = down * F.greatest(F.lit(1), F.floor(F.lit(OUT) / up))
    halo = F.when(F.col(rate) == SAMPLE_RATE, 0).otherwise(down * F.ceil(F.lit(REACH * BELL) * F.col(rate) / F.least(F.col(rate), F.lit(SAMPLE_RATE)) / down))
    placed = place(chunks.select(by, order, F.col(rate).cast("int").alias(rate), "samples"), by, order)
    cut = halo_blocks(placed, [by], F.round(size), F.round(halo), F.round(halo), carry=(rate, "total"))
    kind = chunks.schema[by].dataType.simpleString()
    out = cut.select(by, "block", "lo", F.col("samples").cast("array<double>").alias("samples"), rate, "total").where("samples is not null")
    return out.mapInArrow(_blocks, f"source {kind}, block long, start_sample long, samples array<double>").toDF(by, "seq", "start_sample", "samples")

