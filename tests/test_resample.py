"""Block-wise resampling: lengths, impulses, the direct sum, and blocks in Spark against one array."""

import numpy as np
import pytest

from wavemill.operators import resample as module
from wavemill.operators.resample import REACH, layout, resample, resample_array

SCHEMA = "source_id long, seq long, rate int, samples array<float>, block string, start_sample string"


def in_chunks(signals, size=137):
    """(source, rate, samples) as chunk rows, last ones first."""
    rows = []
    for source, rate, x in signals:
        rows += [(source, k * 3, rate, [float(v) for v in x[lo : lo + size]], "x", "y") for k, lo in enumerate(range(0, len(x), size))]
    return rows[::-1]


def resampled(spark, signals, size=137):
    out = {source: {} for source, *_ in signals}
    for r in resample(spark.createDataFrame(in_chunks(signals, size), SCHEMA)).collect():
        assert r.start_sample == r.seq * layout(dict((s, rate) for s, rate, _ in signals)[r.source_id]).out
        out[r.source_id][r.seq] = r.samples
    for parts in out.values():
        assert sorted(parts) == list(range(len(parts)))
    return {s: np.concatenate([parts[k] for k in sorted(parts)] or [[]]) for s, parts in out.items()}


def direct(x, rate):
    low = min(rate, 16_000)
    t = np.arange(-(-len(x) * 16_000 // rate))[:, None] / 16_000 - np.arange(len(x)) / rate
    h = 0.9 * low * np.sinc(0.9 * low * t) * np.exp(-((t * low / 12.8) ** 2) / 2) * (np.abs(t) <= REACH * 12.8 / low)
    return h @ x / rate


def test_expected_duration_of_partial_chunks(spark):
    signals = [(i, rate, np.full(n, 0.25)) for i, (rate, n) in enumerate((r, n) for r in (44_100, 48_000) for n in (1, 137, 439, 440, 441, 479, 480, 481, 4817))]
    got = resampled(spark, signals)
    for source, rate, x in signals:
        assert len(got[source]) == -(-len(x) * 16_000 // rate)


def test_impulses_stay_at_the_ends(spark):
    signals = []
    for rate in (44_100, 48_000):
        for at in (0, rate // 10 - 1):
            x = np.zeros(rate // 10)
            x[at] = 1
            signals.append((rate * 10 + (at > 0), rate, x))
    for source, y in resampled(spark, signals).items():
        peak = int(np.abs(y).argmax())
        assert len(y) == 1600 and (peak >= 1595 if source % 10 else peak < 5)


@pytest.mark.parametrize("rate", [8_000, 11_025, 16_000, 22_050, 44_100, 48_000, 96_000])
def test_blocks_equal_direct_sum(spark, rate):
    x = np.random.default_rng(rate).normal(size=9_000).astype(np.float32).astype(np.float64)
    want = x if rate == 16_000 else direct(x, rate)
    assert np.allclose(resample_array(x, rate), want, atol=1e-9)
    assert np.allclose(resampled(spark, [(1, rate, x)], 1000)[1], want, atol=1e-9)


def test_tone_and_constant():
    t = np.arange(44_100) / 44_100
    y = resample_array(np.sin(2 * np.pi * 1000 * t), 44_100)
    assert np.allclose(y[200:-200], np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)[200:-200], atol=1e-8)
    assert np.abs(resample_array(np.sin(2 * np.pi * 12_000 * t), 44_100)[200:-200]).max() < 1e-8  # no alias
    assert np.allclose(resample_array(np.ones(9600), 48_000)[200:-200], 1, atol=1e-8)


def test_a_source_spreads_over_blocks(spark):
    """Halo parts go to neighbours only, and no block holds more than its samples and halo."""
    from wavemill.operators.blocks import halo_blocks, place

    form = layout(48_000)
    rows = spark.createDataFrame(in_chunks([(1, 48_000, np.arange(20_000) % 7)]), SCHEMA)
    cut = halo_blocks(place(rows.select("source_id", "seq", "samples")), ["source_id"], form.size, form.halo, form.halo).collect()
    assert len(cut) == -(-20_000 // form.size) + (20_000 % form.size <= form.halo and 0)
    assert max(len(r.samples) for r in cut) <= form.size + 2 * form.halo


def test_edges(spark):
    """Null and empty chunks, an empty table, and a source of one sample."""
    rows = [(1, 0, 44_100, None, "", ""), (1, 1, 44_100, [], "", ""), (1, 2, 44_100, [1.0], "", ""), (2, 0, 16_000, [0.5, -0.5], "", ""), (3, 0, 48_000, None, "", "")]
    got = {r.source_id: r.samples for r in resample(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2] and len(got[1]) == 1 and got[2] == [0.5, -0.5]
    assert resample(spark.createDataFrame([], SCHEMA)).collect() == []
    assert module.layout(16_000).halo == 0
