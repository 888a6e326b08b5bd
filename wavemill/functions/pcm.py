"""PCM as arrays: scaling, mixing down, emphasis and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavemill.functions.clock import div
from wavemill.schema import SAMPLE_RATE

#: Pre-emphasis factor, frame lengths of the spectrogram.
EMPHASIS, N_FFT, HOP, WINDOW = 0.97, 512, 160, 400


def normalise(sample: Column, bits: Column) -> Column:
    """A signed integer sample of ``bits`` bits over its full scale."""
    return sample.cast("double") / F.pow(F.lit(2.0), bits - 1)


def downmix(samples: Column, channels: Column | int) -> Column:
    """Mean of each interleaved frame; an incomplete last frame is dropped."""
    c = channels if isinstance(channels, Column) else F.lit(channels)
    frames = div(F.size(samples), c)
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(frames - 1, F.lit(0))),
        lambda f: F.aggregate(F.slice(samples, (f * c + 1).cast("int"), c.cast("int")), F.lit(0.0), lambda a, x: a + x.cast("double")) / c,
    )
    mixed = F.when(frames > 0, each).otherwise(F.array().cast("array<double>"))
    return F.when(c <= 1, F.transform(samples, lambda x: x.cast("double"))).otherwise(mixed)


def resampled_length(frames: Column, rate: Column) -> Column:
    """Samples at 16 kHz of ``frames`` at ``rate``: the quotient rounded up."""
    return div(frames.cast("long") * SAMPLE_RATE + rate - 1, rate)


def preemphasis(samples: Column) -> Column:
    """y[0] = x[0], y[i] = x[i] - 0.97 x[i - 1]."""
    return F.transform(samples, lambda x, i: F.when(i == 0, x.cast("double")).otherwise(x.cast("double") - F.lit(EMPHASIS) * F.get(samples, i - 1).cast("double")))


def hann(i: Column, n: int = WINDOW) -> Column:
    """The symmetric Hann window at place i."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(2 * F.pi() * i / F.lit(n - 1))


def total_frames(samples: Column) -> Column:
    return div(samples, HOP) + 1


def valid_frames(samples: Column) -> Column:
    return div(samples, HOP)


def hz_to_mel(hz: Column) -> Column:
    linear = hz / F.lit(200.0 / 3)
    return F.when(hz < 1000, linear).otherwise(F.lit(15.0) + F.ln(hz / 1000) / F.lit(0.06875177742094912))


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel < 15, mel * F.lit(200.0 / 3)).otherwise(F.lit(1000.0) * F.exp(F.lit(0.06875177742094912) * (mel - 15)))
