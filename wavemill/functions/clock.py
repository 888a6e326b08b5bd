"""Exact arithmetic between samples, nanoseconds and milliseconds.

One sample lasts 62,500 ns exactly, so 64-bit integer division replaces the wide
products of the formulas. Times are limited to 63 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavemill.schema import NS, SAMPLE_RATE

SAMPLE_NS = NS // SAMPLE_RATE


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a.cast("long"), b.cast("long") if isinstance(b, Column) else F.lit(b).cast("long"))


def samples_to_ns(samples: Column) -> Column:
    """floor(samples * 10^9 / 16000)."""
    return samples.cast("long") * F.lit(SAMPLE_NS)


def ns_to_samples(ns: Column) -> Column:
    """floor(ns * 16000 / 10^9)."""
    return div(ns, SAMPLE_NS)


def ns_to_ms(ns: Column) -> Column:
    return div(ns, 1_000_000)


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    """floor of the difference, 0 if it is negative; not the difference of the floors."""
    return ns_to_ms(F.greatest(end_ns - start_ns, F.lit(0)))


def checked_add(a: Column, b: Column) -> Column:
    """The sum, or null where it leaves 63 bits (an invalid timestamp)."""
    return F.try_add(a, b)


def capture_time(elapsed: Column, callback: Column, capture: Column) -> Column:
    """Session time of a buffer's capture: what has elapsed less the delay from its
    capture to its callback, neither below 0."""
    return F.greatest(elapsed - F.greatest(callback - capture, F.lit(0)), F.lit(0))
