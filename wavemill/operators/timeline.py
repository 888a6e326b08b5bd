"""Chunks and marks on their sources' and the session's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions import clock
from wavemill.operators.blocks import halo_blocks


def place_chunks(chunks: DataFrame, by: str = "source_id", order: str = "seq", length: str = "n_samples") -> DataFrame:
    """Adds ``start_sample`` (samples sent before) and ``start_ns``."""
    before = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("start_sample", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")).withColumn("start_ns", clock.samples_to_ns(F.col("start_sample")))


def anchor(chunks: DataFrame, by: str = "source_id", order: str = "seq", ts: str = "ts_ns") -> DataFrame:
    """Adds ``offset_sample``: the first chunk's explicit time in samples, else 0."""
    first = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return chunks.withColumn("offset_sample", F.coalesce(F.first(clock.ns_to_samples(F.col(ts))).over(first), F.lit(0)).cast("long"))


def check_continuity(placed: DataFrame, ts: str = "ts_ns") -> DataFrame:
    """Adds ``expected_ns`` and ``ok``: a later explicit time must be the sample that
    follows; a missing one always is."""
    expected = clock.checked_add(F.col("offset_sample"), F.col("start_sample"))
    actual = clock.ns_to_samples(F.col(ts))
    return placed.withColumn("expected_ns", clock.samples_to_ns(expected)).withColumn("ok", F.coalesce(actual == expected, F.col(ts).isNull()))


def rechunk(placed: DataFrame, size: int, by: str = "source_id") -> DataFrame:
    """Samples of placed chunks dealt anew to chunks of ``size``; the last may be
    shorter. Columns: by, chunk, n, samples. Chunks are sliced where they overlap a
    new one, so a row travels once for each of those."""
    cut = halo_blocks(placed, [by], size, 0, 0)
    return cut.select(by, F.col("block").alias("chunk"), F.size("samples").cast("long").alias("n"), "samples")
