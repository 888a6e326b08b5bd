"""Voice-activity gate: frame scores to speech segments.

Rules: a frame with p >= threshold opens a segment and cancels a pending end; the
first later frame with p < neg is the pending end; a frame with p < neg that is
min_silence after it closes the segment there. Kept if longer than min_speech;
an open segment ends with the audio. The negative threshold is 0.15 below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.config import GateConfig, samples_of_ms
from wavemill.functions.clock import div
from wavemill.operators.blocks import ROWS, running_sum


def segments(frames: DataFrame, config: GateConfig = GateConfig(), by: str = "source_id") -> DataFrame:
    """``frames(by, i, prob)`` -> ``(by, segment, start_sample, end_sample)``.

    Closed form: frames between two loud ones form a gap; a gap closes its
    segment if its quiet frames span min_silence, and the number of closed gaps
    before is the segment's number. Sources are one shuffle apart, and a source
    is a streamed window, not a group in memory.
    """
    neg, silence, speech = config.threshold - config.neg_gap, samples_of_ms(config.min_silence), samples_of_ms(config.min_speech)
    loud, quiet = F.col("prob") >= config.threshold, F.col("prob") < neg
    order = W.partitionBy(by).orderBy("i")
    runs = frames.withColumn("gap", F.sum(loud.cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    gaps = (
        runs.groupBy(by, "gap")
        .agg(F.min(F.when(loud, F.col("i"))).alias("opens"), F.min(F.when(quiet, F.col("i"))).alias("a"), F.max(F.when(quiet, F.col("i"))).alias("b"), F.max("i").alias("last"))
    )
    gaps = gaps.withColumn("closed", F.coalesce((F.col("b") - F.col("a")) * config.frame >= silence, F.lit(False)))
    ordered = W.partitionBy(by).orderBy("gap")
    number = F.sum(F.when(F.col("closed") & (F.col("gap") > 0), 1).otherwise(0)).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    total = (F.max("last").over(W.partitionBy(by)) + 1) * config.frame
    numbered = gaps.withColumn("total", total).withColumn("nth", F.coalesce(number, F.lit(0))).where("gap > 0")
    out = numbered.groupBy(by, "nth").agg(
        (F.min("opens") * config.frame).alias("start_sample"),
        F.coalesce(F.max(F.when(F.col("closed"), F.col("a"))) * config.frame, F.max("total")).alias("end_sample"),
    )
    kept = out.where(F.col("end_sample") - F.col("start_sample") > speech)
    return kept.select(by, (F.row_number().over(W.partitionBy(by).orderBy("start_sample")) - 1).cast("long").alias("segment"), "start_sample", "end_sample")


def pad_and_clamp(found: DataFrame, totals: DataFrame, config: GateConfig = GateConfig(), by: str = "source_id") -> DataFrame:
    """Pads segments on both sides (a gap under twice the pad is halved), then keeps
    starts behind the last end and ends within the ``totals(by, total)`` samples."""
    pad = samples_of_ms(config.pad)
    order = W.partitionBy(by).orderBy("start_sample")
    before, after = F.lag("end_sample").over(order), F.lead("start_sample").over(order)
    half = lambda gap: F.call_function("div", gap, F.lit(2).cast("long"))
    start = F.when(before.isNull(), F.greatest(F.col("start_sample") - pad, F.lit(0))).when(F.col("start_sample") - before < 2 * pad, F.col("start_sample") - half(F.col("start_sample") - before)).otherwise(F.col("start_sample") - pad)
    end = F.when(after.isNull(), F.col("end_sample") + pad).when(after - F.col("end_sample") < 2 * pad, F.col("end_sample") + half(after - F.col("end_sample"))).otherwise(F.col("end_sample") + pad)
    padded = found.withColumns({"p_start": start, "p_end": end}).join(totals, by)
    latest = F.max("p_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    clamped = padded.withColumns({"p_start": F.greatest(F.col("p_start"), F.coalesce(latest, F.lit(0))), "p_end": F.least("p_end", "total")})
    return clamped.where("p_end > p_start").select(by, "segment", F.col("p_start").alias("start_sample"), F.col("p_end").alias("end_sample"))


def stretches(frames: DataFrame, config: GateConfig = GateConfig(), by: str = "source_id") -> DataFrame:
    """``frames(by, i, prob)`` with ``stretch``, the number of closed gaps before, from a
    source's first loud frame on. After a closed gap the gate is idle whatever came
    before, so stretches can be walked apart. Sums over a source go by blocks."""
    neg, silence = config.threshold - config.neg_gap, samples_of_ms(config.min_silence)
    quiet = F.col("prob") < neg
    flagged = frames.select(by, "i", "prob", F.coalesce(F.col("prob") >= config.threshold, F.lit(False)).cast("long").alias("loud"), div(F.col("i"), ROWS).alias("__block"))
    runs = running_sum(flagged, [by], "__block", ["i"], "loud", "gap").where("gap > 0").select(by, "i", "prob", "gap")
    gaps = runs.groupBy(by, "gap").agg(F.min(F.when(quiet, F.col("i"))).alias("a"), F.max(F.when(quiet, F.col("i"))).alias("b"))
    gaps = gaps.select(by, "gap", F.coalesce((F.col("b") - F.col("a")) * config.frame >= silence, F.lit(False)).cast("long").alias("closed"), div(F.col("gap"), ROWS).alias("__block"))
    before = running_sum(gaps, [by], "__block", ["gap"], "closed", "stretch", here=False)
    return runs.join(before.select(by, "gap", F.col("stretch").cast("long").alias("stretch")), [by, "gap"]).select(by, "stretch", "i", "prob")


def capped_segments(frames: DataFrame, config: GateConfig = GateConfig(), by: str = "source_id") -> DataFrame:
    """``segments`` where speech may outlast max_speech: a segment is cut at the cap.
    Stretches between closed gaps are walked frame by frame, each in one task."""
    kind = frames.schema[by].dataType.simpleString()
    cut = stretches(frames, config, by).repartition(by, "stretch").sortWithinPartitions(by, "stretch", "i").mapInArrow(_walked(config, by), f"`{by}` {kind}, start_sample long, end_sample long")
    number = F.row_number().over(W.partitionBy(by).orderBy("start_sample")) - 1
    return cut.select(by, number.cast("long").alias("segment"), "start_sample", "end_sample")


def _walked(config: GateConfig, by: str):
    """The rules over (by, stretch, i, prob) rows sorted by these: a stretch of any
    length takes the memory of one batch."""
    neg = config.threshold - config.neg_gap
    silence, speech = samples_of_ms(config.min_silence), samples_of_ms(config.min_speech)
    cap = samples_of_ms(config.max_speech) - config.frame - 2 * samples_of_ms(config.pad)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = [0]

        def scored(rows):
            for _, _, i, p in rows:
                last[0] = i
                yield i * config.frame, float("nan") if p is None else p

        frames = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for (source, _), rows in groupby(frames, key=lambda row: row[:2]):
            for a, b in walk(scored(rows), config.threshold, neg, silence, speech, cap, lambda: (last[0] + 1) * config.frame):
                yield source, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while held := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], [by, "start_sample", "end_sample"])

    return run


def walk(scored, threshold: float, neg: float, silence: int, speech: int, cap: int | None, total: int | Callable[[], int]) -> Iterator[tuple[int, int]]:
    start = pending = None
    for at, p in scored:
        if start is not None and cap is not None and at - start > cap:
            yield int(start), int(at)
            start = pending = None
        if p >= threshold:
            start = at if start is None else start
            pending = None
        elif p < neg and start is not None:
            pending = at if pending is None else pending
            if at - pending >= silence:
                if pending - start > speech:
                    yield int(start), int(pending)
                start = pending = None
    end = total() if callable(total) else total
    if start is not None and end - start > speech:
        yield int(start), int(end)
