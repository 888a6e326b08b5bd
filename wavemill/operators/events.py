"""Transcript events: filters, ids, JSON, upserts, labels and delivery metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions import clock
from wavemill.functions.tokens import trim_unicode

#: Fixed value: the first backlog warning.
WARN_AT = 32


def drop_blank(segments: DataFrame, text: str = "text") -> DataFrame:
    """Segments with text; blank ones take no id."""
    return segments.where(trim_unicode(F.col(text)) != "")


def assign_ids(segments: DataFrame, session: str, *order: str) -> DataFrame:
    """Dense ids from 0 over all sources of a session in processing order."""
    return segments.withColumn("id", (F.row_number().over(W.partitionBy(session).orderBy(*order)) - 1).cast("long"))


def segment_json(fields: dict[str, Column]) -> Column:
    """The event envelope; nulls are written."""
    data = F.struct(*(c.alias(n) for n, c in fields.items()))
    return F.to_json(F.struct(F.lit("segment").alias("type"), data.alias("data")), {"ignoreNullFields": "false"})


END_OF_STREAM = '{"type":"end_of_stream"}'


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last revision of each id."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def labelled(events: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``labels(key, label)``, sent whole by Spark if it is small; others are ``unknown``."""
    return events.join(labels, key, "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def realtime_factor(inference_ns: Column, start_ns: Column, end_ns: Column) -> Column:
    audio = end_ns - start_ns
    return F.when(audio > 0, inference_ns.cast("double") / audio.cast("double")).otherwise(F.lit(0.0))


#: Counters stop at the largest signed 64-bit number.
COUNTER_MOST = (1 << 63) - 1


def saturating_sum(column: Column, over) -> Column:
    """A running count that stops at the top of its range."""
    return F.least(F.sum(column.cast("decimal(20,0)")).over(over), F.lit(str(COUNTER_MOST)).cast("decimal(38,0)")).cast("long")


def delivery_metrics(moves: DataFrame, by: str, *order: str) -> DataFrame:
    """``moves(by, emitted, received, discarded, failures, closed)``, counts and a
    flag, in order -> running counters; the last three may be missing.

    Receipts and discards take at most what is pending, so pending is the walk's
    height over its lowest point so far; what is received or discarded counts in
    full. A discard closes the receiver. Counters stop at ``COUNTER_MOST``.
    """
    given = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in moves.columns else F.lit(0).cast("long") for c in ("emitted", "received", "discarded", "failures")}
    closes = (F.coalesce(F.col("closed"), F.lit(False)) if "closed" in moves.columns else F.lit(False)) | (given["discarded"] > 0)
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    wide = {c: x.cast("decimal(20,0)") for c, x in given.items()}
    walked = moves.withColumn("_walk", F.sum(wide["emitted"] - wide["received"] - wide["discarded"]).over(w))
    floor = F.least(F.min("_walk").over(w), F.lit(0))
    out = walked.withColumn("pending", F.least(F.col("_walk") - floor, F.lit(str(COUNTER_MOST)).cast("decimal(38,0)")).cast("long"))
    counts = {"n_emitted": "emitted", "n_received": "received", "n_discarded": "discarded", "n_failures": "failures"}
    out = out.withColumns({name: saturating_sum(given[c], w) for name, c in counts.items()})
    return out.withColumns({"receiver_closed": F.max(closes).over(w), "peak_pending": F.max("pending").over(w)}).drop("_walk")


def backlog_warnings(metrics: DataFrame, by: str, *order: str) -> DataFrame:
    """Rows at which the peak first reaches 32, 64, 128 and so on: the threshold
    doubles past the peak, so a jump over several warns once."""
    level = F.when(F.col("peak_pending") < WARN_AT, F.lit(0)).otherwise(F.floor(F.log2(F.col("peak_pending") / F.lit(WARN_AT)) + 1e-9).cast("long") + 1)
    w = W.partitionBy(by).orderBy(*order)
    return metrics.withColumn("level", level.cast("long")).withColumn("_was", F.coalesce(F.lag("level").over(w), F.lit(0))).where("level > _was").drop("_was")


def first_failure(failures: DataFrame, by: str, message: str, order: str) -> DataFrame:
    return failures.groupBy(by).agg(F.min(order).alias(order), F.min_by(message, order).alias(message))


def with_duration(segments: DataFrame) -> DataFrame:
    start, end = F.col("start_ns"), F.col("end_ns")
    return segments.withColumns({"start_ms": clock.ns_to_ms(start), "end_ms": clock.ns_to_ms(end), "duration_ms": clock.duration_ms(start, end)})
