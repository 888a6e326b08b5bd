"""One long source over many tasks: places by two-level sums, blocks with halos,
and the join of intervals with chunks.

A source is cut into blocks of rows or of samples, so that no step needs all of
it in one task; only sums of blocks pass through a window over the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions.clock import div

#: Rows of a block in running sums; samples of a bucket in the interval join.
ROWS, BUCKET = 4096, 16_384


def running_sum(rows: DataFrame, by: list[str], block: str, order: list[str], value: str, name: str, here: bool = True) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``by`` before (``here``: and at) each
    row. ``block`` rises with ``order``; a block's rows go to one task, a key's do not."""
    sums = rows.groupBy(*by, block).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = sums.select(*by, block, before.alias("__before"))
    inner = W.partitionBy(*by, block).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if here else -1)
    return rows.join(begun, [*by, block]).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__before")


def place(chunks: DataFrame, by: str = "source_id", order: str = "seq", samples: str = "samples") -> DataFrame:
    """``chunks`` with ``start_sample``, the samples that the source sent before, and
    ``total``, all it sent. ``order`` is a whole number, unique in its source. Sums
    are made on narrow rows; samples travel once, dealt by source and order."""
    narrow = chunks.select(by, order, F.coalesce(F.size(samples), F.lit(0)).cast("long").alias("__n"), div(F.col(order), ROWS).alias("__block"))
    starts = running_sum(narrow, [by], "__block", [order], "__n", "start_sample", here=False)
    totals = narrow.groupBy(by).agg(F.sum("__n").alias("total"))
    starts = starts.join(totals, by).select(by, order, F.col("start_sample").cast("long").alias("start_sample"), "total")
    return chunks.join(starts, [by, order])


def halo_blocks(placed: DataFrame, by: list[str], size: Column | int, before: Column | int, after: Column | int, samples: str = "samples", start: str = "start_sample", carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``size`` samples with what lies ``before`` and ``after`` them.

    Returns (by, block, lo, samples, carry): the samples from place ``lo`` on.
    Every chunk sends its parts to the blocks that they lie in or border on, so a
    source spreads over as many tasks as it has blocks. Chunks of a key follow
    each other without gaps; ``carry`` columns are constant for a key.
    """
    size, before, after = (x if isinstance(x, Column) else F.lit(x) for x in (size, before, after))
    names = {"__size": size, "__before": before, "__after": after, "__s": F.col(start), "__e": F.col(start) + F.size(samples)}
    x = placed.withColumns({k: c.cast("long") for k, c in names.items()}).where("__e > __s")
    x = x.withColumn("block", F.explode(F.expr("sequence(greatest(__s - __after, 0) div __size, (__e - 1 + __before) div __size)")))
    x = x.withColumns({"__lo": F.expr("greatest(__s, block * __size - __before)"), "__hi": F.expr("least(__e, (block + 1) * __size + __after)")}).where("__hi > __lo")
    part = F.slice(samples, (F.col("__lo") - F.col("__s") + 1).cast("int"), (F.col("__hi") - F.col("__lo")).cast("int"))
    x = x.select(*by, "block", *carry, F.struct(F.col("__lo").alias("lo"), part.alias("part")).alias("__part"))
    x = x.groupBy(*by, "block").agg(F.sort_array(F.collect_list("__part")).alias("__parts"), *[F.first(c).alias(c) for c in carry])
    return x.select(*by, "block", F.get("__parts", F.lit(0))["lo"].alias("lo"), F.flatten(F.transform("__parts", lambda p: p["part"])).alias("samples"), *carry)


def within(intervals: DataFrame, placed: DataFrame, by: str = "source_id", samples: str = "samples") -> DataFrame:
    """Chunks cut to the intervals that they overlap.

    ``intervals(by, ..., start_sample, end_sample)`` of any lengths, which may
    overlap, and ``placed(by, start_sample, samples)`` meet in buckets of
    ``BUCKET`` samples, each overlapping pair in the first bucket that both reach.
    Returns the intervals' columns with ``at``, the place of the part in its
    interval, and ``samples``. Work grows with the samples and the overlaps.
    """

    def bucketed(x: DataFrame, lo: str, hi: str) -> DataFrame:
        return x.where(F.col(hi) > F.col(lo)).withColumn("__bucket", F.explode(F.sequence(div(F.col(lo), BUCKET), div(F.col(hi) - 1, BUCKET))))

    chunks = placed.select(by, F.col("start_sample").alias("__lo"), (F.col("start_sample") + F.size(samples)).cast("long").alias("__hi"), F.col(samples).alias("__samples"))
    both = bucketed(intervals, "start_sample", "end_sample").join(bucketed(chunks, "__lo", "__hi"), [by, "__bucket"])
    lo, hi = F.greatest("start_sample", "__lo"), F.least("end_sample", "__hi")
    both = both.withColumns({"__from": lo, "__to": hi}).where((F.col("__to") > F.col("__from")) & (F.col("__bucket") == div(F.col("__from"), BUCKET)))
    part = F.slice("__samples", (F.col("__from") - F.col("__lo") + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int"))
    return both.select(*intervals.columns, (F.col("__from") - F.col("start_sample")).alias("at"), part.alias(samples))
