"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's text is a line of equal blocks of words. Blocks are seats: they
go to sources by highest quotients target / (2k + 1), then within a source to
its shards by highest quotients of the shards' words, and inside a shard a
seeded choice takes as many whole passes and single blocks as its quota says.
All of it is DataFrame work; only tables of sources and of shards (at most
``max_shards`` to a source) are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``: weights repeat over the
    sources by code point, null last, and share the total; no target is above
    ``most`` times its source's size, and the excess is shared again by weight.

    In order of most * size / weight, the sources that reach their bound come
    first; a source is bound if the share that is left for it and all later
    ones, by weight, reaches its bound.
    """
    named = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", w.cast("double")).withColumn("bound", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    x = x.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(earlier), F.lit(0.0)))
    x = x.withColumn("level", F.col("left") / F.sum("weight").over(later))
    x = x.withColumn("free", F.col("level") * F.col("weight") < F.col("bound"))
    x = x.withColumn("share", F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.when(F.col("share").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("share") * F.col("weight")))
    return x.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, by: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats of each row within the rows equal in ``by``.

    All quotients above a first divisor win without being listed: with n rows,
    V votes and S seats, rounding votes * (S - n/2) / V gives at most S seats, and
    rounding votes * (S + n/2) / V at least S. Only the few quotients between are
    ranked for the seats that are left. Ties go to the smaller row key.
    """
    group = W.partitionBy(*by) if by else W.partitionBy()
    keys = [c for c in parties.columns if c not in (votes, seats)]
    n, total = F.count("*").over(group), F.sum(F.col(votes).cast("double")).over(group)

    def rounded(s: Column) -> Column:
        return F.when(total > 0, F.floor(F.col(votes) * F.greatest(s, F.lit(0.0)) / total + 0.5)).otherwise(0).cast("long")

    x = parties.withColumns({"sure": F.greatest(rounded(F.col(seats) - n / 2 - 1e-6) - 1, F.lit(0)), "may": rounded(F.col(seats) + n / 2 + 1e-6) + 1})
    x = x.withColumn("open", F.col(seats) - F.sum("sure").over(group))
    listed = x.where(F.col(votes) > 0).withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("may"))))
    rank = F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("k") + 1)).desc(), *keys, "k"))
    won = listed.withColumn("rank", rank).where(F.col("rank") <= F.col("open"))
    won = won.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.count("*").alias("won"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return x.join(won, same, "left").select(*parties.columns, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 16, shard_words: int = 1 << 17, max_shards: int = 8192, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target and taken beside its columns, a row
    per input row; these four replace columns of the same names.

    ``size`` is the words of the text (null: 0), ``taken`` the words that the mix
    takes of it, repeats counted, at most ``most`` times its size. Ties in the
    seeded order, which is of doc_id and text, go by doc_id and size; repeated rows
    share a place in it in any order, and rows without a doc_id spread by their
    texts. An empty table gives no rows.
    Small corpora are dealt in smaller blocks. Sources of more than ``max_shards``
    times ``shard_words`` words have larger shards.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), size.alias("__size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__order"))
    per = cut(sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")))
    block = min(block, max(1, (per.agg(F.sum("source_size")).first()[0] or 0) // 4096))
    goal = targets(per, weights, most)
    seats = F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")
    quotas = cut(apportion(goal.withColumn("seats", seats), [], "target", "seats").withColumn("shards", F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int")))
    side = quotas.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("quota").alias("__quota"), F.col("shards").alias("__shards"))
    at = sized.join(side, F.col("__source").eqNullSafe(F.col("__of")))
    at = at.withColumn("__shard", F.pmod(F.xxhash64("__order"), F.col("__shards")).cast("int"))
    place = at.select("__source", "__shard", "__size", "__quota")
    shard = place.groupBy("__source", "__shard").agg(F.sum("__size").alias("words"), F.first("__quota").alias("seats"))
    blocks = F.greatest(F.ceil(F.col("words") / block).cast("long"), F.lit(1))
    dealt = apportion(shard, ["__source"], "words", "seats").withColumn("blocks", blocks).withColumnRenamed("quota", "first")
    # what rounding put above a shard's bound goes to the source's shards with room
    over, room = F.greatest(F.col("first") - F.col("blocks") * most, F.lit(0)), F.greatest(F.col("blocks") * most - F.col("first"), F.lit(0))
    dealt = dealt.drop("seats").withColumn("room", room).withColumn("left", F.sum(over).over(W.partitionBy("__source")))
    dealt = apportion(dealt, ["__source"], "room", "left")
    dealt = dealt.withColumn("quota", F.least(F.least(F.col("first"), F.col("blocks") * most) + F.col("quota"), F.col("blocks") * most))
    dealt = dealt.select(F.col("__source").alias("s"), F.col("__shard").alias("h"), F.col("blocks").alias("__blocks"), F.col("quota").alias("__take"))
    line = W.partitionBy("__source", "__shard").orderBy("__order", "__id", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = at.withColumn("__end", F.sum("__size").over(line)).join(dealt, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__shard") == F.col("h")))
    extra, blocks = F.expr("__take % __blocks"), F.col("__blocks")
    phase = F.pmod(F.xxhash64(F.lit(seed), "__source", "__shard"), blocks)

    def chosen(b: Column) -> Column:  # single blocks chosen before block b
        return F.floor((b * extra + phase) / blocks).cast("long") - F.floor(phase / blocks).cast("long")

    def words(x: Column) -> Column:  # words of single blocks before place x
        b = F.floor(x / block).cast("long")
        return chosen(b) * block + (x - b * block) * (chosen(b + 1) - chosen(b))

    taken = F.expr("__take div __blocks") * F.col("__size") + words(F.col("__end")) - words(F.col("__end") - F.col("__size"))
    return laid.select(*[F.col("__row").getField(c).alias(c) for c in keep], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"))
