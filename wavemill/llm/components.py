"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _rank(name: str):
    return F.struct(F.xxhash64(F.col(name), F.lit(77)).alias("h"), F.col(name).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, root)``, one row per vertex with an edge.

    Each round every vertex hooks onto its neighbour of least hashed rank, and
    the edges are redrawn between the hooks. Hashed ranks keep chains short, so
    rounds grow with the logarithm of the vertices, and each works on fewer
    edges. Hubs are safe: minima are combined before the shuffle and the joins'
    other side has one row per vertex. Self-loops and repeats are dropped.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found: DataFrame | None = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        hooks = cut(
            both.groupBy("v").agg(F.min(_rank("u")).alias("m")).select("v", F.least(F.col("m"), _rank("v"))["id"].alias("p"))
        )
        ends = hooks.select(F.col("v").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = e.join(ends[0], "a").join(ends[1], "b")
        e = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
        if found is None:
            found = hooks.select(F.col("v").alias("id"), F.col("p").alias("root"))
        else:
            step = hooks.select(F.col("v").alias("root"), "p")
            found = found.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    if found is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return cut(found)
