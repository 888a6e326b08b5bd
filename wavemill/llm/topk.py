"""Exact top-k inner products through a pivot-distance index.

Vectors are made integers, so scores are exact. Each vector is keyed by its
nearest pivot and the annulus of its distance to it. An annulus with distances
in [r1, r2] from pivot p can hold a score only up to a bound by the triangle
inequality:
    |q - x| >= max(d(q, p) - r2, r1 - d(q, p), 0)  and
    2 <q, x> = |q|^2 + |x|^2 - |q - x|^2.
A query visits the annuli sorted by that bound, a few first and then more at a
time, and stops where the bound falls below its k-th score so far: all further
ones are bounded lower still.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, prepare, spread

#: Pivots, annuli of a pivot, vectors they are fitted on, and rows of a tile.
PIVOTS, ANNULI, SAMPLE, TILE = 48, 8, 4096, 2048
#: A query's first annuli, and how many times as many it has visited after each further step.
FIRST, WIDEN = 4, 8
RESULT = "query_id long, rank int, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, vector array<double>)`` with components floor(scale * x); rows
    that are null, empty or hold null or non-finite components are left out."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double"))
    fine = F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 1e300)), F.lit(False))
    return vectors.where(fine & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select("vec_id", x.alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(lists[0]) if len(lists) else 0
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, in floating point where that is exact."""
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53:
        return (q @ x.T).astype(np.int64)
    wide = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first seeds, then a few rounds of means."""
    chosen = [sample[0]]
    gap = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and gap.max() > 0:
        chosen.append(sample[gap.argmax()])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(1))
    p = np.array(chosen)
    for _ in range(5):
        near = distances(sample, p).argmin(1)
        p = np.stack([sample[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T, 0))


def _index(pivots: np.ndarray, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            d = distances(x, pivots) if len(x) else np.zeros((0, 1))
            pivot = d.argmin(1).astype(np.int32)
            dist = d[np.arange(len(d)), pivot] if len(d) else np.zeros(0)
            ring = (edges[pivot] <= dist[:, None]).sum(1).astype(np.int32)
            norm = (x**2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot), pa.array(dist), pa.array(ring), pa.array(norm)], ["vec_id", "vector", "pivot", "dist", "ring", "norm"])

    return run


def bounds(q: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """The highest score that each query can have in each annulus, with room for rounding."""
    at, r1, r2, top = (cells[c].to_numpy() for c in ("pivot", "r1", "r2", "top"))
    d = distances(q, pivots)[:, at]
    far = np.maximum(np.maximum(d - r2, r1 - d), 0)
    best = ((q**2).sum(1)[:, None] + top - far**2) / 2
    return best + np.abs(best) * 1e-9 + 1


def _route(pivots: np.ndarray, cells: pd.DataFrame, lo: int, hi: int):
    """(query, annulus) of places ``lo`` to ``hi`` in the order of bounds, as far as
    the bounds reach the query's floor."""
    cp, cr = (cells[c].to_numpy().astype(np.int32) for c in ("pivot", "ring"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            best = bounds(matrix(b.column(1)), pivots, cells)
            go = np.argsort(-best, axis=1, kind="stable")[:, lo:hi]
            floor = b.column(2).to_numpy(zero_copy_only=False).astype(float)  # no floor yet: nan
            at, place = np.nonzero(~(np.take_along_axis(best, go, 1) < floor[:, None]))
            cell = go[at, place]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(cp[cell]), pa.array(cr[cell])], ["query_id", "query", "pivot", "ring"])

    return run


def _search(k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            ids = rows.column("vec_id").to_numpy()
            s = scores(matrix(queries.column("query")), matrix(rows.column("vector")))
            for qid, line in zip(queries.column("query_id").to_pylist(), s):
                pick = np.flatnonzero(line >= np.partition(line, -min(k + 1, len(line)))[-min(k + 1, len(line))])
                pick = pick[np.lexsort((ids[pick], -line[pick]))]
                pick = pick[ids[pick] != qid][:k]
                out["query_id"] += [qid] * len(pick)
                out["vec_id"] += ids[pick].tolist()
                out["score"] += line[pick].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def top_k(items: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """``top_of_width`` for each width of the queries' vectors: a query and its results
    have the same number of components."""
    widths = [r.w for r in queries.select(F.size("vector").alias("w")).distinct().orderBy("w").collect()]  # not rows
    found = [top_of_width(*(x.where(F.size("vector") == w) for x in (items, queries)), k, pivots) for w in widths]
    return reduce(DataFrame.unionByName, found) if found else items.sparkSession.createDataFrame([], RESULT)


def top_of_width(items: DataFrame, queries: DataFrame, k: int, pivots: int) -> DataFrame:
    """``items``, ``queries`` of ``(vec_id long, vector array<double>)`` of whole
    numbers -> ``(query_id, rank, vec_id, score)``: the k best items of each query
    but itself by inner product, ties to the smaller vec_id.

    Pivots and ring borders are fitted on at most ``SAMPLE`` vectors, by the order
    of their hashed ids; every vector is indexed. All have one width. Repeated rows
    count once; a query id with several vectors asks with the least of them, and as
    a candidate it stands for each. Of equal vectors only the k + 1 of smallest id can be in a result; the
    index leaves out the others, which changes nothing.
    """
    spark = items.sparkSession
    prepare(spark)
    empty = spark.createDataFrame([], RESULT)
    order = F.xxhash64("vec_id")
    sample = items.orderBy(order, "vec_id").limit(SAMPLE).select("vector").toArrow().column(0).to_pylist()
    if not sample:
        return empty
    fitted = np.array(sample)
    centers = fit_pivots(fitted, pivots)
    d = distances(fitted, centers)
    near = d.argmin(1)
    edges = np.stack([np.quantile(d[near == i, i] if (near == i).any() else np.zeros(1), np.linspace(0, 1, ANNULI + 1)[1:-1]) for i in range(len(centers))])
    first = W.partitionBy("vector", "salt").orderBy("vec_id")
    again = W.partitionBy("vector").orderBy("vec_id")
    distinct = (
        items.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
        .withColumn("n", F.row_number().over(W.partitionBy("vector", "vec_id").orderBy("salt"))).where("n = 1")
        .withColumn("n", F.row_number().over(again)).where(F.col("n") <= k + 1)
        .select("vec_id", "vector")
    )
    indexed = cut(spread(distinct).mapInArrow(_index(centers, edges), "vec_id long, vector array<double>, pivot int, dist double, ring int, norm double"))
    cell = indexed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("r1"), F.max("dist").alias("r2"), F.max("norm").alias("top"))
    cells = cell.toPandas()  # at most pivots x ANNULI rows
    cells["tiles"] = -(-cells["n"] // TILE)
    tiles = F.broadcast(spark.createDataFrame(cells[["pivot", "ring", "tiles"]].astype("int32"), "pivot int, ring int, tiles int"))
    stored = indexed.join(tiles, ["pivot", "ring"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    asked = cut(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query")))
    blocks = max(1, -(-asked.count() // TILE))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(routed: DataFrame) -> DataFrame:
        q = routed.join(tiles, ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        used = q.select("pivot", "ring", "tile", "block").distinct()
        x = stored.select("pivot", "ring", "tile", "vec_id", "vector").join(used, ["pivot", "ring", "tile"])
        key = ["pivot", "ring", "tile", "block"]
        x = x.select(*[F.col(c).alias(f"x_{c}") for c in key], "vec_id", "vector")  # names of its own: both sides stem from one table
        return q.select(*key, "query_id", "query").groupBy(*key).cogroup(x.groupBy(*[f"x_{c}" for c in key])).applyInArrow(_search(k), "query_id long, vec_id long, score long")

    # a loop over steps of widening, not over rows: few, whatever the tables' sizes
    found, lo, hi = None, 0, FIRST
    while lo < len(cells):
        if found is None:
            open_ = asked.withColumn("floor", F.lit(None).cast("double"))
        else:
            reached = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
            open_ = asked.join(reached, "query_id", "left").select("query_id", "query", "floor")
        routed = cut(open_.mapInArrow(_route(centers, cells, lo, hi), "query_id long, query array<double>, pivot int, ring int"))
        if found is not None and routed.isEmpty():
            break
        new = searched(routed)
        seen = new if found is None else new.unionByName(found.drop("rank"))
        found = cut(seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        lo, hi = hi, hi * WIDEN
    return empty if found is None else found.select("query_id", "rank", "vec_id", "score")


def embeddings_top_k(embeddings: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``, against all rows."""
    items = whole_numbers(embeddings.select("vec_id", "embedding"), scale)
    return top_k(items, items.where(F.pmod("vec_id", F.lit(every)) == 0), k)
