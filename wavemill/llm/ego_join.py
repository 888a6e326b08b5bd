"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned onto principal axes and sorted by the grid cells of the
leading ones, cells as wide as the largest distance that the cosine threshold
allows. Runs of the sorted sequence are blocks. Two blocks meet only if they
hold rows in equal or adjoining cells, and if a small interval of one has a box
near enough to the box of one of the other; only then do their vectors travel.
Pairs of blocks are dealt by tiles, squares of the numbered sequence, so that a
block travels once for all its pairs in a tile.
Their intervals are halved again and again, pairs of intervals whose boxes are
too far apart are skipped, and small intervals are compared by matrix product in
double precision.

A pair of blocks returns, per vector with links in it, their number and one
vector it is connected to, so the output stays linear in dense groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, prepare
from .components import components
from .topk import matrix

#: Leading axes of the grid and of the boxes, rows of a block and of a leaf, and
#: vectors that the axes are fitted on (they decide speed only).
GRID, BOX, BLOCK, LEAF, SAMPLE = 4, 12, 8192, 512, 4096
#: Most blocks of a tile's side (a worker holds two sides), and the shares of the rows of a cell.
SIDE, SHARES = 8, 16
_CELL = 12  # bits of a cell number


def valid(column: str = "embedding"):
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 1e150))
    return F.coalesce(fine & F.exists(column, lambda c: c != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def axes_of(sample: np.ndarray) -> np.ndarray:
    centred = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, : min(BOX, sample.shape[1])].copy()


def cells_of(z: np.ndarray, eps: float) -> np.ndarray:
    return np.floor(z[:, : min(GRID, z.shape[1])] / eps).astype(np.int64) + (1 << (_CELL - 1))


def _codes(cells: np.ndarray) -> np.ndarray:
    code = np.zeros(len(cells), np.int64)
    for c in cells.T:
        code = (code << _CELL) | c
    return code


def order_codes(z: np.ndarray, eps: float) -> np.ndarray:
    """Rows' places in the grid order: cells of as many leading axes as 62 bits hold."""
    most = int(1 / eps) + 2
    bits = (2 * most).bit_length()
    code = np.zeros(len(z), np.int64)
    for c in z.T[: 62 // bits]:
        code = (code << bits) | (np.floor(c / eps).astype(np.int64) + most)
    return code


def _ordered(axes: np.ndarray, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2))
            z = unit(x) @ axes if len(x) else np.zeros((0, axes.shape[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order_codes(z, eps))], ["id", "copies", "vector", "code"])

    return run


def _blocks(axes: np.ndarray, eps: float):
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * min(GRID, axes.shape[1]), indexing="ij"), -1).reshape(-1, min(GRID, axes.shape[1]))

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        u = unit(matrix(t.column("vector")))
        z = u @ axes
        cells = np.unique(cells_of(z, eps), axis=0)
        around = np.unique(_codes((cells[:, None] + steps[None]).reshape(-1, cells.shape[1])))
        runs = [z[i : i + LEAF] for i in range(0, len(z), LEAF)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([t.column("id").to_numpy().tobytes()]),
                pa.array([t.column("copies").to_numpy().tobytes()]),
                pa.array([u.tobytes()]),
                pa.array([z.min(0).tolist()]),
                pa.array([z.max(0).tolist()]),
                pa.array([_codes(cells).tolist()], pa.list_(pa.int64())),
                pa.array([around.tolist()], pa.list_(pa.int64())),
                pa.array([[x.min(0).tolist() for x in runs]]),
                pa.array([[x.max(0).tolist() for x in runs]]),
            ],
            ["block", "ids", "copies", "units", "low", "high", "cells", "around", "lows", "highs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, parts, rows = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            while len(b):
                take = b.slice(0, BLOCK - rows)
                b = b.slice(len(take))
                parts.append(take)
                rows += len(take)
                if rows == BLOCK:
                    yield block(first + made, parts)
                    made, parts, rows = made + 1, [], 0
        if rows:
            yield block(first + made, parts)

    return run


def link_blocks(ua: np.ndarray, ub: np.ndarray | None, copies: np.ndarray, axes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and a connected local row for each row of a block (``ub`` None)
    or of two blocks, one after the other."""
    eps = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    u = ua if ub is None else np.concatenate((ua, ub))
    z = u @ axes
    counts, root = np.zeros(len(u), np.int64), np.arange(len(u))
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in boxes:
            boxes[lo, hi] = z[lo:hi].min(0), z[lo:hi].max(0)
        return boxes[lo, hi]

    def merge(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]

    def join(a0: int, a1: int, b0: int, b1: int) -> None:
        if a0 == a1 or b0 == b1:
            return
        (alo, ahi), (blo, bhi) = box(a0, a1), box(b0, b1)
        gap = np.maximum(np.maximum(blo - ahi, alo - bhi), 0)
        if gap @ gap > eps * eps:
            return
        if max(a1 - a0, b1 - b0) <= LEAF:
            hit = u[a0:a1] @ u[b0:b1].T >= cosine
            if a0 == b0:
                np.fill_diagonal(hit, False)
                counts[a0:a1] += hit @ copies[b0:b1]
                hit = np.triu(hit)
            else:
                counts[a0:a1] += hit @ copies[b0:b1]
                counts[b0:b1] += copies[a0:a1] @ hit
            i, j = np.nonzero(hit)
            if len(i):
                merge(i + a0, j + b0)
            return
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if (a0, a1) == (b0, b1):
            for p in ((a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)):
                join(*p)
        elif a1 - a0 <= LEAF:
            join(a0, a1, b0, bm)
            join(a0, a1, bm, b1)
        elif b1 - b0 <= LEAF:
            join(a0, am, b0, b1)
            join(am, a1, b0, b1)
        else:
            for p in ((a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1)):
                join(*p)

    n = len(ua)
    join(0, n, *((0, n) if ub is None else (n, len(u))))
    return counts, root


def _joined(axes: np.ndarray, cosine: float, width: int):
    """Links of a tile: its pairs of blocks, a block with itself included, and their bodies."""

    def run(key: tuple, pairs: pa.Table, bodies: pa.Table) -> pa.Table:
        column = bodies.column("units")
        at = {block: i for i, block in enumerate(bodies.column("block").to_pylist())}
        ids, copies = ([np.frombuffer(x, np.int64) for x in bodies.column(c).to_pylist()] for c in ("ids", "copies"))
        units = [np.frombuffer(column[i].as_buffer(), np.float64).reshape(-1, width) for i in range(len(column))]
        found = []
        for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
            x, y = at[a], at[b]
            both = [x] if a == b else [x, y]
            counts, root = link_blocks(units[x], None if a == b else units[y], np.concatenate([copies[i] for i in both]), axes, cosine)
            some, named = np.flatnonzero(counts), np.concatenate([ids[i] for i in both])
            found.append((named[some], counts[some], named[root[some]]))
        return pa.table([np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 3)], ["id", "links", "other"])

    return run


def _near(alow, ahigh, blow, bhigh, eps: float):
    """Whether two boxes are at most ``eps`` apart, with room for rounding."""
    apart = F.zip_with(F.zip_with(alow, bhigh, lambda x, y: x - y), F.zip_with(blow, ahigh, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda acc, g: acc + g * g) <= eps * eps + 1e-9


def near_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a < b, of blocks that may hold a link: they share or adjoin a cell,
    and the boxes of a pair of their small intervals are near enough. A cell that
    most blocks hold is no task of its own: its right side is dealt to shares."""
    left = blocks.select(F.col("block").alias("a"), F.col("low").alias("alow"), F.col("high").alias("ahigh"), F.explode("around").alias("cell"))
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    right = blocks.select(F.col("block").alias("b"), F.col("low").alias("blow"), F.col("high").alias("bhigh"), F.explode("cells").alias("cell"))
    right = right.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    met = left.join(right, ["cell", "share"]).where("a < b").where(_near("alow", "ahigh", "blow", "bhigh", eps)).select("a", "b").distinct()
    of = F.arrays_zip("lows", "highs")
    x, y = blocks.select(F.col("block").alias("a"), of.alias("x")), blocks.select(F.col("block").alias("b"), of.alias("y"))
    close = F.exists("x", lambda p: F.exists("y", lambda r: _near(p["lows"], p["highs"], r["lows"], r["highs"], eps)))
    return met.join(x, "a").join(y, "b").where(close).select("a", "b")


def numbered(blocks: DataFrame) -> DataFrame:
    """(block, place): places count along the sequence without gaps. The running
    sum goes over one row per partition of the blocks, not over the blocks."""
    part = F.shiftright("block", 32)
    sizes = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    inner = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    return blocks.select("block", part.alias("part"), inner.alias("inner")).join(F.broadcast(before), "part").select("block", (F.col("first") + F.col("inner")).alias("place"))


def tiles(pairs: DataFrame, blocks: DataFrame, side: int) -> DataFrame:
    """``pairs(a, b)`` and each block with itself -> (s, t, a, b): the tile of a pair."""
    place = numbered(blocks).select("block", F.floor(F.col("place") / side).alias("at"))
    every = pairs.unionByName(blocks.select(F.col("block").alias("a"), F.col("block").alias("b")))
    s, t = (place.select(F.col("block").alias(c), F.col("at").alias(name)) for c, name in (("a", "s"), ("b", "t")))
    return every.join(s, "a").join(t, "b").select("s", "t", "a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, a
    row per input row.

    Vectors that are null, zero, empty, or hold null or non-finite components
    link with nothing; a shorter vector counts as filled up with zeros. Repeated
    rows are one vector; equal vectors under different ids are linked copies. A
    null vec_id links with nothing and has a null component. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("embedding"))
    fine = rows.where(valid() & F.col("vec_id").isNotNull())
    width = fine.agg(F.max(F.size("embedding"))).first()[0]
    alone = F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone)
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("embedding")))
    classes = cut(fine.select("vec_id", filled.alias("vector")).distinct().groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column(0)
    axes = axes_of(unit(matrix(sample)))
    eps = float(np.sqrt(max(1e-6, 2 - 2 * cosine)) + 1e-9)
    ordered = classes.select("id", "copies", "vector").mapInArrow(_ordered(axes, eps), "id long, copies long, vector array<double>, code long")
    blocks = cut(
        ordered.repartitionByRange("code", "id")
        .sortWithinPartitions("code", "id")
        .select("id", "copies", "vector")
        .mapInArrow(_blocks(axes, eps), "block long, ids binary, copies binary, units binary, low array<double>, high array<double>, cells array<long>, around array<long>, lows array<array<double>>, highs array<array<double>>")
    )
    pairs = cut(near_pairs(blocks, eps))
    # larger tiles move less, as long as there are several for each core
    many = pairs.count() / (4 * spark.sparkContext.defaultParallelism)
    dealt = cut(tiles(pairs, blocks, max(1, min(SIDE, int(many**0.5)))))
    wanted = dealt.select(F.col("s").alias("u"), F.col("t").alias("v"), F.explode(F.array("a", "b")).alias("block")).distinct()
    bodies = wanted.join(blocks.select("block", "ids", "copies", "units"), "block")
    work = dealt.groupBy("s", "t").cogroup(bodies.groupBy("u", "v"))
    found = cut(work.applyInArrow(_joined(axes, cosine, width), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    facts = classes.join(links, "id", "left").join(roots, "id", "left").select("vector", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    lowest = facts.groupBy("root").agg(F.min("id").alias("component_id"))
    facts = facts.join(lowest, "root").select("vector", "n_links", "component_id")
    keyed = rows.withColumn("vector", F.when(valid() & F.col("vec_id").isNotNull(), filled))
    out = keyed.join(facts, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
