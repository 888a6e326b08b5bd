"""N-gram Jaccard join by parity sketches.

A text's set is its distinct n-word shingles. Every shingle flips one bit of a
wide sketch, so two sketches differ in at most as many bits as the sets'
symmetric difference. Texts are compared within bands of set size; in a band
the largest difference allowed by the threshold is k, the sketch is cut into
more than k parts, and so by the pigeonhole principle two linked texts agree in
a part. A part is kept as the XOR of a hash per odd bit, equal when the parts'
bits are equal, and parts are joined on it. Candidates are then verified on the
shingles themselves.

No pairs are made within a group of equal parts: each member is compared with
the group's leader, links are merged into components, and only pairs that share
a leader, lie in different components, and are not excluded by the triangle
inequality on the Jaccard distance or by the Hamming distance of whole sketches
are compared in a second step, in tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, prepare, spread
from .components import components
from .textnum import mix64, shingle_sets, slices, string_parts, words

#: Rows of a tile in the second step, on average, and shares a leader's group is dealt in.
TILE, SALTS = 512, 32
#: Bytes of a shingle in a set.
GRAM = 7

_POSITION = np.uint64((1 << 24) - 1)
_SEEDS = [np.uint64(0x51ED270B7F4A7C15 + 0x9E3779B97F4A7C15 * j & (1 << 64) - 1) for j in range(8)]


def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band starts, and per band b the bound k and the number of parts for pairs
    whose smaller set is in band b. A set at least num/den of another in size is
    in the same band or the one before."""
    starts = [1, 2]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * den // num + 1))
    starts.append(max(starts[-1] + 1, (starts[-1] - 1) * den // num + 1))
    k, parts = [], []
    for b in range(len(starts) - 2):
        bound = (starts[b + 1] + starts[b + 2] - 2) * (den - num) // (den + num)
        p = bound + 1
        while p - bound <= 1.3 * p * math.exp(-starts[b] / p) and p < 2 * bound:
            p += 1  # more parts than bound + expected empty ones
        k.append(bound)
        parts.append(p)
    return np.array(starts[:-2]), np.array(k), np.array(parts)


def sketch_keys(row: np.ndarray, value: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit key) of every sketch part to join on.

    Parts without an odd bit are left out where a text has fewer of them than
    it must have equal parts. A text with more of them is sketched again with
    the next seed, and after the last seed those parts are kept too; a pair in
    which both texts came that far still meets.
    """
    starts, bound, parts = bands(num, den, int(size.max(initial=1)))
    band = np.searchsorted(starts, size, "right") - 1
    out_rows, out_keys = [], []
    for back in (0, 1):
        group = band - back
        todo = (size > 0) & (group >= 0)
        for j, seed in enumerate(_SEEDS):
            if not todo.any():
                break
            p = np.where(todo, parts[np.maximum(group, 0)], 0)
            base = np.concatenate(([0], np.cumsum(p)))
            use = todo[row]
            r, h = row[use], mix64(value[use] ^ seed)
            part = (h >> np.uint64(32)) % p[r].astype(np.uint64)
            bit = mix64(((part << np.uint64(24)) | (h & _POSITION)) + seed)
            sketch = np.zeros(base[-1], np.uint64)
            np.bitwise_xor.at(sketch, base[r] + part.astype(np.int64), bit)
            owner = np.repeat(np.arange(len(size)), p)
            empty = np.bincount(owner[sketch == 0], minlength=len(size))
            poor = todo & (empty >= p - bound[np.maximum(group, 0)])
            keep = (sketch != 0) | (poor[owner] if j == len(_SEEDS) - 1 else False)
            at = np.arange(base[-1]) - base[owner]
            tag = (group[owner].astype(np.uint64) << np.uint64(40)) | (np.uint64(j) << np.uint64(36)) | at.astype(np.uint64)
            key = mix64(sketch ^ mix64(tag))
            out_rows.append(owner[keep])
            out_keys.append(key[keep])
            todo = poor
    return np.concatenate(out_rows) if out_rows else np.zeros(0, np.int64), np.concatenate(out_keys) if out_keys else np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of a (doc_id, text) batch: bounds, rows, values, sizes, set hashes."""
    data, offsets = string_parts(batch.column(1))
    for lo, hi in slices(offsets):
        row, value = shingle_sets(words(data, offsets[lo : hi + 1]), n)
        size = np.bincount(row, minlength=hi - lo)
        node = np.zeros(hi - lo, np.uint64)
        if len(row):
            first = np.searchsorted(row, np.flatnonzero(size))
            node[size > 0] = mix64(np.add.reduceat(mix64(value + np.uint64(0x1234567)), first) + size[size > 0].astype(np.uint64))
        yield lo, hi, row, value, size, node


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _, size, node in _sets(batch, n):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64), mask=size == 0)],
                    ["doc_id", "n_shingles", "node"],
                )

    return run


def _keys(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, value, size, node in _sets(batch, n):
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True  # exact copies in the slice send one sketch
                use = first[row]
                owner, key = sketch_keys(row[use], value[use], np.where(first, size, 0), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[owner].view(np.int64))], ["key", "node"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, member) of runs of equal keys in rows sorted by key and node; it
    streams, so a run may have any length."""
    key_now = leader = None
    for batch in batches:
        key, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        new = np.concatenate(([key_now is None or key[0] != key_now], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        head = np.where(start >= 0, node[np.maximum(start, 0)], node[0] if leader is None else leader)
        key_now, leader = key[-1], head[-1]
        other = np.unique(np.stack([head, node], 1)[head != node], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(other[:, 0]), pa.array(other[:, 1])], ["a", "b"])


def packed(values: np.ndarray) -> bytes:
    """Shingles as their ``GRAM`` low bytes, which hold all of a 52-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // GRAM, 8), np.uint8)
    out[:, :GRAM] = np.frombuffer(data, np.uint8).reshape(-1, GRAM)
    return out.view("<u8").ravel()


def _packed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, value, size, node in _sets(batch, n):
                ends = np.cumsum(size)
                grams = [packed(value[e - s : e]) for s, e in zip(size, ends)]
                folds = [fold_sketch(value[e - s : e]).tobytes() for s, e in zip(size, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64), mask=size == 0), pa.array(grams, pa.binary()), pa.array(folds, pa.binary())], ["node", "grams", "sketch"])

    return run


def fold_sketch(value: np.ndarray) -> np.ndarray:
    """A parity sketch of at least two bits a shingle, as 64-bit words. Its length
    is a power of two, so a longer sketch folds onto a shorter one by XOR."""
    n_words = 1 << max(2, math.ceil(math.log2(max(1, len(value)) / 32)) if len(value) > 32 else 2)
    h = mix64(value ^ np.uint64(0xA5A5A5A55A5A5A5A))
    sketch = np.zeros(n_words, np.uint64)
    np.bitwise_xor.at(sketch, ((h >> np.uint64(6)) & np.uint64(n_words - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return sketch


def _tile_pairs(num: int, den: int):
    """Pairs of a tile that the sizes, the triangle inequality and the sketches
    leave open, of rows sorted by (leader, ti, tj). A tile's rows are bounded."""

    def near(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        node, root, size, own = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2, 4))
        d = np.array([np.nan if r[3] is None else r[3] for r in rows])
        sketches = [np.frombuffer(r[5], np.uint64) for r in rows]
        width = min(map(len, sketches))
        bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), 0) for x in sketches])
        across = own.min() != own.max()
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            ok = (root[j] != root[i]) & (size[j] * den >= size[i] * num) & (size[i] * den >= size[j] * num) & ~(np.abs(d[j] - d[i]) > (den - num) / den + 1e-9)
            j = j[ok & (own[j] != own[i])] if across else j[ok]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
                for x in j[apart.astype(np.int64) * (den + num) <= (size[j] + size[i]) * (den - num)]:
                    yield min(node[i], node[x]), max(node[i], node[x])

    def emit(found: set) -> pa.RecordBatch:
        a, b = (np.array([p[c] for p in found], np.int64) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, found = None, [], set()
        for batch in batches:
            for leader, ti, tj, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != (leader, ti, tj):
                    if len(rows) > 1:
                        found.update(near(rows))
                    tile, rows = (leader, ti, tj), []
                rows.append(row)
            if len(found) > 100_000:
                yield emit(found)
                found = set()
        if len(rows) > 1:
            found.update(near(rows))
        yield emit(found)

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            both = np.concatenate((unpacked(x), unpacked(y)))
            both.sort()
            got.append((len(x) // GRAM, len(y) // GRAM, int((both[1:] == both[:-1]).sum())))
        na, nb, both = (np.array(c, np.int64) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(na), pa.array(nb), pa.array(both)], ["a", "b", "na", "nb", "common"])


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)``, a row per input row.

    Texts link when their shingle sets' Jaccard similarity is at least num/den;
    component_id is the smallest doc_id reachable by links. A null text is
    empty; an empty set links with nothing. Rows that share a doc_id are one
    document and have one component, each row with its own n_shingles; a link of
    any of their texts is one of theirs. A null doc_id keeps a null component and links with nothing.
    Columns besides doc_id and text are ignored.
    """
    prepare(docs.sparkSession)
    docs = spread(docs.select("doc_id", "text"))
    signed = cut(docs.mapInArrow(_signatures(n), "doc_id long, n_shingles long, node long"))
    known = docs.where("doc_id is not null and text is not null")
    # rows of one doc_id are one document, whatever their texts: few, if any
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("node").alias("own")).where("rows > 1 AND own IS NOT NULL")
    several = cut(several.select("doc_id", "own"))
    signed = signed.join(several, "doc_id", "left")
    joined = signed.where("node <> own").select(F.col("own").alias("a"), F.col("node").alias("b")).distinct()
    signed = signed.select("doc_id", "n_shingles", F.coalesce("node", "own").alias("node"))

    def keys(of: DataFrame) -> DataFrame:
        return of.mapInArrow(_keys(n, num, den), "key long, node long")

    def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
        y = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        both = pairs.join(y, "b").join(x, "a").select("a", "b", "ga", "gb")
        return cut(both.mapInArrow(_common, "a long, b long, na long, nb long, common long"))

    linked = F.col("common") * (num + den) >= (F.col("na") + F.col("nb")) * num
    stars = keys(known).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a long, b long")
    pairs = cut(stars.distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # one text of each candidate set, found by its smallest doc_id
    chosen = signed.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node")
    texts = known.join(chosen.select("doc_id").distinct(), "doc_id")  # used once
    sets = texts.mapInArrow(_packed(n), "node long, grams binary, sketch binary").where("node is not null").dropDuplicates(["node"])
    sets = cut(sets.join(nodes, "node", "left_semi"))
    checked = compared(pairs, sets)
    roots = components(checked.where(linked).select("a", "b").unionByName(joined))

    # Texts that share a part share its leader, so pairs left open are within a
    # leader's group; groups in one component are done.
    size = sets.select("node", "sketch", (F.length("grams") / GRAM).cast("long").alias("size"))
    facts = size.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "size", "sketch", F.coalesce("root", "node").alias("root"))
    distance = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    group = checked.select(F.col("a").alias("leader"), F.col("b").alias("node"), distance.alias("d"))
    group = group.unionByName(checked.select(F.col("a").alias("leader"), F.col("a").alias("node"), F.lit(0.0).alias("d")).distinct())
    rooted = group.join(facts.select("node", "root"), "node")
    mixed = (
        rooted.groupBy("leader")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi")
        .select("leader", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    )
    # a large group is dealt to pairs of bounded tiles; a leader may have any share of
    # all rows, so its members meet the number of tiles in salted shares
    salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    share = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    member = group.withColumn("salt", share).join(salted, ["leader", "salt"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = member.join(facts, "node").select("leader", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "node", "root", "size", "d", "own", "sketch")
    rest = (
        tiles.repartition("leader", "ti", "tj")
        .sortWithinPartitions("leader", "ti", "tj")
        .mapInArrow(_tile_pairs(num, den), "a long, b long")
        .distinct()
        .join(checked.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = compared(rest, sets).where(linked).select("a", "b")
    if not more.isEmpty():
        roots = components(checked.where(linked).select("a", "b").unionByName(more).unionByName(joined))
    placed = signed.join(roots.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    lowest = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(lowest, "root", "left")
    return out.select("doc_id", "n_shingles", F.expr("case when doc_id is not null then coalesce(component_id, doc_id) end").alias("component_id"))
