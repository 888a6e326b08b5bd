"""Ranked lexical search through hierarchical max trees.

Documents are read into shards. In a shard the documents lie in an order that
brings those with the same rarest query term together; ranges of ``FAN``
documents are nodes, ranges of ``FAN`` nodes are nodes of the next level, and
every node keeps for each term the highest impact within its range. A query adds
up its terms' entries of a node to a bound on all documents below. It opens
nodes from the highest bound down, until no bound reaches its k-th score; nodes
whose bound equals that score are opened, for they may hold a smaller doc_id.

All scores are 64-bit integers, so equal scores are found as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, prepare, spread
from .terms import ALNUM, terms
from .textnum import slices, string_parts

#: Children of a node, postings of a shard (about 100 bytes each at the peak), and
#: (item, term) entries that are searched together; more items take more passes.
FAN, SHARD, ENTRIES = 16, 1 << 20, 1 << 20


def _counted(vocabulary=None):
    """(id, n, terms, tfs) of (id, text) rows with at least one term: the number of
    terms, and the distinct ones with their occurrences. With a vocabulary only its
    terms are listed, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else pa.array(vocabulary.value, pa.string())
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for lo, hi in slices(offsets):
                t = terms(data, offsets[lo : hi + 1], ALNUM)
                if known is None:
                    coded = t.values.dictionary_encode()
                    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                else:
                    names, code = known, pc.fill_null(pc.index_in(t.values, value_set=known), -1).to_numpy().astype(np.int64)
                wide, listed = max(1, len(names)), code >= 0
                key, tf = np.unique(t.row[listed] * wide + code[listed], return_counts=True)
                has = np.flatnonzero(t.counts)
                ends = np.searchsorted(key, np.concatenate(([0], (has + 1) * wide)))
                bounds, number = pa.array(ends, pa.int32()), pa.array(key % wide, pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, number if known is not None else names.take(number)), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64)))]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(t.counts[has].astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])

    return run


class MaxTree:
    """A shard's levels, from documents up. Level l has ``ptr[l]``: where a node's
    entries begin in ``term[l]`` and ``most[l]``, which lie in the order of nodes."""

    def __init__(self, ids: list, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, rarity: np.ndarray, wide: int) -> None:
        """Documents of ``sizes`` (above 0) entries each; ``rarity`` orders the terms."""
        begin = np.concatenate(([0], np.cumsum(sizes)))
        rarest = np.maximum.reduceat(rarity[term] * wide + term, begin[:-1])
        order = np.lexsort((sizes, -rarest))
        self.ids = [ids[i] for i in order]
        at = np.arange(len(term)) + np.repeat(begin[order] - np.concatenate(([0], np.cumsum(sizes[order])[:-1])), sizes[order])
        self.ptr, self.term, self.most = [np.concatenate(([0], np.cumsum(sizes[order])))], [term[at]], [impact[at]]
        node = np.repeat(np.arange(len(sizes)), sizes[order])
        while len(self.ptr[-1]) > 2:
            key = node // FAN * wide + self.term[-1]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            self.most.append(np.maximum.reduceat(self.most[-1][by], first))
            self.term.append(key[first] % wide)
            node = key[first] // wide
            self.ptr.append(np.searchsorted(node, np.arange(int(node[-1]) + 2)))

    def sums(self, level: int, lo: int, hi: int, weight: np.ndarray) -> np.ndarray:
        """The bounds (level 0: scores) of nodes lo to hi."""
        p = self.ptr[level][lo : hi + 1]
        part = slice(p[0], p[-1])
        return np.add.reduceat(weight[self.term[level][part]] * self.most[level][part], p[:-1] - p[0])

    def search(self, weight: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        """``best``, the k first (-score, id is null, id) so far in order, with those of this shard."""
        top = len(self.ptr) - 1
        heap = [(-int(self.sums(top, 0, 1, weight)[0]), top, 0)]
        while heap:
            floor = max(1, -best[k - 1][0] if len(best) >= k else 1)
            bound, level, node = heappop(heap)
            if -bound < floor:
                break
            if level == 0:  # a shard of one document
                found = [(bound, node)]
            else:
                lo = node * FAN
                hi = min(lo + FAN, len(self.ptr[level - 1]) - 1)
                value = self.sums(level - 1, lo, hi, weight)
                found = [(-int(value[i]), lo + int(i)) for i in np.flatnonzero(value >= floor)]
            if level <= 1:
                if found:
                    best = sorted(best + [(s, self.ids[i] is None, self.ids[i] or 0) for s, i in found])[:k]
            else:
                for s, i in found:
                    heappush(heap, (s, level - 1, i))
        return best


def _search(spec, k: int):
    """Each task's k best documents of each item, from (id, n, terms, tfs) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, length, weight, items = spec.value
        best: list[list[tuple]] = [[] for _ in items]
        held: list[tuple] = []

        def shard() -> None:
            ids = [i for h in held for i in h[0]]
            n, sizes, term, tf = (np.concatenate([h[c] for h in held]) for c in (1, 2, 3, 4))
            m = 100 - 25 + (25 * n * count) // length
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
            tree = MaxTree(ids, sizes, term, impact, weight, len(weight))
            times = np.zeros(len(weight), np.int64)
            for q, (_, own, repeats) in enumerate(items):
                times[own] = repeats
                best[q] = tree.search(times, k, best[q])
                times[own] = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            held.append((batch.column(0).to_pylist(), batch.column(1).to_numpy(), sizes, batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()))
            if sum(len(h[3]) for h in held) >= SHARD:
                shard()
                held = []
        if held:
            shard()
        rows = [(items[q][0], None if null else i, -s) for q, found in enumerate(best) for s, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(item_id, rank,
    doc_id, score)``: each item's k documents of the highest score above 0.

    Equal scores go by ascending doc_id, documents without an id last. Every row
    of ``docs`` is a document, repeated rows too. Null texts have no terms;
    documents without terms count nowhere. Distinct texts of one item_id, null
    among them, are one item with the terms of all; a repeated item row counts
    once, and an item without terms or without matches has no row. An empty
    table on either side gives an empty result; other columns are ignored.
    Only the items' terms are indexed; all documents and all their terms count
    in the statistics.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    single = benchmark.selectExpr("CAST(item_id AS BIGINT) item_id", "text").where("text is not null").distinct().mapInArrow(_counted(), "id long, n long, terms array<string>, tfs array<long>")
    single = single.select(F.col("id").alias("item_id"), F.inline(F.arrays_zip("terms", "tfs"))).groupBy("item_id", "terms").agg(F.sum("tfs").alias("tf"))
    single = cut(single.withColumnRenamed("terms", "term"))
    out = None
    passes = max(1, -(-single.count() // ENTRIES))
    rows = spread(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").where("text is not null"))
    for i in range(passes):
        some = single.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).orderBy("item_id", "term").toArrow()
        vocabulary = some["term"].unique().to_pylist()
        number = {t: j for j, t in enumerate(vocabulary)}
        index = cut(rows.mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)), "id long, n long, terms array<int>, tfs array<long>"))
        count, length = index.agg(F.count("*"), F.sum("n")).first()
        held_by = index.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.zeros(max(1, len(vocabulary)), np.int64)
        for row in held_by.selectExpr("term", f"CAST(floor(1000 * ln((2 * {count}L + 2) / (2 * count + 1))) AS BIGINT) w").collect():
            weights[row.term] = row.w
        items: dict = {}
        for item, term, tf in zip(*(some[c].to_pylist() for c in ("item_id", "term", "tf"))):
            items.setdefault(item, ([], []))
            items[item][0].append(number[term])
            items[item][1].append(tf)
        spec = spark.sparkContext.broadcast((count, length, weights, [(item, np.array(own), np.array(times)) for item, (own, times) in items.items()]))
        found = index.where(F.size("terms") > 0).mapInArrow(_search(spec, k), "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
