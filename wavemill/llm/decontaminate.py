"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are normalised alike, to lower-cased terms of
letters and digits. Every window of consecutive item terms is a pattern of the
automaton; an item shorter than a window is one pattern. A document is read
once, and the places of all matches are mapped back to its own characters.

The automaton reads numbers of benchmark terms, each written as a few
characters of a base-64 alphabet of its own place, so that its nodes have few
children and a match can begin at a term only.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, prepare, spread
from .terms import ALNUM, code_points, terms
from .textnum import slices, string_parts

#: Patterns of an automaton (some 18 nodes of 32 bytes each); a benchmark of more is
#: matched in several passes over the documents. Terms that are scanned at a time.
PATTERNS, SCANNED = 1 << 17, 1 << 18
BASE = 64
FOUND = "runs array<struct<first: long, last: long, start: long, end: long>>, items array<string>"


def _windows(width: int):
    """(item, pattern) of (item_id as text, text) rows, patterns joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in slices(offsets):
                t = terms(data, offsets[lo : hi + 1], ALNUM)
                if not len(t.row):
                    continue
                last = np.cumsum(t.counts)[t.row]
                begin = np.flatnonzero((np.arange(len(t.row)) + width <= last) | (np.arange(len(t.row)) == last - t.counts[t.row]))
                for some in np.array_split(begin, len(begin) // (1 << 14) + 1):
                    stop = np.minimum(some + width, last[some])
                    size = stop - some
                    at = np.arange(size.sum()) + np.repeat(some - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), t.values.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[lo + r] for r in t.row[some]], pa.string()), pc.binary_join(lists, " ")], ["item", "pattern"])

    return run


class Matcher:
    """An automaton over patterns, and its matches in sequences of terms."""

    def __init__(self, patterns: list[str], items: list[list[str]]) -> None:
        self.items = items
        split = [p.split(" ") for p in patterns]
        self.vocabulary = pa.array(sorted({w for p in split for w in p}), pa.string())
        number = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        self.digits = 1
        while BASE**self.digits < len(number):
            self.digits += 1
        self.sizes = np.array([len(p) for p in split], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(split):
            self.automaton.add_word(self._written(np.array([number[w] for w in p])), i)
        if split:
            self.automaton.make_automaton()

    def _written(self, numbers: np.ndarray) -> str:
        """``numbers`` (-1: no benchmark term) as ``digits`` characters each."""
        out = np.zeros((len(numbers), self.digits), np.uint32)
        rest = np.where(numbers < 0, 0, numbers)
        for d in range(self.digits):
            out[:, d] = np.where(numbers < 0, 1, 2 + BASE * d + rest % BASE)
            rest = rest // BASE
        return out.tobytes().decode("utf-32-le")

    def matches(self, values: pa.StringArray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last term, pattern) of all matches within rows."""
        if not len(self.sizes) or not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = pc.fill_null(pc.index_in(values, value_set=self.vocabulary), -1).to_numpy().astype(np.int64)
        sequence = np.full(len(known) + int(row[-1]) + 1, -1, np.int64)  # a gap before each row
        sequence[np.arange(len(known)) + row] = known
        place = np.flatnonzero(sequence >= 0)
        index = np.full(len(sequence), -1, np.int64)
        index[np.arange(len(known)) + row] = np.arange(len(known))
        ends, found = [], []
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin in range(int(place[0]), int(place[-1]) + 1, SCANNED):
            before = max(0, begin - self.longest + 1)
            for at, pattern in self.automaton.iter(self._written(sequence[before : begin + SCANNED])):
                ends.append(before + at // self.digits)
                found.append(pattern)
        return index[np.array(ends, np.int64)], np.array(found, np.int64)


def _scan(spec):
    """Adds a matcher's findings to (doc_id, text, n_words, runs, items) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*spec.value)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            old_runs, old_items = (batch.column(i).to_pylist() for i in (3, 4))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                t = terms(data, part, ALNUM)
                last, pattern = matcher.matches(t.values, t.row)
                base = np.concatenate(([0], np.cumsum(t.counts)))
                edge = np.zeros(len(t.row) + 1, np.int64)
                np.add.at(edge, last - matcher.sizes[pattern] + 1, 1)
                np.add.at(edge, last + 1, -1)
                for r in range(lo, hi):
                    for x in old_runs[r] or ():
                        edge[base[r - lo] + x["first"]] += 1
                        edge[base[r - lo] + x["last"]] -= 1
                hit = np.cumsum(edge[:-1]) > 0
                new = np.ones(len(hit), bool)
                new[1:] = ~hit[:-1] | (t.row[1:] != t.row[:-1])
                stop = np.ones(len(hit), bool)
                stop[:-1] = new[1:] | ~hit[1:]
                first, final = np.flatnonzero(hit & new), np.flatnonzero(hit & stop)
                owner = t.row[first]
                points = code_points(data[part[0] : part[-1]])
                begins = points[part - part[0]][owner]
                columns = [first - base[owner], final + 1 - base[owner], points[t.start[first]] - begins, points[t.end[final]] - begins]
                runs = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], fields=list(kind.value_type))
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
                items = [set(x or ()) for x in old_items[lo:hi]]
                for r, p in np.unique(np.stack([t.row[last], pattern], 1), axis=0).tolist() if len(last) else ():
                    items[r].update(matcher.items[p])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(t.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "runs", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(doc_id, n_words,
    n_hit, items, spans)``, a row per input row.

    ``spans`` are the (start, end) code points, end exclusive, of the runs of
    terms that lie in an occurrence of ``width`` consecutive terms of an item, or
    of a whole shorter item; ``n_hit`` counts those terms and ``items`` lists the
    ids of the items concerned, as sorted texts. A null text has no terms. An
    item without terms matches nothing; rows of one item_id are one item, an
    item without an id gives hits but no id. Repeated documents are rows of
    their own; an empty table on either side gives no hits. Other columns are
    ignored. Terms of any number are scanned in overlapping stretches. A
    benchmark of over ``PATTERNS`` windows takes one pass for each so many.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    patterns = texts.mapInArrow(_windows(width), "item string, pattern string").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
    patterns = cut(patterns)
    passes = max(1, -(-patterns.count() // PATTERNS))
    found = spread(docs.select("doc_id", "text")).selectExpr("doc_id", "text", "0L n_words", f"CAST(NULL AS {FOUND[5:FOUND.index('>>') + 2]}) runs", "CAST(NULL AS array<string>) items")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, {FOUND}"
    for i in range(passes):
        some = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i).toArrow()
        spec = spark.sparkContext.broadcast((some["pattern"].to_pylist(), some["items"].to_pylist()))
        found = found.mapInArrow(_scan(spec), kind)
        if i < passes - 1:
            found = cut(found)
    spans = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", "n_words", F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"]).alias("n_hit"), "items", spans.alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The findings of ``contamination`` as counts and a digest of the item ids."""
    found = contamination(docs, benchmark)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
