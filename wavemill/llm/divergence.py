"""Divergence of sources by joint count histograms.

For every two sources of a language the kept terms are tallied by their pair of
counts. Only cells in which both counts are above zero come from the terms; the
cells with a zero are implied by the sources' own histograms and by the number
of kept terms, and are added as signed tallies. The divergence term f depends
on a term only through its counts, so it is evaluated once per cell and taken
times the cell's multiplicity. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, prepare, spread
from .terms import LETTERS, terms
from .textnum import slices, string_parts

#: Rows that a task folds together before it sends them on.
HELD = 1 << 19


class _Codes:
    """Numbers for the strings that a task meets."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        found = column.dictionary_encode()
        new = np.array([self.known.setdefault(s, len(self.known)) for s in found.dictionary.to_pylist()], np.int64)
        return new[found.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.int64)

    def names(self) -> pa.Array:
        return pa.array(list(self.known), pa.string())


def _folded(held: list[pa.Table], keys: list[str], sums: list[str]) -> pa.Table:
    """One row for each key, in the order keys, sums."""
    found = pa.concat_tables(held).combine_chunks().group_by(keys, use_threads=False).aggregate([(s, "sum") for s in sums])
    return pa.table([found[k] for k in keys] + [found[f"{s}_sum"] for s in sums], names=[*keys, *sums])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) sums of (lang, source, text) rows."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def sent() -> Iterator[pa.RecordBatch]:
        whole = _folded(held, ["group", "term"], ["n", "docs"])
        names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
        table = pa.table([n.take(whole["group"].combine_chunks()) for n in names] + [whole[c] for c in ("term", "n", "docs")], names=["lang", "source", "term", "n", "docs"])
        yield from table.to_batches(max_chunksize=1 << 16)

    for batch in batches:
        data, offsets = string_parts(batch.column(2))
        group = np.array([groups.setdefault(g, len(groups)) for g in zip(*(batch.column(i).to_pylist() for i in (0, 1)))], np.int64)
        for lo, hi in slices(offsets):
            t = terms(data, offsets[lo : hi + 1], LETTERS)
            if not len(t.row):
                continue
            coded = t.values.dictionary_encode()
            wide, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            in_doc, tf = np.unique(t.row * wide + code, return_counts=True)
            key, at = np.unique(group[lo:hi][in_doc // wide] * wide + in_doc % wide, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, tf)
            docs = np.bincount(at, minlength=len(key))
            held.append(pa.table([pa.array(key // wide), coded.dictionary.take(pa.array(key % wide)), pa.array(n), pa.array(docs)], names=["group", "term", "n", "docs"]))
            if sum(map(len, held)) > HELD:
                held = [_folded(held, ["group", "term"], ["n", "docs"])]
                if len(held[0]) > HELD // 2:
                    yield from sent()
                    held = []
    if held:
        yield from sent()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signed tallies (lang, a, b, ca, cb, m) of (lang, at) rows, ``at`` being a
    term's (source, count) list sorted by source: of each two of its sources the
    cell of both counts, and what the zero cells of the pair lose by it."""
    langs, sources = _Codes(), _Codes()
    keys = ["lang", "a", "b", "ca", "cb"]
    held: list[pa.Table] = []

    def sent() -> Iterator[pa.RecordBatch]:
        both = _folded(held, keys, ["m"])
        zero, less = pa.array(np.zeros(len(both), np.int64)), pc.negate(both["m"])
        lost = [both.set_column(4, "cb", zero).set_column(5, "m", less), both.set_column(3, "ca", zero).set_column(5, "m", less)]
        none = both.set_column(3, "ca", zero).set_column(4, "cb", zero)
        whole = pa.concat_tables([both] + [_folded([t], keys, ["m"]) for t in (*lost, none)])
        names = [langs.names(), sources.names(), sources.names()]
        out = [n.take(whole[k].combine_chunks()) for n, k in zip(names, keys)]
        yield from pa.table(out + [whole[c] for c in ("ca", "cb", "m")], names=[*keys, "m"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(1)
        sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = at.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        lang, source, n = langs.of(batch.column(0))[row], sources.of(flat.field(0)), flat.field(1).to_numpy(zero_copy_only=False)
        for apart in range(1, int(sizes.max())):  # sources that many places apart in a term's list
            i = np.flatnonzero(row[:-apart] == row[apart:])
            j = i + apart
            held.append(pa.table([lang[i], source[i], source[j], n[i], n[j], np.ones(len(i), np.int64)], names=[*keys, "m"]))
            if sum(map(len, held)) > 4 * HELD:
                held = [_folded(held, keys, ["m"])]
                if len(held[0]) > 2 * HELD:
                    yield from sent()
                    held = []
    if held:
        yield from sent()


def _p(count: str, whole: str) -> str:
    """1 + floor(10^9 (count + 1) / whole), past 64 bits where it must be."""
    small = f"(({count} + 1) * 1000000000) div nullif({whole}, 0)"
    large = f"((CAST({count} AS DECIMAL(19, 0)) + 1) * 1000000000) div nullif({whole}, 0)"
    return f"(1 + IF({count} < 9000000000, {small}, {large}))"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``.

    Part ``pair`` ranks for each occurring (lang, source) group the other sources
    of its language, part ``term`` its ``top`` kept terms that it has more of
    than its language. A null text, lang or source is ''; a group without terms
    has counts of zero, and a language without kept terms gives values of zero.
    Every row is a document, repeated rows too. Equal values go by the UTF-8
    bytes of the item. An empty table gives an empty result; other columns are
    ignored. A term's sources and a pair's distinct counts are held together,
    never a group's rows. A text of any length is read whole; it is a slice of
    its own.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = spread(rows).mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    held = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("at"))
    kept = cut(held.where(F.col("docs") >= min_docs).drop("docs"))
    single = kept.select("lang", "term", "total", F.inline("at"))

    # how many kept terms a source has that often; sources, their sums and their languages' sums
    often = cut(single.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    sums = often.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("n"), F.sum("terms").alias("has"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("of_lang"), F.count("*").alias("v"))
    facts = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "has", "of_lang", "v"])
    facts = cut(facts)

    a, b = (facts.select("lang", F.col("source").alias(s), F.col("n").alias(f"n_{s}"), F.col("has").alias(f"has_{s}"), "v") for s in ("a", "b"))
    pairs = a.join(b.drop("v"), "lang").where("a < b")
    others = often.join(facts.select("lang", F.col("source").alias("other")), "lang").where("source <> other")
    zero = others.selectExpr("lang", "least(source, other) a", "greatest(source, other) b", "IF(source < other, n, 0L) ca", "IF(source < other, 0L, n) cb", "terms m")
    nowhere = pairs.selectExpr("lang", "a", "b", "0L ca", "0L cb", "v - has_a - has_b m")
    both = kept.select("lang", "at").mapInArrow(_cells, "lang string, a string, b string, ca long, cb long, m long")
    cells = both.unionByName(zero).unionByName(nowhere).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    cells = cells.join(a.select("lang", "a", "n_a", "v"), ["lang", "a"]).join(b.select("lang", "b", "n_b"), ["lang", "b"])
    cells = cells.selectExpr("lang", "a", "b", "m", f"{_p('ca', 'n_a + v')} p", f"{_p('cb', 'n_b + v')} q")
    valued = cells.groupBy("lang", "a", "b").agg(F.expr(f"sum(m * {_f('p', 'q')})").alias("ab"), F.expr(f"sum(m * {_f('q', 'p')})").alias("ba"))
    valued = pairs.select("lang", "a", "b").join(valued, ["lang", "a", "b"], "left").na.fill(0, ["ab", "ba"])
    pair = valued.selectExpr("lang", "stack(2, a, b, ab, b, a, ba) AS (source, item, value)").withColumn("part", F.lit("pair"))

    term = single.join(facts.select("lang", "source", F.col("n").alias("whole"), "of_lang", "v"), ["lang", "source"])
    term = term.selectExpr("lang", "source", "term item", f"{_p('n', 'whole + v')} p", f"{_p('total', 'of_lang + v')} q").where("p > q")
    term = term.selectExpr("lang", "source", "item", f"{_f('p', 'q')} value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pair = pair.withColumn("rank", F.row_number().over(order))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")
