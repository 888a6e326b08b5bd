"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents become pieces of at most ``size`` tokens. How pieces share sequences
depends on their lengths alone, so the bins are planned on the histogram of
lengths, which has at most ``size`` rows whatever the input: bin completion
takes the largest length left, enumerates the undominated fillings of the rest
of its bin, and branches on them, pruning by the waste that an improvement could
still afford; best-fit decreasing gives the first incumbent, and every dive's
best-fit completion may replace it. The plan, patterns with how often each is
used, is bounded too and goes to the executors, where each piece finds its place
from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, prepare, spread
from .textnum import IS_WORD, LOWER, Words, slices, string_parts, words

Plan = list[tuple[tuple[int, ...], int]]  # (lengths in a bin, number of such bins)


# -- planning on the histogram ---------------------------------------------------


def best_fit_decreasing(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing on a histogram: each length goes to the fullest bins
    that it fits, many bins at a time."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> contents -> bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                per = size // length
                whole, rest = divmod(left, per)
                for n, k in ((whole, per), (1, rest)):
                    if n and k:
                        group = bins.setdefault(size - k * length, {})
                        group[(length,) * k] = group.get((length,) * k, 0) + n
                break
            contents, n = bins[room].popitem()
            k = min(room // length, max(1, left // n))
            use = min(n, left // k)
            if use < n:
                bins[room][contents] = n - use
            if not bins[room]:
                del bins[room]
            group = bins.setdefault(room - k * length, {})
            key = contents + (length,) * k
            group[key] = group.get(key, 0) + use
            left -= use * k
    return [(c, n) for group in bins.values() for c, n in group.items()]


def fillings(counts: dict[int, int], lengths: list[int], room: int, effort: int, keep: int) -> list[tuple[int, ...]]:
    """Undominated multisets of ``lengths`` (descending) that fill ``room``, least
    waste first. A filling is dominated if one of its pieces could be replaced by
    a longer one left out, or if another piece still fits."""
    found: dict[tuple[int, ...], int] = {}
    budget = effort

    def grow(at: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal budget
        if budget <= 0:
            return
        budget -= 1
        placed = False
        k = at
        while k < len(lengths):
            length = lengths[k]
            if length <= left and counts[length] - chosen.count(length) > 0:
                placed = True
                grow(k, left - length, chosen + (length,))
                if budget <= 0 or (found and min(found.values()) == 0 and len(found) >= keep):
                    return
            k += 1
        if not placed and not any(length <= left and counts[length] > chosen.count(length) for length in lengths):
            for a in set(chosen):
                if any(a < b <= a + left and counts[b] > chosen.count(b) for b in lengths):
                    return
            found[chosen] = left

    grow(0, room, ())
    return sorted(found, key=lambda c: (found[c], len(c)))[:keep]


def bin_completion(counts: dict[int, int], size: int, effort: int = 400, keep: int = 3, nodes: int = 4000) -> Plan:
    """Packs a histogram of lengths into few bins: branch and bound over fillings.

    ``effort`` bounds the steps of one enumeration, ``keep`` the branches of a
    node and ``nodes`` the whole search; they bound time, never what is packed.
    A search cut short returns its incumbent, which is at least as good as
    best-fit decreasing.
    """
    counts = {k: int(v) for k, v in counts.items() if v > 0}
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    incumbent = best_fit_decreasing(counts, size)
    best = sum(n for _, n in incumbent)
    floor = max(-(-total // size), sum(v for k, v in counts.items() if 2 * k > size))
    left_nodes = nodes

    # one histogram and one plan, changed and changed back: a search is thousands of
    # bins deep, and copies of both in each would be most of the driver's memory
    left, plan = dict(counts), []

    def dive(used: int, waste: int) -> None:
        nonlocal incumbent, best, left_nodes
        if not left:
            if used < best:
                incumbent, best = list(plan), used
            return
        # an improvement has at most best - 1 bins, hence at most this much waste
        if best == floor or left_nodes <= 0 or waste > (best - 1) * size - total:
            return
        left_nodes -= 1
        if left_nodes % 64 == 0:
            rest = best_fit_decreasing(left, size)
            if used + sum(n for _, n in rest) < best:
                incumbent, best = plan + rest, used + sum(n for _, n in rest)
            del rest
        top = max(left)
        left[top] -= 1
        found = fillings(left, [k for k in sorted(left, reverse=True) if left[k] > 0], size - top, effort, keep)
        left[top] += 1
        for filling in found or [()]:
            contents = (top,) + filling
            need = {k: contents.count(k) for k in set(contents)}
            times = max(1, min(left[k] // n for k, n in need.items()))
            for k, n in need.items():
                left[k] -= times * n
                if not left[k]:
                    del left[k]
            plan.append((contents, times))
            dive(used + times, waste + times * (size - sum(contents)))
            plan.pop()
            for k, n in need.items():
                left[k] = left.get(k, 0) + times * n
            if best == floor or left_nodes <= 0:
                return

    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 50_000))
    try:
        dive(0, 0)
    finally:
        sys.setrecursionlimit(limit)
    return incumbent


def plan_rows(plan: Plan) -> pd.DataFrame:
    """The plan as intervals: pieces of ``length`` with ranks from ``rank`` on go,
    ``per`` to a bin, to bins from ``bin`` on, at ``offset``."""
    rows, first, taken = [], 0, {}
    for contents, n in plan:
        offset = 0
        for length in sorted(set(contents), reverse=True):
            per = contents.count(length)
            rows.append((length, taken.get(length, 0), per, first, offset))
            taken[length] = taken.get(length, 0) + per * n
            offset += per * length
        first += n
    return pd.DataFrame(rows, columns=["length", "rank", "per", "bin", "offset"]).sort_values(["length", "rank"], ignore_index=True)


# -- Spark stages -------------------------------------------------------------------


#: Units whose ids a Python worker keeps.
CACHE = 4_000_000
#: The normalizer and pre-tokenizer under which texts may be cut into units.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ALNUM, _MARK = np.zeros(256, bool), np.ones(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[128:] = False
_MARK &= ~_ALNUM & IS_WORD
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def splits_words(path: str) -> bool:
    """Whether a tokenizer file drops white space, lower-cases and ends tokens at
    the borders that :class:`UnitIds` cuts at."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    first = pre[0].get("pattern", {}).get("Regex") == SPLIT and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
    bytewise = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    whole = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
    return bool(spec["normalizer"] == NORMALIZER and first and bytewise and whole and spec["model"].get("end_of_word_suffix") == "</w>")


class UnitIds:
    """Token ids of texts, unit by unit, with the ids of known units kept.

    White space always ends a token, and so does the change from an ASCII letter or
    digit to the ASCII marks that end a run. A unit is thus a run of non-space bytes
    without its last marks, or those marks; its ids are those of its lower case. Runs
    with a combining mark (which could join a capital before it is lower-cased) or
    with ``<|`` (maybe a special token) are units as they are. Units are known by a
    64-bit hash. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_unit = splits_words(path)
        if self.by_unit:
            vocabulary = self.tok.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and their numbers. Units of plain letters
        are single pre-tokens, so they are encoded many at a time and told apart by
        their last tokens."""
        texts = [u.decode("utf-8", "replace") for u in units]
        plain = np.array([_PLAIN.fullmatch(t) is not None for t in texts], bool)
        words = [t for t, p in zip(texts, plain) if p]
        lines = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        joined = np.fromiter((i for e in self.tok.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids), np.uint32)
        stops = np.flatnonzero(self.ends[joined]) + 1
        others = [e.ids for e in self.tok.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)]
        size = np.zeros(len(units), np.int64)
        size[plain] = np.diff(stops, prepend=0)
        size[~plain] = [len(x) for x in others]
        ids = np.zeros(size.sum(), np.uint32)
        of_plain = np.repeat(plain, size)
        ids[of_plain] = joined
        ids[~of_plain] = [i for x in others for i in x]
        return ids, size

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        ids, size = self.encode(units)
        first = len(self.pool) + np.cumsum(size) - size
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.size = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first), np.insert(self.size, at, size)
        self.pool = np.concatenate((self.pool, ids))

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        w = words(data, offsets, lower=False)
        low = LOWER[w.buf]
        held = np.flatnonzero((w.buf[:-1] == 60) & (w.buf[1:] == 124) | (w.buf[:-1] & 0xFE == 0xCC))
        rare = np.unique(np.searchsorted(w.start, held, "right") - 1)
        for i in rare:
            low[w.start[i] : w.end[i]] = w.buf[w.start[i] : w.end[i]]
        cut = w.end.copy()
        open_ = np.flatnonzero(_MARK[w.buf[w.end - 1]])
        for _ in range(32):  # runs with more marks are units as they are
            cut[open_] -= 1
            open_ = open_[cut[open_] > w.start[open_]]
            open_ = open_[_MARK[w.buf[cut[open_] - 1]]]
        cuts = (cut > w.start) & (cut < w.end) & _ALNUM[w.buf[np.maximum(cut - 1, 0)]] if len(w.end) else np.zeros(0, bool)
        cuts[rare] = False
        n = 1 + cuts
        row, start, end = np.repeat(w.row, n), np.repeat(w.start, n), np.repeat(w.end, n)
        tails = (np.cumsum(n) - 1)[cuts]
        start[tails] = end[tails - 1] = cut[cuts]
        return Words(low, w.offsets, start, end, row, np.bincount(row, minlength=len(w.counts)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and the number of each text's."""
        if not self.by_unit:
            found = [e.ids for e in self.tok.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.uint32), np.array([len(x) for x in found], np.int64)
        u = self.units(data, offsets)
        hashes = u.hashes()
        order = np.argsort(hashes)
        ranked = hashes[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
        distinct, where = ranked[first], order[first]
        if len(self.hashes) > CACHE:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            raw = u.buf.tobytes()
            self.learn(distinct[new], [raw[s:e] for s, e in zip(u.start[where[new]].tolist(), u.end[where[new]].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        of = np.zeros(len(order), np.int64)
        of[order] = at[np.cumsum(first) - 1]
        size = self.size[of].astype(np.int64)
        before = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.first[of] - before, size) + np.arange(size.sum())]
        return ids, np.bincount(u.row, size, len(offsets) - 1).astype(np.int64)


@lru_cache(maxsize=2)
def _unit_ids(path: str) -> UnitIds:
    return UnitIds(path)


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _unit_ids(path)
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for lo, hi in slices(offsets):
                ids, counts = ids_of(data, offsets[lo : hi + 1], batch.column(1).slice(lo, hi - lo))
                ends = np.cumsum(counts + 1)
                packed = np.full(len(ids) + hi - lo, end_id, "<u4")
                inner = np.ones(len(packed), bool)
                inner[ends - 1] = False
                packed[inner] = ids
                total = counts + 1
                pieces = -(-total // size)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
                start = piece * size
                length = np.minimum(total[row] - start, size)
                at = ((ends - total)[row] + start) * 4
                view = memoryview(packed.tobytes())
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the rank among its rows of equal length, of rows sorted by length."""
    from pyspark import TaskContext

    part, now, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        length = b.column(3).to_numpy()
        if not len(length):
            continue
        place = np.arange(len(length))
        run = np.maximum.accumulate(np.where(np.concatenate(([True], length[1:] != length[:-1])), place, 0))
        rank = place - run + np.where((run == 0) & (length[0] == now), seen, 0)
        now, seen = length[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(rank.astype(np.int64))], [*b.schema.names, "part", "rank"])


def _place(plan: pd.DataFrame):
    table = {c: plan[c].to_numpy(np.int64) for c in plan.columns}
    codes = table["length"] * (1 << 48) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(codes, length * (1 << 48) + rank, "right") - 1
            nth = rank - table["rank"][at]
            per = table["per"][at]
            sequence = table["bin"][at] + nth // per
            offset = table["offset"][at] + nth % per * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end_id``; only longer ones than ``size``
    are cut. A null or empty text is one piece of one token. Repeated rows and
    repeated or null doc_ids are packed as rows of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    row = "doc_id long, piece int, start long, length long, ids_crc32 long"
    found = cut(spread(docs.select("doc_id", "text")).mapInArrow(_pieces(tokenizer, size, end_id), row))
    # sorted partitions hold few lengths each, so the table of their counts stays small
    sorted_ = found.repartitionByRange("length", F.xxhash64("doc_id", "piece")).sortWithinPartitions("length")
    pieces = cut(sorted_.mapInArrow(_ranked, f"{row}, part int, rank long"))
    by_part = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    lengths = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `size` rows
    plan = plan_rows(bin_completion({r.length: r.n for r in lengths}, size))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
