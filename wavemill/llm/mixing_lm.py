"""Language-model scoring by logistic context mixing.

A text is its lower-cased words, each ended by a mark, and an end. Texts fall in
a few classes (languages, say) by their byte pairs. The classes are fitted on all
training texts, added up by their commonest pairs; class counts cover them all. Within a word, every bit is predicted from several contexts:

* all of the word so far, in the class and in all classes: exact counts, taken
  from the sorted list of distinct words, where a prefix is an interval;
* the one to four bytes before in the class: counts in hashed tables.

A mixer adds the stretched predictions with weights that are gated by the bit's
place and by how much the contexts have seen, and an adaptive map refines the
sum. Weights and map are learned online in every block of words from all bits of
all training words, as often as they occur, each word's count taken without the
occurrence at hand, and averaged. This gives what a word
costs in each class, once for all texts.

A text is then scored in order: the classes are mixed by what the words before
have cost in them, and with the words that the text has used already, so
context is carried over all of the text and weights keep adapting within it.

Last comes a context over word borders: what followed the word before in training
texts. Counts of hashed word pairs cover all of them. Every chunk of texts asks
for its distinct pairs, in parts by their hashes; a part adds up what all chunks
have counted and answers. The pairs' share in the mix is gated by how many pairs
in a row were known and by how often the word before was seen, and is refined in
every text as it is scored. A training text is judged without its own pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop, prepare, remainder, spread
from .textnum import lowered, mix64, slices, string_parts, words

#: Classes of texts, features that classes are told by, and groups of texts that they are fitted on.
CLASSES, FEATURES, GROUPS = 4, 256, 4096
#: Hashed tables: bytes before, and binary logarithms of the slots of each, least and most.
ORDERS, LEAST, MOST = (1, 2, 3, 4), (14, 15, 16, 16), (16, 18, 19, 20)
#: Longest piece of a word, words of a block, slots sent in one row, text bytes of a chunk.
PIECE, BLOCK, SENT, CHUNK_BYTES = 48, 1 << 14, 1 << 14, 32 << 20
#: Text bytes handled at a time, such bytes where words are listed, and compressed bytes of
#: a chunk whose words are listed at once.
SLICE, LISTED_SLICE, LISTED = 1 << 18, 1 << 19, 16 << 20
#: Compression level of texts on their way to chunks.
PACKED = 3
#: Costs travel as 16-bit numbers of this part of a bit, up to 2,047 bits a piece.
BIT_PART = 32
#: Different bits that weights are learned on at a time, in steps of so many, and how
#: often a bit may occur to count in one step; bits after which the pace is low; parts in
#: which what tasks have learned is added up.
LEARNED, STEP, TIMES, PACED, LEARNED_PARTS = 1 << 19, 4096, 64, 2_000_000, 32
#: Words before that tell a text's class; weight of the words used already before any is seen.
WINDOW, CACHE_WEIGHT = 32, 0.1
#: Bytes handled at a time of words that begin like no other.
ALONE = 512
#: Word pairs: bits of their hashes, pairs held before they are sent, pairs sorted at a time,
#: text bytes of a part, their share at first after 0, 1, 2 and more known pairs, and how many
#: words it is worth.
PAIR_BITS, PAIRS_HELD, PAIRS_SORTED, PAIR_BYTES = 40, 1 << 21, 1 << 17, 8 << 20
PAIR_SHARE, PAIR_WORTH = np.array([0.1, 0.3, 0.5, 0.7]), 4
#: Marks, none of them a byte of a word: a word's end, more to come, and what went before.
END, MORE, AGAIN = b"\x09", b"\x0a", b"\x0b"
_END_UNIT = np.uint64(0x6A09E667F3BCC909)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks of a number's first bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def stable_order(x: np.ndarray) -> np.ndarray:
    """``np.argsort(x, kind="stable")`` of unsigned numbers, several times faster:
    places are sorted in the lowest bits of the numbers. Where the bits given up for
    them would have mattered, numbers are sorted the slow way."""
    if not len(x):
        return np.zeros(0, np.int64)
    place = np.uint64((1 << len(x).bit_length()) - 1)
    packed = x.astype(np.uint64) << np.uint64(64 - max(1, int(x.max()).bit_length()))
    packed = np.sort(packed & ~place | np.arange(len(x), dtype=np.uint64))
    order = (packed & place).astype(np.int64)
    v = x[order]
    return order if (v[1:] >= v[:-1]).all() else np.argsort(x, kind="stable")


# -- tokens and classes ------------------------------------------------------------


@dataclass
class Tokens:
    buf: np.ndarray
    row: np.ndarray  # of each token, ends included
    token: np.ndarray  # hash of each token
    unit: np.ndarray  # hash of each piece, in order
    of: np.ndarray  # token of each piece
    start: np.ndarray  # bytes of each piece; an end has none
    end: np.ndarray
    kind: np.ndarray  # 1: more to come, 2: some went before


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end, by eight bytes at a time."""
    wide = np.ndarray(len(buf) + 1, "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    lens = end - start
    out = lens.astype(np.uint64) * _STEP
    some, at, left = slice(None), start, lens
    while len(at):
        out[some] = mix64(out[some] + (wide[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        some = more if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of consecutive texts; words of more than ``PIECE`` bytes have several pieces."""
    w = words(data, offsets)
    n, m = len(w.counts), len(w.row)
    k = -(-(w.end - w.start) // PIECE)
    last = np.cumsum(k) - 1
    nth = np.arange(k.sum()) - np.repeat(last + 1 - k, k)
    start = np.repeat(w.start, k) + nth * PIECE
    end = np.minimum(start + PIECE, np.repeat(w.end, k))
    kind = (np.arange(len(nth)) < np.repeat(last, k)) + 2 * (nth > 0)
    h = hashes(w.buf, start, end)
    h = np.where(kind > 0, mix64(h + kind.astype(np.uint64) * _STEP), h)
    whole = h[last]
    if (k > 1).any():
        total = np.add.reduceat(mix64(h + nth.astype(np.uint64) * _STEP), last + 1 - k)
        whole = np.where(k > 1, mix64(total), whole)
    # a text's end stands after its words
    word_at, end_at = np.arange(m) + w.row, np.cumsum(w.counts) + np.arange(n)
    row, token = np.zeros(m + n, np.int64), np.full(m + n, _END_UNIT)
    row[word_at], row[end_at], token[word_at] = w.row, np.arange(n), whole
    pieces = np.ones(m + n, np.int64)
    pieces[word_at] = k
    of = np.repeat(np.arange(m + n), pieces)
    inner = np.ones(len(of), bool)
    inner[(np.cumsum(pieces) - 1)[end_at]] = False
    unit, at, to, kinds = np.full(len(of), _END_UNIT), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    unit[inner], at[inner], to[inner], kinds[inner] = h, start, end, kind
    return Tokens(w.buf, row, token, unit, of, at, to, kinds)


def bodies_of(t: Tokens, at: np.ndarray) -> pa.Array:
    """Bodies of the pieces ``at``; none of numbers behind the last piece."""
    piece = at < len(t.unit)
    at = np.minimum(at, len(t.unit) - 1)
    start, again = t.start[at], (t.kind[at] & 2 > 0) & piece
    lens = np.where(piece, t.end[at] - start + again + 1, 0)
    edges = np.concatenate(([0], np.cumsum(lens)))
    data = np.arange(edges[-1]) + np.repeat(start - again - edges[:-1], lens)
    data = t.buf.take(data, mode="clip") if len(t.buf) else np.zeros(len(data), np.uint8)
    data[edges[:-1][again]] = AGAIN[0]
    data[edges[1:][piece] - 1] = np.where(t.kind[at][piece] & 1, MORE[0], END[0])
    return pa.Array.from_buffers(pa.binary(), len(at), [pa.array(piece).buffers()[1], pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs in each text."""
    n = len(offsets) - 1
    buf = lowered(data[offsets[0] : offsets[-1]])
    if len(buf) < 2:
        return np.zeros((n, FEATURES), np.float32)
    pair = ((buf[:-1].astype(np.uint16) << np.uint16(8) | buf[1:]) * np.uint16(40503)) >> np.uint16(8)
    cell = np.repeat(np.arange(0, n * FEATURES, FEATURES), np.diff(offsets))[:-1]
    cell += pair
    counts = np.bincount(cell, minlength=n * FEATURES)
    # without the pairs of a text's last byte and the next text's first
    ends = np.unique(offsets[1:-1] - offsets[0]) - 1
    np.subtract.at(counts, cell[ends[(ends >= 0) & (ends < len(cell))]], 1)
    counts = counts.reshape(n, FEATURES)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def groups(x: np.ndarray) -> np.ndarray:
    """A number below ``GROUPS`` of each text, by its two commonest byte pairs."""
    x = x.copy()
    here = np.arange(len(x))
    top = x.argmax(1)
    x[here, top] = -1
    return top * (GROUPS // FEATURES) + x.argmax(1) % (GROUPS // FEATURES)


def fit_classes(x: np.ndarray, weight: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """Centres of weighted points by farthest-first seeds among all but the oddest, then means."""
    if not len(x):
        return np.zeros((k, FEATURES), np.float32)
    far = ((x - np.average(x, 0, weight)) ** 2).sum(1)
    order = np.argsort(far, kind="stable")
    inner = np.searchsorted(np.cumsum(weight[order]), 0.9 * weight.sum())
    seeds = x[order[: inner + 1]]
    centres = [x[weight.argmax()]]
    while len(centres) < k:
        gap = np.min([((seeds - c) ** 2).sum(1) for c in centres], 0)
        centres.append(seeds[gap.argmax()])
    centres = np.stack(centres)
    for _ in range(20):
        near = classes(x, centres)
        centres = np.stack([np.average(x[near == g], 0, weight[near == g]) if (near == g).any() else centres[g] for g in range(k)])
    return centres.astype(np.float32)


def classes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


# -- the sorted list of words ----------------------------------------------------------


def bit_lcp(a: bytes, b: bytes) -> int:
    """Leading bits that two different bodies, or a body and itself, have in common."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 8 * n + (8 - (a[n] ^ b[n]).bit_length() if n < min(len(a), len(b)) else 0)


def as_matrix(bodies: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bodies as rows, with zeros behind them, and their lengths."""
    bodies = bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.binary())
    edges = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    lens = np.diff(edges)
    matrix = np.zeros((len(bodies), int(lens.max(initial=1))), np.uint8)
    matrix[np.arange(matrix.shape[1]) < lens[:, None]] = np.frombuffer(bodies.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    return matrix, lens


def lcp_histogram(matrix: np.ndarray, other: np.ndarray, n: np.ndarray) -> dict[int, np.ndarray]:
    """Counts by the leading bits that rows share with ``other``."""
    apart = matrix ^ other
    byte = np.where(apart.any(1), (apart != 0).argmax(1), matrix.shape[1])
    top = apart[np.arange(len(apart)), np.minimum(byte, matrix.shape[1] - 1)]
    level = 8 * byte + np.where(byte < matrix.shape[1], 8 - np.ceil(np.log2(top.astype(np.int64) + 1)).astype(np.int64), 0)
    used, inverse = np.unique(level, return_inverse=True)
    total = np.zeros((len(used), n.shape[1]))
    np.add.at(total, inverse, n)
    return {int(v): t for v, t in zip(used, total) if t.any()}


def _fold(h: dict[int, np.ndarray], most: int) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for level, n in h.items():
        out[min(level, most)] = out.get(min(level, most), 0) + n
    return out


def surroundings(ends: list[tuple[bytes, bytes, dict, dict]]) -> list[list[tuple[bytes, np.ndarray]]]:
    """For each block of the sorted list, given by first and last body and the
    histograms of its counts by bits shared with them: stand-ins for all words of
    other blocks, at most one per bit of the first and the last body, with counts.

    In a sorted list words share with a later one no more than with any between, so
    counts by bits shared with a block's first body follow from block to block.
    """

    def stand_in(body: bytes, level: int, bit: int) -> bytes:
        byte, at = divmod(level, 8)
        if byte >= len(body):
            return body
        keep = body[byte] >> (8 - at) << (8 - at)
        return body[:byte] + bytes([keep | bit << (7 - at)])

    before, after = [dict()], [dict()]
    for (f0, l0, _, by_last), (f1, _, _, _) in zip(ends, ends[1:]):
        h = _fold(before[-1], bit_lcp(f0, f1))
        for level, n in _fold(by_last, bit_lcp(l0, f1)).items():
            h[level] = h.get(level, 0) + n
        before.append(h)
    for (f1, l1, by_first, _), (_, l0, _, _) in zip(ends[::-1], ends[::-1][1:]):
        h = _fold(after[-1], bit_lcp(l0, l1))
        for level, n in _fold(by_first, bit_lcp(l0, f1)).items():
            h[level] = h.get(level, 0) + n
        after.append(h)
    out = []
    for (first, last, _, _), b, a in zip(ends, before, after[::-1]):
        low = [(stand_in(first, level, 0), n) for level, n in sorted(b.items())]
        high = [(stand_in(last, level, 1), n) for level, n in sorted(a.items())]
        out.append(sorted(low + high, key=lambda x: x[0]))
    return out


# -- the model ----------------------------------------------------------------------------


def stretch(p):
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p)).astype(np.float32)


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def chance(n0, n1):
    return (n1 + 0.02) / (n0 + n1 + 0.04)


def confidence(n):
    return ((n > 0.5).astype(np.uint8) + (n > 3).astype(np.uint8)) + (n > 30).astype(np.uint8)


INPUTS = 2 + len(ORDERS) + 1
SETS = 8 * 4 * 4 * 4


class Mixer:
    def __init__(self) -> None:
        self.weights = np.full((SETS, INPUTS), 0.25, np.float32)
        self.weights[:, -1] = 0
        self.map = np.tile(squash(np.linspace(-8, 8, 33)), (256, 1)).astype(np.float32)
        self.learned, self.hits, self.cells = 0, np.zeros(SETS), np.zeros(self.map.size)

    @staticmethod
    def bucket(x: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(x, -8, 8) + 8) * 2).astype(np.int64)

    def mix(self, inputs: np.ndarray, sets: np.ndarray) -> np.ndarray:
        return np.einsum("...i,...i->...", self.weights[sets], inputs)

    def final(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        p = 0.7 * squash(x) + 0.3 * self.map[last, self.bucket(x)]
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, inputs: np.ndarray, sets: np.ndarray, bits: np.ndarray, last: np.ndarray, times: np.ndarray, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """One online pass in small steps and mixed order over bits that occur so many
        times; hits of each weight set and map cell so far. A frequent bit is dealt to
        several steps. The map is the mean of all bits by cell."""
        steps = -(-len(bits) // STEP)
        copies = np.minimum(-(-times // TIMES), max(1, steps)).astype(np.int64)
        order = np.random.default_rng(11).permutation(np.repeat(np.arange(len(bits)), copies))
        weight = (times / np.maximum(copies, 1)).astype(np.float32)
        ones, on = self.map.reshape(-1) * (self.cells + 16), self.cells + 16
        for lo in range(0, len(order), STEP):
            some = order[lo : lo + STEP]
            w, v, s = weight[some], inputs[some], sets[some]
            x = self.mix(v, s)
            error = ((bits[some] - squash(x)) * w)[:, None] * v
            hits, different = np.bincount(s, w, SETS), np.bincount(s, minlength=SETS)
            step = np.stack([np.bincount(s, e, SETS) for e in error.T], 1)
            pace = rate * (0.2 + 2 * max(0.0, 1 - max(self.learned / PACED, lo / len(order))))
            self.weights += (pace * step * (np.sqrt(different) / np.maximum(hits, 1e-9))[:, None]).astype(np.float32)
            np.clip(self.weights, -4, 4, out=self.weights)
            self.hits += hits
            self.learned += len(some)
        at = last.astype(np.int64) * self.map.shape[1] + self.bucket(self.mix(inputs, sets))
        on += np.bincount(at, times, on.size)
        ones += np.bincount(at, times * bits, on.size)
        self.map = (ones / on).reshape(self.map.shape).astype(np.float32)
        self.cells = on - 16
        return self.hits, self.cells


def context_hashes(matrix: np.ndarray, at: np.ndarray, j) -> np.ndarray:
    """Of rows ``at`` at byte ``j`` (one, or one of each): a hash of the bytes before for each order and class."""
    out = np.empty((len(at), len(ORDERS), CLASSES), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for t, order in enumerate(ORDERS):
        back = j - order
        byte = np.where(back >= 0, matrix[at, np.maximum(back, 0)].astype(np.uint64), np.uint64(256))
        h = mix64(h + byte + np.full(1, order, np.uint64) * _STEP)
        out[:, t] = h[:, None] + np.arange(1, CLASSES + 1, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out)


class Layout:
    """Places of the tables' slots: about eight slots a distinct word in the longest
    order, as long as contexts of so few bytes can fill them."""

    def __init__(self, distinct: int) -> None:
        want = int(np.ceil(np.log2(8 * max(1, distinct))))
        self.bits = [min(most, max(least, want - less)) for least, most, less in zip(LEAST, MOST, (4, 2, 1, 0))]
        self.bases = np.concatenate(([0], np.cumsum([1 << b for b in self.bits])))
        self.masks = np.array([(1 << b) - 1 for b in self.bits], np.uint64)

    @property
    def size(self) -> int:
        return int(self.bases[-1])

    def slots(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        x = context + (node * np.uint64(0xC2B2AE3D27D4EB4F))[..., None, None]
        x >>= np.uint64(20)
        x &= self.masks[:, None]
        x = x.view(np.int64)
        x += self.bases[:-1, None]
        return x

    def slots_in(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The same for rows of one class each: ``context`` is (row, order)."""
        return self.slots(context[..., None], node)[..., 0]


def bit_steps(matrix: np.ndarray, lens: np.ndarray, n: np.ndarray, wanted: np.ndarray, layout: Layout, alone: list | None = None):
    """The steps of ``bit_walk`` with the slots (node, order, class) of all classes."""
    for lo, place, before, n0, n1, (context, of, node), *rest in bit_walk(matrix, lens, n, wanted, alone):
        yield lo, place, before, n0, n1, layout.slots(context[of], node), *rest


def bit_walk(matrix: np.ndarray, lens: np.ndarray, n: np.ndarray, wanted: np.ndarray, alone: list | None = None):
    """Walks the bits of the rows ``wanted`` (flags) of a sorted list with counts ``n``
    (row, class). Rows that begin alike are one node, an interval of the list. Yields
    per bit, of all nodes: first row, place of the bit, byte before, exact zeros and
    ones (node, class and in all), what slots come from (hashes of the bytes before, the
    node's place among them, the byte's bits so far); and of the next
    nodes: node they come from, their bit, first row, end, and whether they go on (None: all do).
    Rows that begin like no other go on no further if there is a list ``alone``: it gets
    them with the byte that they have come to, for ``bytes_alone``."""
    total = np.zeros((len(n) + 1, CLASSES + 1))
    np.cumsum(n, 0, out=total[1:, :CLASSES])
    total[:, CLASSES] = total[:, :CLASSES].sum(1)
    some = np.concatenate(([0], np.cumsum(wanted)))
    lo, hi = np.zeros(1, np.int64), np.full(1, len(matrix))
    for j in range(matrix.shape[1]):
        if not len(lo):
            return
        node, of = np.ones(len(lo), np.uint64), np.arange(len(lo))
        context = context_hashes(matrix, lo, j)
        before = matrix[lo, j - 1] if j else np.zeros(len(lo), np.uint8)
        column = matrix[:, j].copy()
        for i in range(7, -1, -1):
            ones = np.concatenate(([0], np.cumsum((column >> i) & 1, dtype=np.int64)))
            mid = hi - (ones[hi] - ones[lo])
            middle, low, high = total.take(mid, 0), total.take(lo, 0), total.take(hi, 0)
            first, end = np.stack((lo, mid), 1).ravel(), np.stack((mid, hi), 1).ravel()
            at = np.flatnonzero(some[end] > some[first])
            parent, bit, first, end = at >> 1, at & 1, first[at], end[at]
            rest = None if i else lens[first] > j + 1
            if rest is not None and alone is not None:
                single = rest & (end == first + 1)
                alone.append((first[single], np.full(np.count_nonzero(single), j + 1)))
                rest &= ~single
            yield lo, 7 - i, before, (middle - low).astype(np.float32), (high - middle).astype(np.float32), (context, of, node), parent, bit, first, end, rest
            if rest is not None:
                parent, bit, first, end = parent[rest], bit[rest], first[rest], end[rest]
            lo, hi = first, end
            of, before, node = of[parent], before[parent], node[parent] * np.uint64(2) + bit.astype(np.uint64)


def bytes_alone(lens: np.ndarray, alone: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and places of all bytes that ``bit_walk`` has left, some at a time."""
    row, at = (np.concatenate([x[v] for x in alone]) if alone else np.zeros(0, np.int64) for v in (0, 1))
    left = lens[row] - at
    row, at = np.repeat(row, left), np.arange(left.sum()) - np.repeat(np.cumsum(left) - left - at, left)
    for lo in range(0, len(row), ALONE):
        yield row[lo : lo + ALONE], at[lo : lo + ALONE]


def byte_nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte the eight bits, and what ``bit_walk`` calls nodes: a one and the bits before."""
    return (byte[:, None] >> np.arange(7, -1, -1, dtype=np.uint8)) & 1, (np.uint64(256) | byte.astype(np.uint64))[:, None] >> np.arange(8, 0, -1, dtype=np.uint64)


def gate(place: int, own: np.ndarray, everywhere: np.ndarray, third: np.ndarray) -> np.ndarray:
    return ((confidence(own).astype(np.int64) * 4 + confidence(everywhere)) * 4 + third) * 8 + place


def word_bits(matrix: np.ndarray, lens: np.ndarray, n: np.ndarray, real: np.ndarray, layout: Layout, tables: tuple[np.ndarray, np.ndarray], mixer: Mixer) -> np.ndarray:
    """Bits that the model spends on each of the rows ``real`` in each class."""
    st, seen = tables
    out = np.zeros((len(matrix), CLASSES))
    wanted = np.zeros(len(matrix), bool)
    wanted[real] = True
    cost, alone = np.zeros((1, CLASSES)), []
    for lo, place, before, n0, n1, slots, parent, bit, first, _, rest in bit_steps(matrix, lens, n, wanted, layout, alone):
        inputs = np.ones((len(lo), CLASSES, INPUTS), np.float32)
        exact = stretch(chance(n0, n1))
        inputs[..., 0] = exact[:, :CLASSES]
        inputs[..., 1] = exact[:, CLASSES:]
        inputs[..., 2:-1] = st.take(slots).transpose(0, 2, 1)
        known = confidence(n0 + n1)
        sets = (known[:, :CLASSES] * np.uint16(4) + known[:, CLASSES:]) * np.uint16(4) + seen[slots[:, 2]]
        sets = sets * np.uint16(8) + np.uint16(place)
        p = mixer.final(mixer.mix(inputs, sets), before[:, None])
        p = p[parent]
        cost = cost[parent] - np.log2(np.where(bit[:, None] > 0, p, 1 - p))
        if rest is not None:
            out[first[~rest]] = cost[~rest]
            cost = cost[rest]
    # rows that begin like no other: all counts of their bits are their own
    own = np.concatenate((n, n.sum(1, keepdims=True)), 1).astype(np.float32)
    exact = [stretch(chance(*x)) for x in ((own, np.float32(0)), (np.float32(0), own))]
    known = confidence(own)
    known = (known[:, :CLASSES] * np.uint16(4) + known[:, CLASSES:]) * np.uint16(4)
    for row, at in bytes_alone(lens, alone):
        bits, nodes = byte_nodes(matrix[row, at])
        slots = layout.slots(context_hashes(matrix, row, at)[:, None], nodes)
        inputs = np.ones((len(row), 8, CLASSES, INPUTS), np.float32)
        x = np.where(bits[..., None], exact[1][row][:, None], exact[0][row][:, None])
        inputs[..., 0], inputs[..., 1] = x[..., :CLASSES], x[..., CLASSES:]
        inputs[..., 2:-1] = st.take(slots).transpose(0, 1, 3, 2)
        sets = (known[row][:, None] + seen.take(slots[:, :, 2])) * np.uint16(8) + np.arange(8, dtype=np.uint16)[:, None]
        p = mixer.final(mixer.mix(inputs, sets), matrix[row, at - 1][:, None, None])
        cost = -np.log2(np.where(bits[..., None], p, 1 - p)).sum(1, dtype=np.float64)
        opens = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[opens]] += np.add.reduceat(cost, opens)
    return out[real]


def instances(matrix: np.ndarray, lens: np.ndarray, n: np.ndarray, real: np.ndarray, layout: Layout, counts: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Inputs, weight sets, bits, bytes before and numbers of occurrences to learn from:
    all bits of a block's words that occur ``times`` (row, class), without one occurrence."""
    return [np.concatenate(x) for x in zip(*instance_parts(matrix, lens, n, real, layout, counts, times))]


def instance_parts(matrix: np.ndarray, lens: np.ndarray, n: np.ndarray, real: np.ndarray, layout: Layout, counts: np.ndarray, times: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The same by places of the bits; at one, a bit of words that begin alike is one."""
    total = np.concatenate((np.zeros((1, CLASSES), np.int64), np.cumsum(times, 0)))
    # zeros and ones of a slot stand together, if the table came so
    both = np.ascontiguousarray(counts.T)
    slot = both.view(np.result_type(both, np.complex64))[:, 0]
    for _, place, before, n0, n1, (context, of, node), parent, bit, first, end, _ in bit_walk(matrix, lens, n, times.any(1)):
        k = total[end] - total[first]
        c, g = np.nonzero(k)
        r, b = parent[c], bit[c][:, None].astype(np.float32)
        own = [np.stack((x[r, g], x[r, CLASSES]), 1) for x in (n0, n1)]
        own = [np.maximum(own[0] - (1 - b), 0), np.maximum(own[1] - b, 0)]
        s = layout.slots_in(context[of[r], :, g], node[r])
        t = slot.take(s)
        t0, t1 = np.maximum(t.real - (1 - b), 0), np.maximum(t.imag - b, 0)
        inputs = np.concatenate((stretch(chance(*own)), stretch(chance(t0, t1)), np.ones_like(b)), 1)
        seen = own[0] + own[1]
        sets = gate(place, seen[:, 0], seen[:, 1], confidence(t0[:, 2] + t1[:, 2])).astype(np.int32)
        yield [inputs, sets, b[:, 0], before[r], k[c, g]]


# -- scoring a text in order -------------------------------------------------------------------


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of what is before each place, from ``first`` of its text on."""
    total = np.zeros(len(x) + 1)
    np.cumsum(x, out=total[1:])
    return total[:-1] - total[first]


def text_logs(cost: np.ndarray, token: np.ndarray, row: np.ndarray, prior: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each token, of texts whose tokens stand together:
    ``cost`` is bits by class. Classes weigh by what the ``WINDOW`` tokens before
    cost in them; the tokens that the text has used weigh by how well they have foretold.
    ``order`` sorts the tokens and keeps the order of equal ones."""
    if not len(row):
        return np.zeros(0)
    logs = -np.log(2) * np.ascontiguousarray(cost.T)
    place = np.arange(len(row))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], row[1:] != row[:-1])), place, 0))
    total = np.zeros((CLASSES, len(row) + 1))
    np.cumsum(logs, 1, out=total[:, 1:])
    score = total[:, :-1] - total.take(np.maximum(first, place - WINDOW), 1) + np.log(prior)[:, None]
    score -= score.max(0)
    weight = np.exp(score)
    top = logs.max(0)
    mixed = top + np.log((weight * np.exp(logs - top)).sum(0) / weight.sum(0))
    p = np.exp(np.maximum(mixed, -700))
    # occurrences of the same token before, in the text
    order = np.argsort(token, kind="stable") if order is None else order
    again = np.concatenate(([False], (row[order][1:] == row[order][:-1]) & (token[order][1:] == token[order][:-1])))
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    used = np.empty(len(order))
    used[order] = run
    cached = used / np.maximum(place - first, 1)
    gain = CACHE_WEIGHT * cached / (CACHE_WEIGHT * cached + (1 - CACHE_WEIGHT) * p + 1e-300)
    share = (_before(gain, first) + 20 * CACHE_WEIGHT) / (place - first + 20)
    share = np.where(place == first, 0.0, np.clip(share, 1e-3, 0.9))
    return log_sum(share, p, mixed, cached)


def pair_keys(token: np.ndarray) -> np.ndarray:
    """Hashes of the tokens with the one before each; before a text stands an end,
    which texts that stand together have there anyway."""
    before = np.concatenate(([_END_UNIT], token[:-1]))
    return mix64(before * np.uint64(0xA24BAED4963EE407) + token) >> np.uint64(64 - PAIR_BITS)


def occurrences(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value occurs in its row, and the values' order."""
    order = stable_order(value)
    v, r = value[order], row[order]
    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])))) if len(v) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate((at, [len(v)])))
    out = np.empty(len(v), np.int64)
    out[order] = np.repeat(n, n)
    return out, order


class Places:
    """Where hashes stand in sorted ``ids``: a list of where their first bits begin
    leaves few to compare."""

    def __init__(self, ids: np.ndarray, bits: int = 64) -> None:
        self.ids = ids
        known = max(1, min(bits, len(ids).bit_length() - 1))
        self.shift = np.uint64(bits - known)
        self.begins = np.searchsorted(ids, np.arange(1 << known, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, value: np.ndarray) -> np.ndarray:
        """``np.searchsorted(ids, value)``; some id must not be less than any value."""
        at = self.begins[(value >> self.shift).astype(np.int64)].astype(np.int64)
        some = np.flatnonzero(self.ids[at] < value)
        while len(some):
            at[some] += 1
            some = some[self.ids[at[some]] < value[some]]
        return at

    def different(self, value: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the different values stand, each looked up once, and which of them each
        value is; ``order`` sorts the values."""
        v = value[order]
        opens = np.concatenate(([True], v[1:] != v[:-1]))
        out = np.empty(len(v), np.int64)
        out[order] = np.cumsum(opens) - 1
        return self.of(v[opens]), out


def log_sum(share: np.ndarray, p: np.ndarray, logs: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Logarithms of (1 - share) * p + share * other; ``p`` has the natural logarithms
    ``logs``, which tell where it is too small for a number."""
    out = np.log(np.maximum((1 - share) * p + share * other, 1e-300))
    low = np.flatnonzero(logs < -600)
    out[low] = np.logaddexp(np.log1p(-share[low]) + logs[low], np.log(np.maximum(share[low] * other[low], 1e-300)))
    return out


def pair_logs(logs: np.ndarray, row: np.ndarray, seen: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Mixes natural log probabilities of tokens with those of their pairs: ``seen``
    is how often the pair, ``context`` how often the token before was counted."""
    if not len(row):
        return logs
    place = np.arange(len(row))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], row[1:] != row[:-1])), place, 0))
    chance = seen / (context + 0.5)
    miss = np.maximum.accumulate(np.where(seen > 0, -1, place))
    known = np.minimum(place - 1 - np.maximum(first - 1, np.concatenate(([-1], miss[:-1]))), 3)
    start = PAIR_SHARE[known]
    p = np.exp(np.maximum(logs, -700))
    gain = start * chance / (start * chance + (1 - start) * p + 1e-300)
    gate = (row - row[0]) * 16 + known * 4 + (context > 0) + (context > 3) + (context > 30)
    order = np.argsort(gate.astype(np.uint16) if gate.max() < 1 << 16 else gate, kind="stable")
    g = gate[order]
    opens = np.maximum.accumulate(np.where(np.concatenate(([True], g[1:] != g[:-1])), place, 0))
    share = np.empty(len(row))
    share[order] = (_before(gain[order], opens) + PAIR_WORTH * start[order]) / (place - opens + PAIR_WORTH)
    share = np.where(context > 0, np.clip(share, 1e-4, 0.995), 0.0)
    return log_sum(share, p, logs, chance)


def to_planes(x: np.ndarray) -> bytes:
    """Compressed numbers, their bytes by rank: high ones are mostly zero."""
    planes, raw = np.zeros((8, len(x)), np.uint8), x.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(-(-int(x.max(initial=0)).bit_length() // 8)):
        planes[k] = raw[:, k]
    return pa.compress(planes, "zstd", asbytes=True)


def from_planes(raw: bytes, n: int) -> np.ndarray:
    planes, x = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n), np.zeros(n, "<u8")
    for k in np.flatnonzero(planes.any(1)):
        x.view(np.uint8).reshape(n, 8)[:, k] = planes[k]
    return x


# -- Spark stages -------------------------------------------------------------------------------


_N = [f"n{g}" for g in range(CLASSES)]
_PAIRS = "part int, pairs int, keys binary, counts binary"
_SEEN = "chunk int, unit long, body binary, " + ", ".join(f"{c} long" for c in _N) + ", " + _PAIRS
_NO_PAIRS = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_TEXT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, doc_id, held_out, text) rows as compressed blocks of a chunk's rows,
    which shuffle in a third of the bytes."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=PACKED))
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        chunks = batch.column(0).to_numpy()
        borders = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1], [True]))) if len(chunks) else np.zeros(1, int)
        blocks = []
        for lo, hi in zip(borders[:-1], borders[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch.slice(lo, hi - lo))
            blocks.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunks[borders[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["chunk", "block"])


def _unpack(blocks: list[bytes], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of blocks, gathered to batches of about ``size`` bytes."""
    held, n = [], 0
    for i, block in enumerate(blocks):
        held.append(pa.ipc.open_stream(block).read_all())
        n += held[-1].nbytes
        if n >= size or i == len(blocks) - 1:
            yield pa.concat_tables(held).combine_chunks().to_batches()[0]
            held, n = [], 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the features of (text) rows and their number, by group."""
    total, n = np.zeros((GROUPS, FEATURES)), np.zeros(GROUPS, np.int64)
    for b in batches:
        data, offsets = string_parts(b.column(0))
        for lo, hi in slices(offsets, max_bytes=SLICE):
            x = features(data, offsets[lo : hi + 1])
            group = groups(x)
            order = np.argsort(group, kind="stable")
            at = np.flatnonzero(np.diff(group[order], prepend=-1))
            total[group[order][at]] += np.add.reduceat(x[order].astype(float), at)
            n += np.bincount(group, minlength=GROUPS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array([v.astype("<f4").tobytes() for v in total[used]], pa.binary())], ["grp", "n", "x"])


def _add_features(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f4").astype(float) for x in rows.column("x").to_pylist())
    n = sum(rows.column("n").to_pylist())
    return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "x": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def _asked(chunk: int, held: list[tuple[np.ndarray, np.ndarray]], n_parts: int) -> pa.RecordBatch:
    """Distinct pairs by parts: steps between their hashes, and twice their counts in
    training texts, plus one if a held-out text has them. ``held`` are hashes, sorted, with
    that flag as their lowest bit, and counts."""
    rows = []
    # sorted in ranges of parts, so that little is held twice
    ranges = max(1, min(n_parts, sum(len(k) for k, _ in held) // PAIRS_SORTED))
    borders = [-(-(r * n_parts // ranges << PAIR_BITS) // n_parts) << 1 for r in range(1, ranges)]
    cuts = [np.concatenate(([0], np.searchsorted(k, np.array(borders, np.uint64)), [len(k)])) for k, _ in held]
    for r in range(ranges):
        keys, n = (np.concatenate([x[v][c[r] : c[r + 1]] for x, c in zip(held, cuts)]) for v in (0, 1))
        if not len(keys):
            continue
        order = stable_order(keys)
        keys, n = keys[order], n[order].astype(np.int64)
        flag = (keys & np.uint64(1)).astype(bool)
        keys = keys >> np.uint64(1)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        value = 2 * np.add.reduceat(np.where(flag, 0, n), at) + np.maximum.reduceat(flag, at)
        keys = keys[at]
        part = (keys * np.uint64(n_parts) >> np.uint64(PAIR_BITS)).astype(np.int32)
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        rows += [(part[lo], hi - lo, to_planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), to_planes(value[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:])]
    m = len(rows)
    cols = [pa.array(x, kind) for x, kind in zip(zip(*rows), _NO_PAIRS)]
    none = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *[pa.nulls(m, pa.int64()) for _ in _N]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk, np.int32)), *none, *cols], ["chunk", "unit", "body", *_N, "part", "pairs", "keys", "counts"])


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """Counts in all training texts of the pairs that a part's rows ask for; pairs
    that only their own text has are left out."""
    sizes = rows.column("pairs").to_pylist()
    keys = np.concatenate([np.cumsum(from_planes(k, n)) for k, n in zip(rows.column("keys").to_pylist(), sizes)])
    value = np.concatenate([from_planes(c, n) for c, n in zip(rows.column("counts").to_pylist(), sizes)]).astype(np.int64)
    order = stable_order(keys)
    group = np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) - 1
    total = np.empty(len(keys), np.int64)
    total[order] = np.bincount(group, (value >> 1)[order])[group].astype(np.int64)
    wanted = (total > 1) | ((total == 1) & (value & 1 > 0))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for chunk, lo, hi in zip(rows.column("chunk").to_pylist(), edges[:-1], edges[1:]):
        some = np.flatnonzero(wanted[lo:hi]) + lo
        if len(some):
            out.append((chunk, len(some), to_planes(np.diff(keys[some], prepend=np.uint64(0))), to_planes(total[some])))
    chunks, n, k, c = zip(*out) if out else ((),) * 4
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "pairs": pa.array(n, pa.int32()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})


def placed(old: np.ndarray, kept: np.ndarray, there: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``old`` at the places ``kept`` (flags), ``new`` at the others."""
    out = np.empty((len(kept), *old.shape[1:]), old.dtype)
    out[kept], out[there] = old, new
    return out


def _chunk_units(centres: np.ndarray, n_parts: int):
    """Distinct units of a chunk's texts with their counts in training texts by
    class, of (chunk, block) rows sorted by chunk. A word of several pieces also
    has a row without a body, for its count. Rows with keys ask for word pairs."""

    def emit(chunk: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        # all units so far, sorted, and their counts; new units in the order of their bodies
        listed, total = np.zeros(0, np.uint64), np.zeros((0, CLASSES), np.int32)
        fresh, bodies = [], []
        pairs, pairs_held = [], 0
        for rows in _unpack(blocks):
            training = ~rows.column(2).to_numpy(zero_copy_only=False)
            data, offsets = string_parts(rows.column(3))
            for lo, hi in slices(offsets, max_bytes=LISTED_SLICE):
                some = offsets[lo : hi + 1]
                of_text = np.where(training[lo:hi], classes(features(data, some), centres), -1)
                t = tokens(data, some)
                keys, times = np.unique(pair_keys(t.token) << np.uint64(1) | ~training[lo:hi][t.row], return_counts=True)
                pairs.append((keys, times.astype(np.int32)))
                pairs_held += len(pairs[-1][0])
                if pairs_held > PAIRS_HELD:
                    yield _asked(chunk, pairs, n_parts)
                    pairs, pairs_held = [], 0
                whole = np.flatnonzero(np.bincount(t.of, minlength=len(t.row)) > 1)
                unit = np.concatenate((t.unit, t.token[whole]))
                group = of_text[t.row[np.concatenate((t.of, whole))]]
                order = stable_order(unit)
                opens = np.concatenate(([True], unit[order][1:] != unit[order][:-1]))
                where = order[opens]
                distinct = unit[where]
                n = np.bincount((np.cumsum(opens) - 1) * (CLASSES + 1) + group[order] + 1, minlength=len(distinct) * (CLASSES + 1)).reshape(-1, CLASSES + 1)[:, 1:]
                # only a unit's first slice makes its body
                at = np.searchsorted(listed, distinct)
                known = np.zeros(len(distinct), bool)
                known[at < len(listed)] = listed[at[at < len(listed)]] == distinct[at < len(listed)]
                new = ~known
                bodies.append(bodies_of(t, where[new]))
                fresh.append(distinct[new])
                total[at[known]] += n[known].astype(np.int32)
                there = at[new] + np.arange(len(fresh[-1]))
                kept = np.ones(len(listed) + len(there), bool)
                kept[there] = False
                listed, total = (placed(x, kept, there, y) for x, y in ((listed, distinct[new]), (total, n[new])))
        if pairs:
            yield _asked(chunk, pairs, n_parts)
        if fresh:
            body = pa.chunked_array(bodies, pa.binary())
            by_unit = stable_order(np.concatenate(fresh))
            for lo in range(0, len(listed), 16384):
                some = slice(lo, lo + 16384)
                rows = len(listed[some])
                none = [pa.nulls(rows, kind) for kind in _NO_PAIRS]
                of_units = [pa.array(listed[some].view(np.int64)), body.take(pa.array(by_unit[some])).combine_chunks(), *[pa.array(total[some, g].astype(np.int64)) for g in range(CLASSES)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk, np.int32)), *of_units, *none], ["chunk", "unit", "body", *_N, "part", "pairs", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, blocks, size = None, [], 0
        for batch in batches:
            for c, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # a large chunk may be sent in parts: they are added up later
                if blocks and (c != chunk or size > LISTED):
                    yield from emit(chunk, blocks)
                    blocks, size = [], 0
                chunk = c
                blocks.append(block)
                size += len(block)
        if blocks:
            yield from emit(chunk, blocks)
        blocks.clear()
        pa.default_memory_pool().release_unused()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (unit, body, counts) rows as blocks of at most ``BLOCK`` rows with what
    other blocks must know of them."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 24, 0

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        bodies = t.column("body").combine_chunks()
        n = np.stack([t.column(c).to_numpy() for c in _N], 1).astype(np.float64)
        matrix, _ = as_matrix(bodies)
        ends = [lcp_histogram(matrix, matrix[i], n) for i in (0, -1)]
        sides = [[pa.array([list(h)], pa.list_(pa.int32())), pa.array([b"".join(v.tobytes() for v in h.values())], pa.binary())] for h in ends]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first + made], pa.int64()),
                pa.array([t.column("unit").to_numpy().tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(bodies)], pa.int32()), bodies),
                pa.array([n.tobytes()], pa.binary()),
                *sides[0],
                *sides[1],
            ],
            ["block", "units", "bodies", "n", "levels_first", "counts_first", "levels_last", "counts_last"],
        )

    parts, rows = [], 0
    for b in batches:
        while len(b):
            take = b.slice(0, BLOCK - rows)
            b = b.slice(len(take))
            parts.append(take)
            rows += len(take)
            if rows == BLOCK:
                yield block(parts)
                parts, rows, made = [], 0, made + 1
    if rows:
        yield block(parts)


_BLOCKS_ENDS = ["levels_first", "counts_first", "levels_last", "counts_last"]
_BLOCKS = "block long, units binary, bodies array<binary>, n binary, levels_first array<int>, counts_first binary, levels_last array<int>, counts_last binary"


def _histogram(levels, counts) -> dict[int, np.ndarray]:
    return dict(zip(levels, np.frombuffer(bytes(counts)).reshape(-1, CLASSES)))


def with_surroundings(bodies: list[bytes] | pa.Array, n: np.ndarray, others: list[tuple[bytes, np.ndarray]]):
    """The sorted list of a block and its stand-ins: matrix, lengths, counts, rows of the block."""
    bodies = bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.binary())
    first = bodies[0].as_py()
    low, high = [x for x in others if x[0] < first], [x for x in others if x[0] >= first]
    sides = [pa.array([x[0] for x in side], pa.binary()) for side in (low, high)]
    matrix, lens = as_matrix(pa.concat_arrays([sides[0], bodies, sides[1]]))
    extra = [np.array([x[1] for x in side]).reshape(-1, CLASSES) for side in (low, high)]
    return matrix, lens, np.concatenate((extra[0], n, extra[1])), np.arange(len(bodies)) + len(low)


def _each_block(batches: Iterator[pa.RecordBatch], others: dict[int, list]):
    for b in batches:
        for r in range(len(b)):
            number, units, n = (b.column(c)[r].as_py() for c in (0, 1, 3))
            bodies = b.column(2)[r].values
            yield np.frombuffer(units, np.int64), bodies, *with_surroundings(bodies, np.frombuffer(n).reshape(-1, CLASSES), others.get(number, []))


def _count(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, layout.size))
        for _, _, matrix, lens, n, real in _each_block(batches, {}):
            alone = []
            for _, _, _, n0, n1, (context, of, node), *_ in bit_walk(matrix, lens, n, n.any(1), alone):
                for v, own in enumerate((n0, n1)):
                    r, g = np.nonzero(own[:, :CLASSES])
                    slots = layout.slots_in(context[of[r], :, g], node[r])
                    np.add.at(counts[v], slots.ravel(), np.repeat(own[r, g].astype(float), len(ORDERS)))
            for row, at in bytes_alone(lens, alone):
                r, g = np.nonzero(n[row])
                bits, nodes = byte_nodes(matrix[row, at])
                slots = layout.slots_in(context_hashes(matrix, row, at)[r, :, g][:, None], nodes[r])
                slots += (bits[r] * np.int64(layout.size))[..., None]
                np.add.at(counts.reshape(-1), slots.ravel(), np.repeat(n[row[r], g], 8 * len(ORDERS)))
        flat = counts.reshape(-1, SENT)
        used = np.flatnonzero(flat.any(1))
        for lo in range(0, len(used), 64):
            some = used[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(flat[i].tobytes(), 1) for i in some], pa.binary())], ["part", "counts"])

    return run


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    # in an order of their own, so that sums of fractions do not depend on who came first
    total = sum(np.frombuffer(zlib.decompress(c)) for c in sorted(rows.column("counts").to_pylist()))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _learn(sent, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, others = sent.value
        mixer, parts, held = Mixer(), [], 0
        for _, _, matrix, lens, n, real in _each_block(batches, others):
            times = np.zeros(n.shape, np.int64)
            times[real] = n[real]
            for part in instance_parts(matrix, lens, n, real, layout, counts, times):
                parts.append(part)
                held += len(part[2])
                if held > LEARNED:
                    mixer.learn(*(np.concatenate(x) for x in zip(*parts)))
                    parts, held = [], 0
        if held:
            mixer.learn(*(np.concatenate(x) for x in zip(*parts)))
        if mixer.learned:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, np.float64).tobytes()], pa.binary()) for x in (mixer.weights, mixer.hits, mixer.map, mixer.cells)], ["w", "hits", "m", "cells"])

    return run


def _learned(sent, layout: Layout):
    """What a task has learned, as sums over hits (weights, hits, map, cells), in
    pieces that are added up apart."""
    learn = _learn(sent, layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in learn(batches):
            w, hits, m, cells = (np.frombuffer(b.column(c)[0].as_py()) for c in range(4))
            flat = np.concatenate(((w.reshape(SETS, INPUTS) * hits[:, None]).ravel(), hits, m * cells, cells))
            pieces = np.array_split(flat, LEARNED_PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in pieces], pa.binary())], ["part", "counts"])

    return run


def _word_costs(sent, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, mixer, others = sent.value
        for units, _, matrix, lens, n, real in _each_block(batches, others):
            bits = np.minimum(np.rint(word_bits(matrix, lens, n, real, layout, tables, mixer) * BIT_PART), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(n[real].sum(1).astype(np.int64)), pa.array(bits.view(np.int64)[:, 0])], ["unit", "c", "bits"])

    return run


def _answered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, sorted, and their counts from the answers to a chunk, and a pair behind all."""
    sizes = rows.column("pairs").to_pylist()
    # read in place, one answer after another
    pairs, times = np.full(sum(sizes) + 1, 1 << 63, np.uint64), np.zeros(sum(sizes) + 1, np.int64)
    lo = 0
    for n, keys, counts in zip(sizes, rows.column("keys"), rows.column("counts")):
        np.cumsum(from_planes(keys.as_buffer(), n), out=pairs[lo : lo + n])
        times[lo : lo + n] = from_planes(counts.as_buffer(), n)
        lo += n
    order = stable_order(pairs[:lo])
    pairs[:lo] = pairs[order]
    times[:lo] = times[order]
    return pairs, times


def _text_scores(prior: np.ndarray, train_tokens: int, vocabulary: int):
    scale = np.log10(train_tokens + vocabulary + 1)

    def run(key: tuple, blocks: pa.Table, known: pa.Table) -> pa.Table:
        ids = known.column("unit").to_numpy().view(np.uint64)
        order = stable_order(ids)
        ids, count = ids[order], known.column("c").to_numpy()[order]
        bits = (known.column("bits").to_numpy()[order].view("<u2").reshape(-1, CLASSES) / BIT_PART).astype(np.float32)
        pairs, times = _answered(blocks.filter(blocks.column("keys").is_valid()))
        units_at, pairs_at = Places(ids), Places(pairs, PAIR_BITS)
        blocks = blocks.column("block").drop_null().to_pylist()
        del known, order
        pa.default_memory_pool().release_unused()
        out = []
        for rows in _unpack(blocks):
            training = ~rows.column(2).to_numpy(zero_copy_only=False)
            cols = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
            data, offsets = string_parts(rows.column(3))
            for lo, hi in slices(offsets, max_bytes=SLICE):
                t = tokens(data, offsets[lo : hi + 1])
                n, m = hi - lo, len(t.row)
                here, by_token = occurrences(t.token, t.row)
                place, which = units_at.different(t.token, by_token)
                c = count[place][which]
                if len(t.of) == m:
                    cost = bits[place].take(which, 0)
                else:
                    cost = np.stack([np.bincount(t.of, p, m) for p in bits[units_at.of(t.unit)].T], 1)
                logs = text_logs(cost.astype(np.float64), t.token, t.row, prior, by_token)
                keys, mine = pair_keys(t.token), training[lo:hi][t.row]
                own, by_key = occurrences(keys, t.row)
                at, which = pairs_at.different(keys, by_key)
                found = np.zeros(len(at), np.uint64)
                found[which] = keys
                seen = np.where(pairs[at] == found, times[at], 0)[which]
                # the last token is an end, as is the one before the first
                context = np.maximum(np.roll(c, 1) - np.roll(here, 1) * mine, 0)
                total = np.bincount(t.row, pair_logs(logs, t.row, np.clip(seen - own * mine, 0, context), context), n)
                size = np.bincount(t.row[t.of], t.end - t.start + 1, n)
                cols["n_tokens"].append(np.bincount(t.row, minlength=n))
                cols["n_known"].append(np.bincount(t.row, c > 0, n).astype(np.int64))
                cols["base_score"].append(np.bincount(t.row, np.log10(c + 1.0) - scale, n))
                cols["score"].append(total / np.log(10))
                cols["bits_per_byte"].append(-total / np.log(2) / size)
            got = {k: np.concatenate(v) for k, v in cols.items()}
            counts = {k: pa.array(got[k].astype(np.int64)) for k in ("n_tokens", "n_known")}
            counts["train_tokens"] = pa.array(np.full(len(rows), train_tokens, np.int64))
            out.append(pa.table({"doc_id": rows.column(1), "held_out": rows.column(2), **counts, **{k: pa.array(got[k].astype(float)) for k in ("base_score", "score", "bits_per_byte")}}))
        del blocks
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, held_out=None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte, a row per input row.

    Tokens are the words of the text with A-Z lower-cased, and one end; base and
    score are log10 probabilities of these tokens, and bits per byte are the score's
    over the words' bytes and one mark each. Learns from the rows outside
    ``held_out`` (a condition; default: crc32 of the key modulo 7 is 2; a null key is
    learned from). A null text is empty: one token, the end. Without training rows
    nothing is known and bits cost about one bit each. Repeated rows count as often
    as they occur; other columns are ignored; an empty table gives no rows.

    Classes, counts, weights and map are learned from all training texts.
    """
    spark = docs.sparkSession
    prepare(spark)
    cores = spark.sparkContext.defaultParallelism
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)) if held_out is None else held_out
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    chunks = max(int(-(-(size or 0) // CHUNK_BYTES)), cores)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    # all training texts, added up by group: at most GROUPS rows come here
    sums = spread(rows.where("not held_out and text <> ''").select("text")).mapInArrow(_features, "grp int, n long, x binary")
    fitted = sums.groupBy("grp").applyInArrow(_add_features, "grp int, n long, x binary").orderBy("grp").collect()
    weight = np.array([r.n for r in fitted], float)
    centres = fit_classes(np.array([np.frombuffer(bytes(r.x), "<f4") for r in fitted]).reshape(-1, FEATURES) / weight[:, None], weight)

    n_parts = max(16, int((size or 0) // PAIR_BYTES))
    packed = spread(rows).select(chunk.alias("chunk"), "doc_id", "held_out", "text").mapInArrow(_pack, "chunk int, block binary")
    seen = cut(packed.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_chunk_units(centres, n_parts), _SEEN))
    units = seen.where("keys is null")
    found = cut(units.groupBy("unit", "body").agg(*[F.sum(c).alias(c) for c in _N]))
    # words of several pieces count for the base by their row without a body, their pieces do not
    trained = F.expr(" + ".join(_N))
    base = (F.col("body").isNull() | (~F.startswith("body", F.lit(AGAIN)) & F.endswith("body", F.lit(END))))
    total, distinct, n_units = found.agg(F.coalesce(F.sum(F.when(base, trained)), F.lit(0)), F.count(F.when(base & (trained > 0), 1)), F.count("*")).first()
    by_class = found.where(F.col("body") == F.lit(END)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _N]).first()
    prior = (np.array(by_class, float) + 1) / (sum(by_class) + CLASSES)

    parts = max(cores, int(n_units // (4 * BLOCK)))
    blocks = cut(found.where("body is not null").repartitionByRange(parts, "body").sortWithinPartitions("body").select("unit", "body", *_N).mapInArrow(_blocks, _BLOCKS))
    ends = blocks.select("block", F.get("bodies", F.lit(0)).alias("first"), F.element_at("bodies", -1).alias("last"), *_BLOCKS_ENDS).orderBy("block").collect()
    around = surroundings([(bytes(r.first), bytes(r["last"]), _histogram(r.levels_first, r.counts_first), _histogram(r.levels_last, r.counts_last)) for r in ends])
    others = {r.block: o for r, o in zip(ends, around)}
    work = blocks.select("block", "units", "bodies", "n")
    layout = Layout(int(distinct))

    counts = np.zeros((2, layout.size), np.float32)
    flat = counts.reshape(-1, SENT)
    for r in work.mapInArrow(_count(layout), "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect():
        flat[r.part] = np.frombuffer(zlib.decompress(r.counts))  # tables of bounded size: two numbers a slot

    mixer = Mixer()
    raw = spark.sparkContext.broadcast((np.asfortranarray(counts), others))
    hits, cells = np.full(SETS, 1e-9), np.full(mixer.map.size, 1e-9)
    sums = np.concatenate(((mixer.weights * hits[:, None]).ravel(), hits, mixer.map.reshape(-1) * cells, cells))
    pieces = np.array_split(sums, LEARNED_PARTS)
    for r in work.mapInArrow(_learned(raw, layout), "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect():
        pieces[r.part] = pieces[r.part] + np.frombuffer(zlib.decompress(r.counts))
    weights, hits, bins, cells = np.split(np.concatenate(pieces), np.cumsum([mixer.weights.size, SETS, mixer.map.size]))
    weights = weights.reshape(SETS, INPUTS)
    mixer.weights, mixer.map = (weights / hits[:, None]).astype(np.float32), (bins / cells).reshape(mixer.map.shape).astype(np.float32)

    raw.destroy()
    n0, n1 = counts
    sent = spark.sparkContext.broadcast(((stretch(chance(n0, n1)), confidence(n0 + n1)), mixer, others))
    costs = work.mapInArrow(_word_costs(sent, layout), "unit long, c long, bits long")
    whole = found.where("body is null").select("unit", trained.alias("c"), F.lit(0).cast("long").alias("bits"))
    facts = cut(costs.unionByName(whole))
    # the last stage takes the most disk, and reads neither of these
    for table in (found, blocks):
        drop(table)
    known = units.select("chunk", "unit").join(facts, "unit").select(F.col("chunk").alias("of"), "unit", "c", "bits")
    asked = seen.where("keys is not null").select("chunk", "part", "pairs", "keys", "counts")
    answers = asked.groupBy("part").applyInArrow(_answer, "chunk int, pairs int, keys binary, counts binary")
    return packed.unionByName(answers, allowMissingColumns=True).groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_text_scores(prior, int(total), int(distinct)), _TEXT)

