"""Language of words and texts by a linear-chain conditional random field.

A word's features are its character n-grams with marks at both ends (so the
outer ones are its affixes) and the word itself as a lexicon entry, hashed into
one weight table. Learned transitions join the words; forward-backward gives
each word's label probabilities, so code-switched stretches keep labels of their
own. A text's language is the one with the largest mean over its words.

Texts are cut into chunks of words for the recursions: the chunks' transfer
matrices give the vectors at their borders, and within chunks all positions of
many chunks advance at once. The result is that of one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import prepare, remainder, spread
from .textnum import _GRAM, mix64, slices, string_parts, words

#: Hashed features, the words of a chunk, and text bytes labelled at a time (with up to 8 labels).
BITS, CHUNK, SLICE = 18, 64, 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # float32 [2 ** BITS, langs]
    trans: np.ndarray  # [langs, langs] log scores
    start: np.ndarray  # [langs]


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of words given by their bytes, sorted by word."""
    lens = end - start + 2
    first = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
    total = int(lens.sum())
    word = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(total) - first[word]
    chars = np.full(total, 2, np.uint64)
    inner = (at > 0) & (at < lens[word] - 1)
    chars[inner] = buf[(start[word] + at - 1)[inner]]
    chars[at == lens[word] - 1] = 3
    owners, ids = [], []
    for n in (2, 3, 4):
        if total < n:
            continue
        same = word[: total - n + 1] == word[n - 1 :]
        acc = np.full(total - n + 1, n, np.uint64)
        for j in range(n):
            acc += chars[j : total - n + 1 + j] * _GRAM[j]
        owners.append(word[: total - n + 1][same])
        ids.append(mix64(acc[same]))
    if total:
        owners.append(np.arange(len(lens)))
        ids.append(mix64(np.add.reduceat(chars * mix64(at.astype(np.uint64) + np.uint64(99)), first)))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    order = np.argsort(owner, kind="stable")
    return owner[order], (ids[order] & np.uint64((1 << BITS) - 1)).astype(np.int64)


def emissions(weights: np.ndarray, owner: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]))
    if len(owner):
        out[:] = np.add.reduceat(weights[ids], np.searchsorted(owner, np.arange(n)), axis=0)
    return out


def forward_backward(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Label probabilities of each word; ``counts`` are the words of each text in turn."""
    n, k = emit.shape
    if not n:
        return np.zeros((0, k))
    counts = counts[counts > 0]
    step, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    chunks = -(-counts // chunk)
    head = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    text = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(n) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    c, t = head[text] + pos // chunk, pos % chunk
    size = int(chunks.sum())
    x = np.ones((size, chunk, k))
    x[c, t] = np.exp(np.maximum(emit - emit.max(1, keepdims=True), -30))
    real = np.zeros((size, chunk), bool)
    real[c, t] = True
    opens = np.zeros(size, bool)
    opens[head] = True

    def advance(v: np.ndarray, i: int) -> np.ndarray:
        moved = v @ step
        if i == 0:
            moved[opens] = v[opens]
        moved *= x[:, i] if v.ndim == 2 else x[:, i, None, :]
        if not real[:, i].all():
            moved[~real[:, i]] = v[~real[:, i]]
        return moved / moved.max(axis=tuple(range(1, v.ndim)), keepdims=True)

    before = np.ones((size, k))
    after = np.ones((size, k))
    before[head] = first
    if chunks.max() > 1:
        many = np.repeat(chunks > 1, chunks)
        moves = np.broadcast_to(np.eye(k), (size, k, k)).copy()
        for i in range(chunk):
            moves = advance(moves, i)
        ordinal = np.arange(size) - np.repeat(head, chunks)
        for o in range(1, int(chunks.max())):
            at = np.flatnonzero((ordinal == o) & many)
            v = np.einsum("nk,nkj->nj", before[at - 1], moves[at - 1])
            before[at] = v / v.max(1, keepdims=True)
        for o in range(int(chunks.max()) - 1, 0, -1):
            at = np.flatnonzero((ordinal == o) & many)
            v = np.einsum("nkj,nj->nk", moves[at], after[at])
            after[at - 1] = v / v.max(1, keepdims=True)
    alpha = np.empty_like(x)
    v = before
    for i in range(chunk):
        v = alpha[:, i] = advance(v, i)
    v = after
    for i in range(chunk - 1, -1, -1):
        alpha[:, i] *= v
        back = (x[:, i] * v) @ step.T
        v = np.where(real[:, i, None], back / back.max(1, keepdims=True), v)
    got = alpha[c, t]
    return got / got.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], window: int = 128, epochs: int = 8, seed: int = 5) -> Model:
    """Fits the field on labelled texts by AdaGrad on the conditional likelihood.

    Sequences are made of stretches of two texts, so that transitions between
    labels are seen; of each text one stretch of up to ``window`` words is used.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    encoded = [t.lower().encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    w = words(np.frombuffer(b"".join(encoded), np.uint8), offsets, lower=False)
    hashes = w.hashes()
    _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    owner, ids = features(w.buf, w.start[where], w.end[where])
    bounds = np.searchsorted(owner, np.arange(len(where) + 1))
    stretches = []
    first = np.concatenate(([0], np.cumsum(w.counts)))
    for i, lang in enumerate(langs):
        n = int(w.counts[i])
        at = int(first[i]) + (int(rng.integers(0, n - window + 1)) if n > window else 0)
        for lo in range(at, max(at + min(n, 1), at + min(n, window) - 3), 16):  # short texts are stretches too
            stretches.append((inverse[lo : min(lo + 16, at + min(n, window))], names.index(lang)))
    k = len(names)
    weights, trans, start = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(a, 1e-3) for a in (weights, trans, start)]
    for _ in range(epochs if k > 1 else 0):
        order = rng.permutation(len(stretches))
        for lo in range(0, len(order), 512):
            some = [stretches[i] for i in order[lo : lo + 512]]
            # neighbours form one sequence of two stretches
            tokens = np.concatenate([s for s, _ in some])
            labels = np.concatenate([np.full(len(s), y) for s, y in some])
            counts = np.array([sum(len(s) for s, _ in some[i : i + 2]) for i in range(0, len(some), 2)])
            used, local = np.unique(tokens, return_inverse=True)
            lens = bounds[used + 1] - bounds[used]
            flat = np.repeat(bounds[used] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            feats, of = ids[flat], np.repeat(np.arange(len(used)), lens)
            emit = np.add.reduceat(weights[feats], np.concatenate(([0], np.cumsum(lens)[:-1])), axis=0)[local]
            gamma = forward_backward(emit, counts, trans, start, chunk=32)
            wrong = -gamma
            wrong[np.arange(len(labels)), labels] += 1
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, local, wrong)
            grad = np.zeros_like(weights)
            np.add.at(grad, feats, per_word[of])
            ends = np.cumsum(counts)
            inner = np.ones(len(labels), bool)
            inner[ends - 1] = False
            a = np.flatnonzero(inner)
            pair = gamma[a][:, :, None] * gamma[a + 1][:, None, :] * np.exp(trans)[None]
            pair /= pair.sum((1, 2), keepdims=True)
            moves = -pair.sum(0)
            np.add.at(moves, (labels[a], labels[a + 1]), 1)
            begin = np.zeros(k)
            np.add.at(begin, labels[np.concatenate(([0], ends[:-1]))], 1)
            begin -= gamma[np.concatenate(([0], ends[:-1]))].sum(0)
            for value, g, s in zip((weights, trans, start), (grad, moves, begin), sums):
                g /= len(some)
                s += g * g
                value += 0.2 * g / np.sqrt(s)
    return Model(names, weights.astype(np.float32), np.clip(trans, -6, 6), np.clip(start, -3, 3))


def shares(emit: np.ndarray, inverse: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, model: Model, most: int = 1 << 20, around: int = 256) -> np.ndarray:
    """Sums of the words' label probabilities by text. A single text of more than
    ``most`` words is labelled in stretches with ``around`` words before and after,
    beyond which words hardly bear on each other, so memory stays bounded."""
    n = len(inverse)
    step = n if rows > 1 else most
    share = np.zeros((rows, emit.shape[1]))
    for s in range(0, n, step):
        a, b, e = max(0, s - around), min(n, s + step + around), min(n, s + step)
        scores = emit[inverse[a:b]] * weight[a:b, None]
        gamma = forward_backward(scores, np.bincount(row[a:b], minlength=rows), model.trans, model.start)[s - a : e - a] * weight[s:e, None]
        share += np.stack([np.bincount(row[s:e], g, rows) for g in gamma.T], 1)
    return share


def _predict(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = model_of()
        for batch in batches:
            column = batch.column(1)
            lowered = pa.array([None if t is None else t.lower() for t in column.to_pylist()], pa.string())
            data, offsets = string_parts(lowered)
            langs, scores = [], []
            # more labels, shorter slices: transfer matrices are labels by labels
            for lo, hi in slices(offsets, max_bytes=SLICE * 8 // max(8, len(model.langs) if model else 1)):
                w = words(data, offsets[lo : hi + 1], lower=False)
                rows = hi - lo
                share = np.zeros((rows, len(model.langs) if model else 1))
                lettered = np.zeros(rows, bool)
                if len(w.start):
                    letters = np.concatenate(([0], np.cumsum(_LETTER[w.buf])))
                    weight = (letters[w.end] > letters[w.start]).astype(float)
                    lettered = np.bincount(w.row, weight, rows) > 0
                    if model:
                        _, where, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                        emit = emissions(model.weights, *features(w.buf, w.start[where], w.end[where]), len(where))
                        share = shares(emit, inverse, weight, w.row, rows, model)
                for i in range(rows):
                    # bytes above ASCII may be marks: only then the characters are looked at
                    text = column[lo + i].as_py() if lettered[i] and model else None
                    if text is None or not any(map(str.isalpha, text)):
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        best = int(share[i].argmax())
                        langs.append(model.langs[best])
                        scores.append(float(min(1.0, share[i, best] / max(share[i].sum(), 1e-12))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    return run


def fit(docs: DataFrame, per_lang: int = 400, max_langs: int = 64, window: int = 128) -> Model | None:
    """Learns from ``docs(doc_id, text, lang)`` on a bounded sample: of each of the
    ``max_langs`` most frequent languages ``per_lang`` texts by the order of their
    hashed keys, a stretch of up to ``window`` words of each. None if nothing is
    labelled. Repeated keys are ordered by their texts' hashes, so refits agree."""
    known = docs.where("lang is not null and text is not null and text rlike '[A-Za-z\\\\x{80}-\\\\x{10FFFF}]'")
    common = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    if not common:
        return None
    known = known.where(F.col("lang").isin(common))
    # salted first, so that a frequent language is no task of its own
    ids = known.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.col("h"), F.lit(16)))
    for by in (("lang", "salt"), ("lang",)):
        ids = ids.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("n") <= per_lang)
    spoken = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = known.join(F.broadcast(ids.select("doc_id", "h").distinct()), "doc_id").select("lang", "h", F.xxhash64("text").alias("t"), spoken.alias("w"))
    first = F.pmod(F.col("t"), F.greatest(F.lit(1), F.size("w") - window + 1)).cast("int") + 1
    rows = rows.select("lang", "h", "t", F.array_join(F.slice("w", first, F.lit(window)), " ").alias("text"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= per_lang)
    found = sorted((r.text, r.lang) for r in rows.select("text", "lang").collect())
    return train([t for t, _ in found], [v for _, v in found], window) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score)``, a row per input row.

    A text that is null or without letters is ``und`` with score 0, and so is
    every text if nothing was learned. Only the text decides. Further columns
    and their names do not matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # 2 ** BITS weights a language, whatever the input
    return spread(docs.select("doc_id", "text")).mapInArrow(_predict(lambda: sent.value), "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    return F.coalesce(remainder(F.col(key), 3) == 1, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Fits on the rows outside the held-out third of keys and labels all rows."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
