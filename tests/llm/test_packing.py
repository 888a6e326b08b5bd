import itertools
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from wavemill.llm import packing

P = pytest.importorskip("public_tokenizers")


def fewest(lengths, size):
    items = sorted(lengths, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, rest + [room - items[i]])
        go(i + 1, bins + [size - items[i]])

    go(0, [])
    return best[0]


def histogram(lengths):
    return {k: lengths.count(k) for k in set(lengths)}


def test_plan_is_optimal_on_small_cases():
    rnd = random.Random(5)
    for _ in range(60):
        lengths = [rnd.randrange(3, 28) for _ in range(rnd.randrange(1, 11))]
        plan = packing.bin_completion(histogram(lengths), 30, effort=5000, keep=50, nodes=20000)
        assert sum(n for _, n in plan) == fewest(lengths, 30), lengths
        assert sorted(itertools.chain(*[c * n for c, n in plan])) == sorted(lengths)
        assert all(sum(c) <= 30 for c, _ in plan)


def test_best_fit_packs_everything():
    rnd = random.Random(6)
    for _ in range(30):
        counts = {rnd.randrange(1, 2049): rnd.randrange(1, 400) for _ in range(60)}
        for plan in (packing.best_fit_decreasing(counts, 2048), packing.bin_completion(counts, 2048)):
            got = {}
            for contents, n in plan:
                assert n > 0 and sum(contents) <= 2048
                for c in contents:
                    got[c] = got.get(c, 0) + n
            assert got == counts


def test_pieces(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(7)
    texts = [None, "", " \n", "Hello, World's 3.14!", "é É́ éx\x1cy! ﬁ", "<|endoftext|> a <|ENDOFTEXT|>, x<|EndOfText|>. 'S, É. á. ².", "word " * 9000]
    texts += [" ".join(rnd.choice(["alpha", "Beta", "gamma,", "d3lta"]) for _ in range(rnd.randrange(1, 900))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "x", 3)], "doc_id long, text string, length int")
    rows = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for r in rows:
        if r.doc_id is not None:
            want = np.array(ids[r.doc_id][r.start : r.start + 2048], "<u4")
            assert r.length == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes()) and r.start == 2048 * r.piece
    assert len(rows) == sum(-(-len(v) // 2048) for v in ids.values()) + 2
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_unit_ids_equal_the_tokenizers(name):
    import pyarrow as pa
    from wavemill.llm.textnum import string_parts

    ids_of = packing.UnitIds(P.path(name))
    assert ids_of.by_unit == (name == "word_bpe_49k.json")
    rnd = random.Random(11)
    signs = [*"abHTWYJKIis tmld'.,!?-_|<>0123 \t\n\x0b\x1c\x85\xa0éÉßÿ÷×İıΣσςÅK가日ू😀=\x00", "́", "̇", "̱", "̊", "̸", "̈", "⃗", "<|endoftext|>", "<|EndOfText|>", "'s", "'LL", ". "]
    texts = [None, "", "İ.", "." * 5000, "H̱."] + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 30))) for _ in range(20000 if ids_of.by_unit else 200)]
    column = pa.array(texts, pa.string())
    got, counts = ids_of(*string_parts(column), column)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert got[at[i] : at[i + 1]].tolist() == ids_of.tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_search_memory():
    """A deep search holds one histogram and one plan, not copies of both for each bin."""
    import tracemalloc

    counts = {k: 1 + k % 7 for k in range(1, 401)}
    tracemalloc.start()
    plan = packing.bin_completion(counts, 400, effort=20, nodes=400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = Counter()
    for contents, n in plan:
        assert sum(contents) <= 400
        got.update({k: n * v for k, v in Counter(contents).items()})
    assert got == counts and peak < 2_000_000
