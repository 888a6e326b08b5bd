import hashlib
import random
import re

import pytest

from wavemill.llm import decontaminate as module
from wavemill.llm.decontaminate import contamination, report

DOCS, ITEMS = "doc_id long, text string, items string, runs int", "item_id long, text string, pattern int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def brute(doc, items, width):
    """Of one text: number of words, hit words' ranges and the items found."""
    words = places(doc)
    hit, found = set(), set()
    for item, text in items:
        own = [w for w, *_ in places(text)]
        size = min(width, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(w for w, *_ in words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    spans = []
    for i in sorted(hit):
        if i - 1 in hit:
            spans[-1][1] = words[i][2]
        else:
            spans.append([words[i][1], words[i][2]])
    return len(words), len(hit), sorted(str(i) for i in found if i is not None), spans


def check(spark, docs, items, width):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = contamination(d, b, width).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, *brute(t, items, width)) for i, t in docs]
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [[s.start, s.end] for s in r.spans]) for r in got), key=key)
    assert rows == sorted(want, key=key)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(9)] + ["É", "日本", "B"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", "-", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 5, 9, 30]))) for i in range(12)]
    docs = []
    for i in range(60):
        t = text(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(0, 3)):
            passage = rnd.choice(items)[1]
            t += passage[rnd.randrange(len(passage)) :].upper() if rnd.random() < 0.5 else passage
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("patterns,scanned", [(1 << 17, 1 << 18), (7, 5)])
def test_against_brute_force(spark, monkeypatch, patterns, scanned):
    """Also with a benchmark of several automata and texts scanned in short stretches."""
    monkeypatch.setattr(module, "PATTERNS", patterns)
    monkeypatch.setattr(module, "SCANNED", scanned)
    docs, items = corpus(patterns)
    check(spark, docs, items, 4)


def test_edges(spark):
    """Nulls and repeats on both sides, items without words, words at text borders, equal ids of different items."""
    docs = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "x a B c"), (4, "a"), (5, "b"), (6, "b c a"), (7, "é A, b")]
    items = [(1, "a b"), (1, "a b"), (1, "c a"), (2, None), (3, " .,"), (None, "é"), (20, "b")]
    check(spark, docs, items, 10)
    check(spark, docs, items, 1)
    got = {r.doc_id: r for r in report(spark.createDataFrame([(i, t, "", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)).collect()}
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].contaminated
    assert got[6].items_sha256 == hashlib.sha256(b"1,20").hexdigest() and got[6].n_items == 2 and got[6].contaminated


def test_long_text(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    filler = "and so on " * 200_000
    row = contamination(spark.createDataFrame([(1, filler + passage + " " + filler, "", 1)], DOCS), spark.createDataFrame([(5, passage, 1)], ITEMS)).first()
    assert (row.n_words, row.n_hit, row["items"]) == (1_200_012, 12, ["5"])
    assert [(s.start, s.end) for s in row.spans] == [(len(filler), len(filler) + len(passage))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "", 1)], DOCS)
    assert [tuple(r) for r in contamination(some, none).collect()] == [(1, 2, 0, [], [])]
    assert contamination(spark.createDataFrame([], DOCS), none).collect() == []
