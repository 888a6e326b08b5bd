import random
import re

from pyspark.sql import Row

from wavemill.llm import parity_join
from wavemill.llm.parity_join import jaccard_components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, n))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if den * inter >= num * union:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed, copies=40):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 6, 12, 30, 120, 400]))]
        for _ in range(copies // 4):
            t = list(base)
            for _ in range(rnd.randrange(0, max(1, len(t) // 15) + 1)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                t = t[: max(1, len(t) - rnd.randrange(0, 1 + len(t) // 8))]
            rows.append((" " if rnd.random() < 0.5 else "\n").join(t).title())
    rnd.shuffle(rows)
    return [(i * 3 + 5, t) for i, t in enumerate(rows)]


def check(spark, rows, n, num, den):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, component_id="x", node=1) for i, t in rows], "doc_id long, text string, component_id string, node int")
    got = jaccard_components(docs, n, num, den).collect()
    want = brute(rows, n, num, den)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id), r
    sizes = {i: len(shingles(t, n)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_against_brute_force(spark):
    check(spark, corpus(1), 3, 9, 10)
    check(spark, corpus(2), 5, 4, 5)


def test_group_of_many_tiles(spark, monkeypatch):
    """Texts of one leader that are mostly not linked to it, dealt over many tiles."""
    monkeypatch.setattr(parity_join, "TILE", 8)
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in rnd.sample(range(40), rnd.randrange(1, 4)):
            t[k] = f"z{rnd.randrange(3)}"
        rows.append((i, " ".join(t)))
    check(spark, rows, 2, 4, 5)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (None, "one two"), (8, "x " * 30000), (9, "x " * 20000), (9, "x " * 20000), (10, "é e"), (11, "É e")]
    check(spark, rows, 3, 9, 10)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).collect() == []


def test_rows_of_one_document(spark):
    """Different texts under one doc_id, also empty ones, share a component, and join those of others."""
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (1, "u v w x y z"), (7, ""), (7, "k l m n"), (7, None), (9, "k l m n"), (8, ""), (8, None), (3, "q r s t"), (3, "q r s t"), (2, "one two three four"), (2, "five six seven eight")]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect())
    want = {5: 1, 1: 1, 7: 7, 9: 7, 8: 8, 3: 3, 2: 2}
    assert got == sorted((i, len(shingles(t, 3)), want[i]) for i, t in rows)
