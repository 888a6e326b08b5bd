import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavemill.llm import max_tree as module
from wavemill.llm.max_tree import MaxTree, search

DOCS, ITEMS = "doc_id long, text string, terms int, n string", "item_id long, text string, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    count, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    texts = defaultdict(set)
    for i, t in items:
        texts[i].add(t)
    out = []
    for item, own in texts.items():
        query = Counter(w for t in own for w in terms(t))
        found = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * count // length
            score = sum(r * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in query.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def check(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = sorted(map(tuple, search(d, b, k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == brute(docs, items, k)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocab = [f"t{i}" for i in range(60)] + ["É", "日本", "B2"]
    text = lambda n: "".join(w + rnd.choice([" ", ".", "\n"]) for w in rnd.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=n))
    docs = [(i, text(rnd.randrange(0, 40))) for i in range(n)]
    docs += [(n + i, docs[i % 9][1]) for i in range(80)]  # equal scores
    rnd.shuffle(docs)
    return docs, [(i, text(rnd.randrange(1, 25))) for i in range(15)]


@pytest.mark.parametrize("shard,entries,fan", [(1 << 20, 1 << 20, 16), (500, 40, 3)])
def test_against_brute_force(spark, monkeypatch, shard, entries, fan):
    """Also with many shards and levels and with items searched in several passes."""
    for name, value in (("SHARD", shard), ("ENTRIES", entries), ("FAN", fan)):
        monkeypatch.setattr(module, name, value)
    docs, items = corpus(fan)
    check(spark, docs, items, 5)
    check(spark, docs, items, 1000)


def test_edges(spark):
    """Nulls and repeats on both sides, items without terms, ties, a term in all documents."""
    docs = [(1, None), (2, ""), (9, "a B"), (3, "A b"), (3, "a b"), (None, "a b"), (4, "a"), (5, "É é"), (6, "...")]
    items = [(1, "a"), (1, "a"), (1, "b"), (2, None), (3, ".,"), (None, "b b"), (4, "zzz"), (5, "é")]
    check(spark, docs, items, 3)
    check(spark, [(1, "a"), (2, "a")], [(1, "a")], 3)
    check(spark, [(7, "one")], [(1, "one")], 3)


def test_long_text(spark):
    check(spark, [(1, "lang text " * 300_000), (2, "lang"), (3, "kurz text")], [(1, "lang text")], 3)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    docs = spark.createDataFrame([], DOCS)
    assert search(docs, none).collect() == search(docs, some).collect() == []
    assert search(spark.createDataFrame([(1, "a", 1, "")], DOCS), none).collect() == []


def test_bounds_hold_and_prune():
    """A node's bound is the highest of its children at least, and a search opens few nodes."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 4000)
    term = np.concatenate([np.sort(rng.choice(300, s, replace=False)) for s in sizes])
    tree = MaxTree(list(range(4000)), sizes, term, rng.integers(1, 1000, len(term)), np.arange(300), 300)
    weight = np.zeros(300, np.int64)
    weight[[5, 250, 299]] = [1, 2, 1]
    levels = [tree.sums(v, 0, len(tree.ptr[v]) - 1, weight) for v in range(len(tree.ptr))]
    for low, high in zip(levels, levels[1:]):
        assert all(high[i // module.FAN] >= s for i, s in enumerate(low))
    opened = []
    inner = tree.sums
    tree.sums = lambda level, lo, hi, w: opened.append(level) or inner(level, lo, hi, w)
    best = tree.search(weight, 5, [])
    assert [-b[0] for b in best] == sorted(levels[0], reverse=True)[:5]
    assert len(opened) < 4000 / module.FAN / 2
