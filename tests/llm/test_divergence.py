import random
import re
from collections import Counter, defaultdict

import pytest

from wavemill.llm import divergence as module
from wavemill.llm.divergence import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, a int"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, min_docs, top):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms(text)
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s in groups:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def check(spark, rows, min_docs=3, top=200):
    docs = spark.createDataFrame([(i, t, g, s, "x", 1, 2) for i, (t, g, s) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in divergence(docs, min_docs, top).collect())
    assert got == brute(rows, min_docs, top)


@pytest.mark.parametrize("held", [1 << 19, 40])
def test_against_brute_force(spark, monkeypatch, held):
    """Also with sums that tasks send on early."""
    monkeypatch.setattr(module, "HELD", held)
    rnd = random.Random(3)
    vocab = ["der", "Die", "ÉCU", "écu", "l'", "a_b", "x1y", "日本", "z"] + [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rows = []
    for _ in range(160):
        lang, source = rnd.choice(["de", "de", "en", None, ""]), rnd.choice(["s1", "s1", "s1", "s2", "s3", "é", None])
        rows.append((" ".join(rnd.choices(vocab, weights=range(len(vocab), 0, -1), k=rnd.randrange(0, 30))), lang, source))
    check(spark, rows, 3, 5)


def test_edges(spark):
    """Nulls, texts without terms, repeated rows, ties, a language without kept terms, a single group."""
    rows = [(None, "de", "a"), ("1 2 3 [@`{", "de", "b"), ("word word", "de", "c")] + [("word other", "de", "c")] * 3
    rows += [("rare", "xx", "a"), ("odd", "xx", "b"), (None, None, None), ("b a", "fr", "only"), ("a b", "fr", "only"), ("a b", "fr", "only")]
    check(spark, rows)


def test_long_text(spark):
    check(spark, [("lang kurz " * 400_000, "de", "a"), ("lang", "de", "b"), ("kurz lang", "de", "b")], 2)


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_past_64_bits(spark):
    """Shares of counts whose product with 10^9 leaves 64 bits stay exact."""
    row = spark.range(1).selectExpr("9999999999999L c", "99999999999999L w").selectExpr(module._p("c", "w")).first()
    assert row[0] == 1 + 10**9 * (9999999999999 + 1) // 99999999999999
