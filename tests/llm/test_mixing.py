import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from wavemill.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = Fraction(sum(sizes.values())) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


def test_targets_and_takes(spark):
    rnd = random.Random(4)
    rows = []
    for s, n in [("b", 300), ("a", 40), (None, 20), ("é", 60), ("z", 3), ("empty", 2)]:
        for _ in range(n):
            rows.append((len(rows), None if s == "empty" else "w\t" * rnd.choice([0, 1, 7, 60, 700]), s, 1.5))
    rows += rows[:5] + [(None, "x y", "a", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mix(df.drop("target")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _x in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 200 for s in sizes), (taken, want)
    again = mixing.mix(df.drop("target").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(9)
    for _ in range(4):
        votes = {i: rnd.choice([0, 1, 5, 40, 1000]) + rnd.randrange(3) for i in range(rnd.randrange(1, 9))}
        seats = rnd.choice([0, 1, 7, 250])
        want = dict.fromkeys(votes, 0)
        for _s in range(seats if any(votes.values()) else 0):
            best = max((v for v in votes if votes[v]), key=lambda v: (Fraction(votes[v], 2 * want[v] + 1), -v))
            want[best] += 1
        df = spark.createDataFrame([(k, float(v)) for k, v in votes.items()], "k2 long, votes double").withColumn("seats", F.lit(seats).cast("long"))
        got = {r.k2: r.quota for r in mixing.apportion(df, [], "votes", "seats").collect()}
        assert got == want, (votes, seats)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_clashing_columns_and_small_corpora(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 9, 8, 7, 6), (2, "d e", "y", 9, 8, 7, 6)], "doc_id long, text string, source string, size int, target int, quota int, __size int")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "quota", "__size", "size", "source_size", "target", "taken"]
    rows = got.collect()
    # weights 1 and 2 share five words
    assert {r.doc_id: (r.size, r.quota) for r in rows} == {1: (3, 7), 2: (2, 7)} and sum(r.taken for r in rows) == 5
    assert all(abs(r.taken - r.target) < 1 for r in rows)
