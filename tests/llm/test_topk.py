import numpy as np
import pandas as pd

from wavemill.llm import topk


def brute(ids, vectors, k=10):
    x = np.floor(1024 * vectors).astype(np.int64)
    out = {}
    for i, q in zip(ids, x):
        if i % 100 == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), int(s[j])) for j in order]
    return out


def check(spark, ids, vectors):
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.embeddings_top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == brute(ids, vectors)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 12))
    v = centers[rng.integers(0, 6, 900)] + rng.normal(size=(900, 12)) * 0.3
    v *= rng.uniform(0.2, 3, (900, 1))
    v[300:340] = v[300]  # equal vectors, more than k
    check(spark, rng.permutation(900), v)
    check(spark, np.arange(0, 500, 100), rng.normal(size=(5, 3)))


def test_bounds_hold_and_stop():
    """No score exceeds its annulus's bound, and on clustered vectors a query's
    k-th score rules out most annuli."""
    rng = np.random.default_rng(5)
    x = np.floor(1024 * (rng.normal(size=(48, 16))[rng.integers(0, 48, 20000)] + rng.normal(size=(20000, 16)) * 0.05))
    pivots = topk.fit_pivots(x[:4096])
    d = topk.distances(x, pivots)
    near = d.argmin(1)
    dist = d[np.arange(len(x)), near]
    edges = np.stack([np.quantile(dist[near == i], np.linspace(0, 1, 9)[1:-1]) for i in range(len(pivots))])
    ring = (edges[near] <= dist[:, None]).sum(1)
    rows = pd.DataFrame({"pivot": near, "ring": ring, "dist": dist, "norm": (x**2).sum(1)})
    cells = rows.groupby(["pivot", "ring"], as_index=False).agg(r1=("dist", "min"), r2=("dist", "max"), top=("norm", "max"))
    q = x[:200]
    best = topk.bounds(q, pivots, cells)
    score = q @ x.T
    for c, (p, r) in enumerate(zip(cells["pivot"], cells["ring"])):
        assert (score[:, (near == p) & (ring == r)].max(1) <= best[:, c]).all()
    floor = np.sort(score, 1)[:, -11]
    assert (best >= floor[:, None]).mean() < 0.25


def test_odd_rows(spark):
    rows = [(100, [1.0, 2.0]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (1, [0.5, -3.0]), (None, [1.0, 1.0]), (2, []), (1, [0.5, -3.0])]
    got = topk.embeddings_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 1, 1024 * 512 - 2048 * 3072)]
    assert topk.embeddings_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_widths_apart(spark):
    """Each width is searched by itself, also where most rows have another one; a query id with two vectors is one query."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=3 if i % 4 else 2)]) for i in range(0, 900, 5)] + [(1000, [1.0]), (300, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.embeddings_top_k(df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    floors = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for query in {i for i, _ in rows if i % 100 == 0}:
        q = min(v for i, v in floors if i == query)
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in floors if len(v) == len(q) and i != query)[:3]
        assert got.get(query, []) == [(i, -s) for s, i in best]
    assert 1000 not in got
