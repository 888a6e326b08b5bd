import numpy as np

from wavemill.llm import ego_join


def brute(rows, cosine=0.9):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))}
    width = max((len(v) for v in good.values()), default=0)
    ids = sorted(good)
    u = np.array([np.pad(good[i], (0, width - len(good[i]))) for i in ids])
    u = u / np.abs(u).max(1, keepdims=True) if len(u) else u
    u = u / np.linalg.norm(u, axis=1, keepdims=True) if len(u) else u
    hit = u @ u.T >= cosine if len(u) else np.zeros((0, 0), bool)
    out = {i: (0, i) for i, _ in rows}
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(ids):
            low = min(label[ids[b]] for b in np.flatnonzero(hit[a])) if hit[a].any() else i
            if low < label[i]:
                label[i], changed = low, True
    for a, i in enumerate(ids):
        out[i] = (int(hit[a].sum()) - int(hit[a, a]), label[i])
    return out


def check(spark, rows):
    got = ego_join.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id), r


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 10))
    v = centers[rng.integers(0, 40, 700)] + rng.normal(size=(700, 10)) * rng.choice([0.02, 0.3, 0.6], (700, 1))
    v *= rng.uniform(0.1, 5, (700, 1))
    v[100:130] = v[100]
    rows = [(int(i) * 7, [float(c) for c in x]) for i, x in zip(rng.permutation(700), v)]
    check(spark, rows)


def test_recursion_on_many_leaves(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ego_join, "LEAF", 16)
    v = rng.normal(size=(20, 6))[rng.integers(0, 20, 300)] + rng.normal(size=(300, 6)) * 0.2
    u = ego_join.unit(v)
    axes = ego_join.axes_of(u)
    u = u[np.argsort(ego_join._codes(ego_join.cells_of(u @ axes, 0.45)), kind="stable")]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    one = ego_join.link_blocks(u, None, np.ones(300, np.int64), axes, 0.9)
    assert (one[0] == hit.sum(1)).all()
    two = ego_join.link_blocks(u[:130], u[130:], np.ones(300, np.int64), axes, 0.9)
    hit[:130, :130] = hit[130:, 130:] = False
    assert (two[0] == hit.sum(1)).all()
    for i, j in zip(*np.nonzero(hit)):
        assert two[1][i] == two[1][j]


def test_odd_rows(spark):
    check(spark, [(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (None, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [1e-200, 0.0])])
    check(spark, [(1, None)])
    assert ego_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_large_groups_and_clusters(spark, monkeypatch):
    """Dense groups that span blocks, and clusters whose blocks need not meet."""
    monkeypatch.setattr(ego_join, "BLOCK", 64)
    monkeypatch.setattr(ego_join, "LEAF", 16)
    rng = np.random.default_rng(6)
    dense = rng.normal(size=8) + rng.normal(size=(400, 8)) * 0.05
    spread = rng.normal(size=(30, 8))[rng.integers(0, 30, 500)] + rng.normal(size=(500, 8)) * 0.05
    v = np.concatenate((dense, spread))
    check(spark, [(int(i), [float(c) for c in x]) for i, x in zip(rng.permutation(900), v)])


def test_order_and_boxes():
    """The order refines the join's cells, and far clusters share no near boxes."""
    rng = np.random.default_rng(7)
    u = ego_join.unit(rng.normal(size=(60, 24))[rng.integers(0, 60, 100_000)] + rng.normal(size=(100_000, 24)) * 0.05)
    axes = ego_join.axes_of(u[:4096])
    eps = float(np.sqrt(0.2))
    z = u @ axes
    order = np.argsort(ego_join.order_codes(z, eps), kind="stable")
    codes = ego_join._codes(ego_join.cells_of(z, eps))[order]
    assert (np.diff(codes) >= 0).all()
    runs = [z[order[i : i + ego_join.LEAF]] for i in range(0, len(z), ego_join.LEAF)]
    low, high = np.array([r.min(0) for r in runs]), np.array([r.max(0) for r in runs])
    gap = np.maximum(np.maximum(low[:, None] - high[None], low[None] - high[:, None]), 0)
    assert ((gap**2).sum(-1) <= eps * eps).mean() < 0.3


def test_tiles_hold_every_pair_once(spark):
    """Numbers run on over partitions, and a tile's blocks travel once."""
    names = [(p << 32) + i for p, n in ((0, 3), (2, 1), (3, 7)) for i in range(n)]
    blocks = spark.createDataFrame([(b,) for b in names], "block long").repartition(3)
    assert [r.place for r in ego_join.numbered(blocks).orderBy("block").collect()] == list(range(11))
    pairs = [(a, b) for a in names for b in names if a < b]
    got = ego_join.tiles(spark.createDataFrame(pairs, "a long, b long"), blocks, 4).collect()
    place = {b: i // 4 for i, b in enumerate(names)}
    assert sorted((r.a, r.b) for r in got) == sorted(pairs + [(b, b) for b in names])
    assert all((r.s, r.t) == (place[r.a], place[r.b]) for r in got)
    # two blocks for each of 55 pairs and one for each itself, unless by tiles
    assert len({(r.s, r.t, x) for r in got for x in (r.a, r.b)}) == 33


def test_large_tiles(spark, monkeypatch):
    """Blocks that all meet, several to a tile's side, in groups over all of them."""
    monkeypatch.setattr(ego_join, "BLOCK", 32)
    monkeypatch.setattr(ego_join, "LEAF", 16)
    sides = []
    dealt = ego_join.tiles
    monkeypatch.setattr(ego_join, "tiles", lambda pairs, blocks, side: sides.append(side) or dealt(pairs, blocks, side))
    rng = np.random.default_rng(8)
    v = rng.normal(size=(25, 3))[rng.integers(0, 25, 1500)] + rng.normal(size=(1500, 3)) * 0.4
    check(spark, [(int(i), [float(c) for c in x]) for i, x in zip(rng.permutation(1500), v)])
    assert sides[0] > 1
