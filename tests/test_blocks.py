"""Two-level sums, halo blocks and the interval join against plain loops."""

import random

from wavemill.operators import blocks
from wavemill.operators.blocks import halo_blocks, place, running_sum, within


def chunked(seed, sources=3, n=40):
    rnd = random.Random(seed)
    rows, whole = [], {}
    for s in range(sources):
        whole[s] = []
        for k in range(n if s else 3 * n):  # source 0 is the hot one
            x = [rnd.randrange(100) / 4 for _ in range(rnd.choice([0, 1, 3, 17]))]
            whole[s] += x
            rows.append((s, k * 5 - 7, x if x or k % 2 else None, "extra"))
    rnd.shuffle(rows)
    return rows, whole


SCHEMA = "source_id long, seq long, samples array<double>, total_ string"


def test_place_and_running_sum(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 8)
    rows, whole = chunked(1)
    got = {(r.source_id, r.seq): r for r in place(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    at = dict.fromkeys(whole, 0)
    for s, k, x, _ in sorted(rows, key=lambda r: r[:2]):
        assert (got[s, k].start_sample, got[s, k].total) == (at[s], len(whole[s]))
        at[s] += len(x or [])
    some = spark.createDataFrame([(1, i // 3, i, i % 4) for i in range(50)], "u long, b long, i long, v long")
    here = {r.i: (r.upto, r.below) for r in running_sum(running_sum(some, ["u"], "b", ["i"], "v", "upto"), ["u"], "b", ["i"], "v", "below", here=False).collect()}
    assert all(here[i] == (sum(j % 4 for j in range(i + 1)), sum(j % 4 for j in range(i))) for i in range(50))


def test_halo_blocks(spark):
    rows, whole = chunked(2)
    placed = place(spark.createDataFrame(rows, SCHEMA))
    for size, before, after in ((10, 0, 0), (16, 5, 3), (4, 30, 9)):
        got = {(r.source_id, r.block): (r.lo, r.samples) for r in halo_blocks(placed, ["source_id"], size, before, after).collect()}
        for s, x in whole.items():
            for k in range(-(-len(x) // size)):
                lo = max(0, k * size - before)
                assert got[s, k] == (lo, x[lo : (k + 1) * size + after])


def test_interval_join(spark, monkeypatch):
    """Short and long intervals, overlapping ones, and ones past the end."""
    monkeypatch.setattr(blocks, "BUCKET", 32)
    rows, whole = chunked(3)
    rnd = random.Random(3)
    intervals = [(i % 4, i, lo, lo + rnd.choice([0, 1, 7, 60, 500]), "x") for i in range(60) for lo in [rnd.randrange(0, 400)]]
    placed = place(spark.createDataFrame(rows, SCHEMA))
    found = spark.createDataFrame(intervals, "source_id long, n long, start_sample long, end_sample long, total string")
    parts = {}
    for r in within(found, placed).collect():
        assert r.at not in parts.setdefault(r.n, {})
        parts[r.n][r.at] = r.samples
    for s, n, lo, hi, _ in intervals:
        want = whole.get(s, [])[lo:hi]
        have = parts.get(n, {})
        assert [v for at in sorted(have) for v in have[at]] == want
        assert all(at == sum(len(have[b]) for b in have if b < at) for at in have)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    placed = place(none)
    assert placed.collect() == [] and halo_blocks(placed, ["source_id"], 4, 1, 1).collect() == []
