"""Walks over long groups: no group in one task, array or frame, and the same results however rows are dealt."""

import random

import numpy as np
import pytest

from wavemill.config import GateConfig
from wavemill.operators import blocks, decode, gate, scan, session
from wavemill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, size)


@pytest.mark.parametrize("name", ["source_slots", "tdt_walk", "vad_max_split"])
def test_no_group_is_gathered(spark, name, request):
    df = registry.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroups" not in plan
    want = sorted(map(str, df.collect()))
    request.getfixturevalue("small_batches")
    assert sorted(map(str, registry.QUERIES[name](spark, SF).collect())) == want and want


def test_long_session(spark, small_batches):
    rng = random.Random(3)
    rows = [(1 + (i % 50 == 0), i, rng.choice([-1, 0, 1]), "x") for i in range(5_000)]
    got = {r.i: r for r in session.slots(spark.createDataFrame(rows, "u long, i long, k long, piece string"), "u", ["i"], 3).collect()}
    live, ids = {1: 1, 2: 1}, {1: 0, 2: 0}
    for u, i, k, _ in rows:
        now = max(1, min(3, live[u] + k))
        ids[u] += now > live[u]
        assert (got[i].live, got[i].source_id) == (now, ids[u] if now > live[u] else None)
        live[u] = now


def test_hot_key_is_dealt_out(spark):
    """Of rows of which most share a key, no task gets much more than its part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these are small
    rows = spark.range(40_000).selectExpr("IF(id % 10 = 0, id, 7) u", "id i", "id % 3 - 1 k")
    parts = scan.pieces(rows, "u", ["i"], session._clamped(2), "piece long, last boolean, shift long, lo long, hi long, shift0 long, lo0 long, hi0 long")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in parts.groupBy((parts.piece / 2**32).cast("long")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * 40_000 / 4
    assert parts.where("u = 7").select((parts.piece / 2**32).cast("long").alias("p")).distinct().count() >= 3


def walked(steps, blank):
    out, t = [], 0
    known = {f: (token, dur) for f, token, dur in steps}
    while t in known:
        token, dur = known[t]
        if token != blank:
            out.append((t, token, 1 if dur > 0 else 10))
        t += max(dur, 1)
    return out


@pytest.mark.parametrize("longest", [1, 4])
def test_transducer_steps(spark, small_batches, longest):
    """Against the plain walk: many short sources, a long one, a source with a missing frame, one that does not begin at 0."""
    rng = random.Random(longest)
    sources = {s: [(f, rng.randrange(4), rng.randrange(longest + 1)) for f in range(n)] for s, n in enumerate([900, 1, 2, 30, *range(1, 40)])}
    sources[100] = [x for x in sources[0] if x[0] not in (301, 302, 303, 304)]
    sources[101] = sources[0][3:]
    rows = [(s, *x, "x") for s, steps in sources.items() for x in steps]
    rng.shuffle(rows)
    got = decode.transducer_steps(spark.createDataFrame(rows, "source_id long, frame long, token long, dur long, mask string"), 3, longest=longest)
    want = [(s, *x) for s, steps in sources.items() for x in walked(steps, 3)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_steps_equal_greedy_decode(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s in range(20):
        n = int(rng.integers(1, 12))
        token, skip = rng.integers(0, 4, n), rng.integers(0, 3, n)
        rows += [(s, i, int(a), int(b)) for i, (a, b) in enumerate(zip(token, skip))]

        def joint(frame, previous, state):
            v = np.zeros(7)
            v[int(frame[0])], v[4 + int(frame[1])] = 1, 1
            return v, state

        want[s] = decode.greedy_decode(joint, np.stack([token, skip]), n, 4, None)
    got = decode.transducer_steps(spark.createDataFrame(rows, "source_id long, frame long, token long, dur long"), 3).orderBy("source_id", "frame").collect()
    assert {s: [r.token for r in got if r.source_id == s for _ in range(r.n)] for s in want} == want


def test_too_long_a_step_fails(spark):
    with pytest.raises(Exception, match="longest is 2"):
        decode.transducer_steps(spark.createDataFrame([(1, 0, 0, 3)], "source_id long, frame long, token long, dur long"), 3, longest=2).collect()


def test_capped_segments(spark, monkeypatch, small_batches):
    """Against the rules frame by frame, with long speech, gaps around the cap and null scores."""
    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(gate, "ROWS", 16)
    config = GateConfig(min_speech=40_000_000, min_silence=100_000_000, pad=0, max_speech=400_000_000)
    rng = random.Random(9)
    rows, want = [], []
    for s in range(8):
        p = 0.5
        frames = []
        for i in range(700 if s == 0 else 90):
            p = rng.random() if rng.random() < 0.25 else p
            frames.append((i, None if rng.random() < 0.02 else p))
        rows += [(s, *f) for f in frames]
        scored = [(i * 512, float("nan") if x is None else x) for i, x in frames]
        want += [(s, n, a, b) for n, (a, b) in enumerate(gate.walk(scored, 0.5, 0.35, 1600, 640, 6400 - 512, len(frames) * 512))]
    rng.shuffle(rows)
    got = gate.capped_segments(spark.createDataFrame(rows, "source_id long, i long, prob double"), config)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source_id long, frame long, token long, dur long")
    assert decode.transducer_steps(none, 3).collect() == []
    assert session.slots(spark.createDataFrame([], "u long, i long, k long"), "u", ["i"]).collect() == []
    assert gate.capped_segments(spark.createDataFrame([], "source_id long, i long, prob double")).collect() == []
