import numpy as np
import pandas as pd
import pytest

from wavemill.config import MS, GateConfig
from wavemill.operators import gate as gate_sql
from wavemill.streaming import session as ss

SMALL = GateConfig(min_speech=4 * MS, min_silence=8 * MS, pad=2 * MS, frame=64)


def run(commands, config=SMALL, most=2):
    handler, state, out = ss.Handler(ss.Gate(config, ss.energy_score), ss.FakeModel(), most), ss.new_session(), []
    for c in commands:
        out.extend(handler.handle(state, *c))
    return out, state


LOUD, QUIET = np.ones(640, np.float32), np.zeros(640, np.float32)


def test_segment_then_end():
    out, state = run([(0, "audio", 0, None, QUIET), (1, "audio", 0, None, LOUD), (2, "audio", 0, None, QUIET), (3, "close", 0, None, None)])
    assert [r[1] for r in out] == ["segment", "reply", "end_of_stream"]
    assert out[0][5:7] == ((640 - 32) * 62500, (1280 + 32) * 62500) and state.over


def test_two_sources_share_ids_and_keep_clocks():
    out, _ = run([(0, "open", None, None, None), (1, "audio", 0, None, LOUD), (2, "audio", 1, 350 * MS, LOUD), (3, "close", 0, None, None), (4, "close", 1, None, None)])
    segments = [r for r in out if r[1] == "segment"]
    assert [(r[2], r[3], r[5]) for r in segments] == [(0, 0, 0), (1, 1, 350 * MS)]
    assert out[-1][1] == "end_of_stream" and sum(r[1] == "end_of_stream" for r in out) == 1


def test_discontinuity_is_terminal():
    out, _ = run([(0, "audio", 0, 100 * MS, np.ones(160)), (1, "audio", 0, 105 * MS, np.ones(160)), (2, "close", 0, None, None)])
    assert [(r[1], r[5], r[6], r[7]) for r in out] == [("error", 110 * MS, 105 * MS, "timestamp_discontinuity")]


def test_quantised_anchor_continues():
    out, state = run([(0, "audio", 0, 62_501, np.ones(160)), (1, "audio", 0, 62_500 * 161, np.ones(160))])
    assert not state.over and state.sources[0].offset == 1


def test_limits_unknown_sources_cancel():
    out, _ = run([(0, "open", None, None, None), (1, "open", None, None, None), (2, "close", 1, None, None), (3, "open", None, None, None), (4, "close", 9, None, None), (5, "audio", 9, None, LOUD), (6, "close", 0, None, None)])
    assert [(r[3], r[7]) for r in out] == [(1, "opened"), (None, "source_limit"), (1, "closed"), (2, "opened"), (9, "source_not_found"), (9, "source_not_found")]
    assert out[-1][1] == "error"
    assert run([(0, "audio", 0, None, LOUD), (1, "cancel", None, None, None), (2, "close", 0, None, None)])[0] == []


def test_silence_is_bounded():
    _, state = run([(i, "audio", 0, None, np.zeros(1600)) for i in range(100)], GateConfig())
    assert len(state.sources[0].buffer) <= 480 + 511


def test_cap_splits_long_speech():
    config = GateConfig(min_speech=4 * MS, min_silence=8 * MS, pad=0, frame=64, max_speech=40 * MS)
    out, _ = run([(0, "audio", 0, None, np.ones(6400)), (1, "close", 0, None, None)], config)
    ends = [r[6] - r[5] for r in out if r[1] == "segment"]
    assert len(ends) > 5 and max(ends) <= 40 * MS


def test_gate_equals_rules_and_sql(spark):
    rng = np.random.default_rng(8)
    config = GateConfig(min_speech=40 * MS, min_silence=64 * MS, pad=0)
    rows = []
    for s in range(40):
        p, x = [], 0.5
        for _ in range(60):
            x = min(1, max(0, x + rng.normal() * 0.3))
            p.append(x)
        rows += [(s, i, float(v)) for i, v in enumerate(p)]
    got = {}
    for r in gate_sql.segments(spark.createDataFrame(rows, "source_id long, i long, prob double"), config).collect():
        got.setdefault(r.source_id, []).append((r.segment, r.start_sample, r.end_sample))
    for s in range(40):
        scored = [(i * 512, v) for k, i, v in rows if k == s]
        want = list(gate_sql.walk(scored, 0.5, 0.35, 1024, 640, None, 60 * 512))
        assert sorted(got.get(s, [])) == [(n, a, b) for n, (a, b) in enumerate(want)]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_table(spark, tmp_path, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(1)
    rows = []
    for s in "ab":
        for i in range(30):
            loud = (i // 5) % 2
            rows.append((s, i, "audio" if i < 29 else "close", 0, None, (rng.normal(size=200) * (1.0 if loud else 0.001)).astype(float).tolist()))
    schema = "session_id string, cmd_seq long, cmd string, source_id long, ts_ns long, samples array<float>"
    source = tmp_path / "in"
    for p in range(parts):
        some = [r for r in rows if r[1] * parts // 30 == p]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(source))
    want = sorted(map(str, ss.transcribe_table(spark.createDataFrame(rows, schema), SMALL).collect()))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    q = ss.transcribe_stream(stream, SMALL).writeStream.format("memory").queryName(f"out{parts}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table(f"out{parts}").collect())) == want and len(want) > 6
