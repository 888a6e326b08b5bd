"""Contracts, recurrent scores, split WAV files and the SQL re-chunker against plain code."""

import random
import struct

import numpy as np
import pytest

from wavemill.functions import tables
from wavemill.operators import decode, recurrent
from wavemill.operators.contract import OUTLETS, check_contracts
from wavemill.sources.wav import read_wav
from wavemill.sources.wav_source import WavSource, write_wav

TENSORS = "model string, position int, location string, name string, dtype string, shape array<long>"


def sound(model, **changed):
    """Rows of a sound contract; ``changed`` by place: a (dtype, shape), or None to leave it out."""
    shapes = {0: [-1, 80, -1], 1: [-1], 2: [-1, -1, -1], 3: [-1], 6: [-1, 1024, 1], 7: [1, 1], 8: [1], 11: [-1, -1, -1, -1]}
    rows = []
    for place, location, name, kind, *_ in OUTLETS:
        dtype, shape = changed.get(f"p{place}", (kind, shapes.get(place, [2, 1, 640]))) or (None, None)
        if dtype:
            rows.append((model, place, location, name, dtype, shape))
    return rows


def test_contracts(spark):
    f = lambda *shape: ("f32", list(shape))
    cases = {
        "ok": ({}, (None, None, 80, 1024)),
        "all_dynamic": ({"p6": f(-1, -1, -1)}, (None, None, 80, None)),
        "bound": ({"p2": f(1, 512, -1), "p6": f(1, -1, 1)}, (None, None, 80, 512)),
        "missing": ({"p9": None, "p10": None}, (9, "missing", None, None)),
        "type": ({"p1": ("i32", [1])}, (1, "type", None, None)),
        "rank": ({"p3": ("i64", [1, 1])}, (3, "rank", None, None)),
        "size": ({"p13": f(2, 1, 320)}, (13, "size", None, None)),
        "invalid": ({"p7": ("i32", [1, -2])}, (7, "invalid", None, None)),
        "feature": ({"p0": f(1, -1, -1)}, (4, "dynamic_feature", None, None)),
        "feature_zero": ({"p0": f(1, 0, -1)}, (4, "invalid", None, None)),
        "encoded_zero": ({"p2": f(1, 0, -1)}, (5, "invalid", None, None)),
        "scalar": ({"p11": f()}, (12, "scalar", None, None)),
        "several": ({"p11": f(2, 7)}, (12, "several", None, None)),
        "small": ({"p11": f(1, 5)}, (12, "too_small", None, None)),
        "fits": ({"p11": f(7)}, (None, None, 80, 1024)),
        "mismatch": ({"p2": f(1, 512, -1)}, (15, "mismatch", None, None)),
        "first": ({"p14": None, "p2": f(1, 1, 1, 1), "p11": f()}, (2, "rank", None, None)),
    }
    rows = [r for model, (changed, _) in cases.items() for r in sound(model, **changed)]
    rows += [("twice", -1, "encoder input", "length", "i64", [1])] + sound("twice", p1=("f32", [1]))  # the first of a name counts
    random.Random(1).shuffle(rows)
    got = {r[0]: tuple(r[1:]) for r in check_contracts(spark.createDataFrame(rows, TENSORS), 5).collect()}
    assert got.pop("twice") == (None, None, 80, 1024)
    assert got == {model: want for model, (_, want) in cases.items()}
    other = check_contracts(spark.createDataFrame([("bare", 0, "encoder input", "else", "f32", [1])], TENSORS), 5).collect()
    assert [tuple(r) for r in other] == [("bare", 0, "missing", None, None)]


def test_models_are_not_broadcast(spark):
    """The rules go to the models' outlets, however few the models seem to be."""
    plan = check_contracts(spark.range(9).selectExpr("cast(id as string) model", "0 position", "'encoder input' location", "'length' name", "'i64' dtype", "array(1L) shape"), 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in text and "BuildLeft" not in text


def test_encoder_outputs_are_checked():
    """Padding to buckets, and the first of the broken rules."""
    met = []

    def graph(shape, lengths, drop=()):
        def run(inputs):
            met.append((inputs["audio_signal"].shape, int(inputs["length"][0])))
            out = {"outputs": np.ones(shape, np.float32), "encoded_lengths": np.array(lengths, np.int64)}
            return {k: v for k, v in out.items() if k not in drop}

        return run

    x = np.ones((80, 65), np.float32)
    assert decode.run_encoder(graph((1, 4, 16), [9]), x, 64).shape == (4, 9) and met == [((1, 80, 128), 64)]
    assert decode.padded(np.ones((3, 64))).shape == (1, 3, 64) and decode.padded(np.ones((3, 0))).shape == (1, 3, 64)
    assert decode.padded(x)[0, :, 65:].sum() == 0
    for run, text in ((graph((1, 4, 9), [9], ["outputs"]), "no outputs"), (graph((1, 4), [2], ["encoded_lengths"]), "no encoded_lengths"), (graph((4, 9), [3, 3]), "three dimensions"), (graph((2, 4, 9), [3, 3]), "batch of 2"), (graph((1, 4, 9), [3, 3]), "lengths of shape"), (graph((1, 4, 9), [-1]), "length of -1"), (graph((1, 4, 9), [10]), "10 in 9 frames")):
        with pytest.raises(decode.BackendError, match=text):
            decode.run_encoder(run, x, 64)


def test_transducer_over_graphs():
    """The adapter decodes as the stand-in does: states are handed on with tokens that are not blank only."""
    fake = decode.FeatureTransducer()

    def encoder(inputs):
        x, n = inputs["audio_signal"][0], int(inputs["length"][0])
        codes = np.floor(x[:3, :].T.astype(np.float64) @ np.array([5.0, 3.0, 7.0])) % 97
        return {"outputs": codes[None, None].astype(np.float32), "encoded_lengths": np.array([n])}

    def joint(inputs):
        state = int(inputs["input_states_1"][0, 0, 0])
        logits, following = fake.joint(inputs["encoder_outputs"][0, :, 0], int(inputs["targets"][0, 0]), state)
        states = np.full(decode.STATE, following, np.float32)
        return {"outputs": logits.astype(np.float32)[None, None, None], "output_states_1": states, "output_states_2": states}

    model = decode.OnnxTransducer(encoder, joint, fake.size)
    for n in (1, 2, 40, 200):
        x = np.random.default_rng(n).integers(-3, 4, (n, 8)).astype(np.float64)
        a, b = model.encode(x), fake.encode(x)
        assert decode.greedy_decode(model.joint, a, a.shape[1], model.size, model.state) == decode.greedy_decode(fake.joint, b, b.shape[1], fake.size, fake.state)
    with pytest.raises(decode.BackendError, match="logits"):
        decode.OnnxTransducer(encoder, joint, 40).joint(np.ones(1), 0, model.state)
    assert decode.providers("cpu") == ["CPUExecutionProvider"] and decode.providers("tensorrt")[1] == "CUDAExecutionProvider"
    assert decode.providers("qnn") == ["QNNExecutionProvider", "CPUExecutionProvider"] and decode.providers("auto")[-1] == "CPUExecutionProvider" and len(decode.providers("auto")) == 10


def test_recurrent_scores(spark, monkeypatch):
    """Sources of all lengths, long ones over many batches, and null inputs."""
    monkeypatch.setattr(recurrent, "STRETCH", 8)
    rng = np.random.default_rng(3)
    rows = [(s, i, None if rng.random() < 0.1 else [float(v) for v in rng.normal(size=2)]) for s, n in enumerate([1, 300, 7, 8, 9, 40] + [20] * 30) for i in range(n)]
    cell = recurrent.Cell(((0.5, -0.2), (0.1, 0.3)), ((1.0, 0.5), (-1.0, 2.0)), (0.1, 0.0), (1.0, 2.0), -0.3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "source_id long, i long, x array<double>")
        got = {(r.source_id, r.i): r.prob for r in recurrent.score(df, cell).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    h = {}
    for s, i, x in rows:
        if x is None:
            assert got[s, i] is None
            continue
        h[s], p = cell.step(h.get(s, cell.start(1)), np.array([x]))
        assert got[s, i] == pytest.approx(p[0], abs=1e-12)
    assert len(got) == len(rows)


def wav(path, body, bits=16, rate=16_000, extra=b""):
    path.write_bytes(struct.pack("<4sI4s", b"RIFF", 36 + len(extra) + len(body), b"WAVE") + extra + struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate * bits // 8, bits // 8, bits, b"data", len(body)) + body)


def test_splits_equal_whole_files(spark, tmp_path):
    """Any split gives the rows of the whole file; odd chunks before the data, empty and broken files too."""
    rng = np.random.default_rng(2)
    for bits in (8, 16, 24, 32):
        wav(tmp_path / f"b{bits}.wav", rng.integers(0, 256, 5001 * bits // 8, dtype=np.uint8).tobytes(), bits, extra=b"LIST\x03\x00\x00\x00abc\x00")
    wav(tmp_path / "empty.wav", b"")
    wav(tmp_path / "rate.wav", b"\0\0", rate=8_000)
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "note.txt").write_text("no audio")
    spark.dataSource.register(WavSource)
    rows = lambda df: sorted((r.path.rsplit("/", 1)[1], r.seq, r.n_samples, tuple(r.samples), r.error and r.error.split(",")[0]) for r in df.collect())
    want = rows(read_wav(spark, str(tmp_path / "*.wav"), 100))
    for split in (1, 100, 950, 10**9):
        read = spark.read.format("wav_pcm").option("chunk", 100).option("split", split).load(str(tmp_path))
        assert rows(read) == want
        if split == 950:
            assert read.rdd.getNumPartitions() == 4 * 6 + 2
    one = spark.read.format("wav_pcm").load(str(tmp_path / "b24.wav"))
    assert one.count() == 4 and spark.read.format("wav_pcm").load(str(tmp_path / "empty.wav")).count() == 0


def test_small_splits_share_tasks(spark, tmp_path):
    """Tasks do not grow with the number of splits, and every sample is read once, in any number of files."""
    body = np.random.default_rng(4).integers(-9, 9, 50_000).astype("<i2")
    wav(tmp_path / "long.wav", body.tobytes())
    for i in range(30):
        wav(tmp_path / f"s{i}.wav", b"\1\0" * i)
    spark.dataSource.register(WavSource)
    read = spark.read.format("wav_pcm").option("chunk", 10).option("split", 10).load(str(tmp_path))
    assert read.rdd.getNumPartitions() <= 65
    got = read.collect()
    assert [v for r in sorted((r for r in got if r.path.endswith("long.wav")), key=lambda r: r.seq) for v in r.samples] == (body / 32768).tolist()
    assert sum(r.n_samples for r in got) == 50_000 + sum(range(30))


def test_write_and_read(spark, tmp_path):
    """Parts of a source, nulls and clipped samples; a second run changes nothing."""
    rng = np.random.default_rng(5)
    rows = [(s, k, None if k == 3 else [float(v) for v in rng.normal(size=int(rng.integers(0, 30)))]) for s in (1, 2) for k in range(25)] + [(None, 0, [1.0])]
    df = spark.createDataFrame(rows[::-1], "source_id long, seq long, samples array<float>")
    for _ in range(2):
        made = write_wav(df, str(tmp_path / "out"), rows=10).collect()
    assert len(made) == 6 and sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{s}-{p}.wav" for s in (1, 2) for p in range(3)]
    spark.dataSource.register(WavSource)
    for s in (1, 2):
        for p in range(3):
            got = spark.read.format("wav_pcm").option("chunk", 7).load(str(tmp_path / "out" / f"{s}-{p}.wav")).orderBy("seq").collect()
            x = np.array([v for q, k, y in rows if q == s and k // 10 == p for v in y or []], np.float32)
            assert [v for r in got for v in r.samples] == (np.clip(np.floor(x.astype(float) * 32768 + 0.5), -32768, 32767) / 32768).tolist()


def test_stream_takes_each_file_once(spark, tmp_path):
    import os

    spark.dataSource.register(WavSource)
    source = tmp_path / "in"
    source.mkdir()

    def add(name, time):
        wav(source / name, np.full(250, time, "<i2").tobytes())
        os.utime(source / name, (time, time))

    def run():
        q = spark.readStream.format("wav_pcm").option("chunk", 100).load(str(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.path.rsplit("/", 1)[1], r.seq, r.n_samples) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add("b.wav", 1000)
    add("a.wav", 1000)
    want = [(f, k, n) for f in ("a.wav", "b.wav") for k, n in enumerate((100, 100, 50))]
    assert run() == want
    add("0.wav", 2000)
    assert run() == sorted(want + [("0.wav", k, n) for k, n in enumerate((100, 100, 50))])
    assert len(run()) == 9


def test_rechunk_in_sql(spark):
    tables.register(spark)
    rows = [("a", 2, [5.0, 6.0, 7.0]), ("a", 1, [1.0, 2.0, 3.0, 4.0]), ("b", 1, None), ("b", 2, [9.0]), ("c", 1, [])]
    spark.createDataFrame(rows, "who string, at int, pcm array<double>").createOrReplaceTempView("pieces")
    got = spark.sql("SELECT * FROM rechunk(TABLE(pieces), 3) ORDER BY who, chunk").collect()
    assert [tuple(r) for r in got] == [("a", 0, 3, [1.0, 2.0, 3.0]), ("a", 1, 3, [4.0, 5.0, 6.0]), ("a", 2, 1, [7.0]), ("b", 0, 1, [9.0])]
    assert spark.sql("SELECT * FROM rechunk(TABLE(SELECT * FROM pieces WHERE false), 3)").collect() == []
    for bad in ("SELECT * FROM rechunk(TABLE(SELECT who, at FROM pieces), 3)", "SELECT * FROM rechunk(TABLE(pieces), 0)"):
        with pytest.raises(Exception, match="rechunk needs"):
            spark.sql(bad).collect()
