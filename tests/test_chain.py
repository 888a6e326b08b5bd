"""Features over chunk borders, and files to text through gate and features."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.config import GateConfig
from wavemill.operators import chain, decode, features
from wavemill.sources.wav import read_wav


@pytest.mark.parametrize("frames", [1, 4, 64])
def test_blocks_equal_whole_utterance(spark, frames):
    """Utterances in parts of any lengths, also shorter than a hop, of whole hops, and longer than a block."""
    rng = np.random.default_rng(4)
    rows, whole = [], {}
    for u, n in enumerate([1, 159, 160, 161, 640, 3000, 10_240, 25_000]):
        x = rng.normal(size=n).astype(np.float32)
        whole[u] = x
        at = 0
        while at < n:
            size = int(rng.choice([1, 50, 500, 4000])) if n < 3000 else int(rng.choice([700, 4000]))
            rows.append((u, at, [float(v) for v in x[at : at + size]], n, "x"))
            at += size
    parts = spark.createDataFrame(rows[::-1], "u long, at long, samples array<float>, total long, block string")
    got = {}
    for r in features.normalised_blocks(features.framed_blocks(parts, ["u"], n_mels=12, frames=frames), ["u"]).collect():
        assert r.first == r.block * frames and len(r.features) <= frames
        for i, f in enumerate(r.features):
            got[r.u, r.first + i] = f
    for u, x in whole.items():
        want = features.log_mel(x, 12).T
        assert sum(k[0] == u for k in got) == len(want) == len(x) // 160 + 1
        assert np.allclose([got[u, t] for t in range(len(want))], want, atol=2e-3), u


def wav(path, x):
    body = np.round(x * 32_767).astype("<i2").tobytes()
    path.write_bytes(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, 16_000, 32_000, 2, 16, b"data", len(body)) + body)


def test_files_to_text(spark, tmp_path):
    """Every file is a source; silence reaches no feature, and the utterances hold the samples of their times."""
    rng = np.random.default_rng(1)
    tone = lambda n: 0.5 * np.sin(np.arange(n) * rng.uniform(0.05, 0.3))
    wav(tmp_path / "a.wav", np.concatenate((np.zeros(5000), tone(9000), np.zeros(6000), tone(12_000), np.zeros(3000))))
    wav(tmp_path / "b.wav", tone(7000))
    wav(tmp_path / "silent.wav", np.zeros(20_000))
    chunks = read_wav(spark, str(tmp_path)).where("error is null")
    vocabulary = [f"▁w{i}" for i in range(27)] + ["<|en|>"]
    got = chain.speech_to_text(chunks, decode.FeatureTransducer, vocabulary, by="path", n_mels=8).orderBy("path", "id").collect()
    assert [(r.path[-5], r.id) for r in got] == [("a", 0), ("a", 1), ("b", 0)]
    assert all(r.text.startswith("w") for r in got)
    assert [(r.start_ns // 62_500, r.end_ns // 62_500) for r in got[:2]] == [(4608 - 480, 14_336 + 480), (19_968 - 480, 32_256 + 480)]
    # the same texts from whole arrays
    placed = {p: np.concatenate([r.samples for r in rows]) for p, rows in ((p, chunks.where(F.col("path") == p).orderBy("seq").collect()) for p in {r.path for r in got})}
    model = decode.FeatureTransducer()
    for r in got:
        cut = placed[r.path][r.start_ns // 62_500 : r.end_ns // 62_500].astype(np.float64)
        assert features_text(model, cut, vocabulary) == r.text


def features_text(model, x, vocabulary):
    y = x.copy()
    y[1:] -= 0.97 * x[:-1]
    shape = np.zeros(512)
    shape[56:456] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399)
    cut = np.lib.stride_tricks.sliding_window_view(np.pad(y, 256), 512)[::160][: len(x) // 160 + 1]
    logs = np.log(np.abs(np.fft.rfft(cut * shape, axis=1)) ** 2 @ features.mel_basis(8, exact=True).T + 2.0**-24)
    valid = len(x) // 160
    f = np.zeros_like(logs)
    f[:valid] = (logs[:valid] - logs[:valid].mean(0)) / (logs[:valid].std(0, ddof=1) + 1e-5)
    encoded = model.encode(f)
    ids = decode.greedy_decode(model.joint, encoded, encoded.shape[1], model.size, model.state)
    return "".join(vocabulary[i] for i in ids if i < len(vocabulary) and vocabulary[i] != "<|en|>").replace("▁", " ").strip()


def test_empty(spark):
    none = spark.createDataFrame([(1, 0, None), (1, 1, [])], "source_id long, seq long, samples array<float>")
    assert chain.speech_to_text(none, decode.FeatureTransducer, ["a"], config=GateConfig(), n_mels=8).collect() == []
    assert chain.speech_features(none.where("seq > 5"), n_mels=8).collect() == []
