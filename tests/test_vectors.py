"""Stated input and output vectors of the single operators."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.config import MS, ConfigError, GateConfig, PipelineConfig, parse_device
from wavemill.functions import clock, pcm, tokens
from wavemill.operators import decode, events, features
from wavemill.sources.wav import decode as wav_decode
from wavemill.sources.wav import read_wav


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_clock(spark):
    ns = F.lit(62_501).cast("long")
    assert one(spark, clock.ns_to_samples(ns), clock.samples_to_ns(clock.ns_to_samples(ns))) == (1, 62_500)
    second, later = F.lit(1_234_000_000).cast("long"), F.lit(2_500_000_000).cast("long")
    assert one(spark, clock.duration_ms(second, later), clock.duration_ms(later, second)) == (1266, 0)
    assert one(spark, clock.checked_add(F.lit(2**63 - 1), F.lit(1).cast("long"))) == (None,)


def test_settings():
    for longest, ok in ((341, False), (342, True)):
        if ok:
            GateConfig(max_speech=longest * MS).validate()
        else:
            with pytest.raises(ConfigError):
                GateConfig(max_speech=longest * MS).validate()
    for name in ("min_speech", "min_silence", "pad"):
        with pytest.raises(ConfigError):
            GateConfig(**{name: 999_999}).validate()
    GateConfig(min_speech=MS, min_silence=MS, pad=0).validate()
    with pytest.raises(ConfigError, match="model_dir"):
        PipelineConfig("", input_capacity=0).validate()
    assert parse_device(" TRT ") == "tensorrt"
    for bad in ("rocm", "coreml", "azure", "bogus"):
        with pytest.raises(ConfigError):
            parse_device(bad)


def test_preemphasis_and_downmix(spark):
    x = F.array(*[F.lit(float(v)) for v in (1, 2, 3)])
    assert np.allclose(one(spark, pcm.preemphasis(x))[0], [1, 1.03, 1.06], atol=1e-6)
    assert np.allclose(features.preemphasise(np.array([1, 2, 3], np.float32)), [1, 1.03, 1.06], atol=1e-6)
    assert one(spark, pcm.downmix(x, 2), pcm.downmix(x, 1), pcm.downmix(F.array(F.lit(1.0)), 2)) == ([1.5], [1, 2, 3], [])


def test_spectrum_and_normalise(spark):
    power = features.power_frames(np.array([1, 0, 0, 0], float), 8, 4, np.array([1, 2, 3, 4]))
    assert power.shape == (5, 2) and np.allclose(power[:, 0], 9, atol=1e-5)
    row = features.normalise_rows(np.array([[1, 3, 100]], np.float32), 2)
    assert np.allclose(row, [[-1 / (2**0.5 + 1e-5), 1 / (2**0.5 + 1e-5), 0]], atol=1e-5)
    with pytest.raises(ValueError):
        features.normalise_rows(np.zeros((1, 3)), 4)
    assert features.log_mel(np.zeros(16_000, np.float32)).shape == (80, 101)
    assert one(spark, pcm.valid_frames(F.lit(16_000)), pcm.total_frames(F.lit(16_000))) == (100, 101)
    basis = np.zeros((80, 257))
    for r in features.mel_filterbank(spark).collect():
        basis[r.mel, r.bin] = r.weight
    assert np.allclose(basis, features.mel_basis(80), atol=1e-6)


def test_tokens(spark):
    t = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, tokens.argmax_last(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == (2,)
    assert one(spark, tokens.detokenise(t("▁a", "<x>", "b", "<unk>"), F.lit(True)), tokens.detokenise(t("▁a", "▁b"), F.lit(False))) == ("ab<unk>", "ab")
    assert one(spark, tokens.trim_unicode(F.lit("　 a b \t"))) == ("a b",)


def test_vocabulary(spark):
    def result(*lines):
        parsed = decode.parse_vocabulary(spark.createDataFrame([(x,) for x in lines], "line string"))
        return decode.vocabulary_errors(parsed).first().result

    assert result("", "token 0", "<blank> 1") == "ok" and result("a b 0") == "ok" and result("a +0", "b 001") == "ok"
    assert result("token") == "missing_id" and result("a 0", "b 0") == "duplicate_id" and result("a 0", "b 2") == "gap"
    assert result("<blank> 0", "b 1") == "blank_not_last" and result("a 99999999999999999999999") == "bad_id"
    assert result("") == "empty" and result(" 0") == "empty_token" and result(" ") == "empty_token"
    assert result("a 0", "b 2", "c 2") == "gap" and result("a 0", "<blank> 1", "<blk> 2") == "blank_not_last"
    assert result(f"token {2**64 - 1}") == "gap" and result(f"token {2**64}") == "bad_id" and result("a -1") == "bad_id"


def test_metrics(spark):
    moves = [(1, i, 1, 0) for i in range(40)] + [(1, 40 + i, 0, 1) for i in range(45)]
    m = events.delivery_metrics(spark.createDataFrame(moves, "s long, i long, emitted int, received int"), "s", "i")
    last = m.orderBy(F.desc("i")).first()
    assert (last.pending, last.peak_pending, last.n_emitted, last.n_received) == (0, 40, 40, 45)
    assert (last.n_discarded, last.n_failures, last.receiver_closed) == (0, 0, False)
    assert [r.i for r in events.backlog_warnings(m, "s", "i").collect()] == [31]


def test_counters_stop_at_the_top(spark):
    most = (1 << 63) - 1
    moves = [(1, 0, most - 1, 0, 0, 0), (1, 1, 5, 0, 0, most), (1, 2, 0, most, 0, 1), (1, 3, 0, 1, most, 0), (1, 4, 1, 0, 1, 0)]
    m = events.delivery_metrics(spark.createDataFrame(moves, "s long, i long, emitted long, received long, discarded long, failures long"), "s", "i").orderBy("i").collect()
    assert [r.n_emitted for r in m] == [most - 1] + [most] * 4 and [r.n_failures for r in m] == [0] + [most] * 4
    assert (m[1].pending, m[1].peak_pending, m[2].pending, m[4].n_received, m[4].n_discarded) == (most, most, 4, most, most)


@pytest.mark.parametrize("bits,value", [(8, 64 + 128), (16, 16384), (24, 4194304), (32, 1073741824)])
def test_wav(spark, tmp_path, bits, value):
    body = value.to_bytes(bits // 8, "little") * 3400
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, 16_000, 2000 * bits, bits // 8, bits, b"data", len(body))
    assert set(wav_decode(head + body)) == {0.5}
    (tmp_path / "x.wav").write_bytes(head + body)
    (tmp_path / "y.wav").write_bytes(head.replace(struct.pack("<HHI", 1, 1, 16_000), struct.pack("<HHI", 1, 2, 16_000)) + body)
    got = read_wav(spark, str(tmp_path)).orderBy("path", "seq").collect()
    assert [(r.seq, r.n_samples) for r in got] == [(0, 1600), (1, 1600), (2, 200), (0, 0)]
    assert set(got[0].samples) == {0.5} and "mono" in got[3].error
