import itertools
import tracemalloc

import numpy as np
import pyarrow as pa

from wavemill.llm import langid


def enumerate_marginals(emit, trans, start):
    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = start[path[0]] + emit[np.arange(n), path].sum() + sum(trans[a, b] for a, b in zip(path, path[1:]))
        for i, y in enumerate(path):
            out[i, y] += np.exp(s)
    return out / out.sum(1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    counts = np.array([1, 0, 5, 3, 7, 2])
    emit = rng.normal(size=(counts.sum(), 3)) * 2
    got = langid.forward_backward(emit, counts, trans, start, chunk=2)
    at = 0
    for n in counts[counts > 0]:
        assert np.allclose(got[at : at + n], enumerate_marginals(emit[at : at + n], trans, start))
        at += n


def test_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 $$ —", None), (None, "the and of", "x"), (5, "the " * 30000, "x")], "doc_id long, text string, lang_pred string")
    model = langid.train(["the and of with"] * 5 + ["der die und nicht"] * 5, ["en"] * 5 + ["de"] * 5)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[None].lang_pred == "en" == rows[5].lang_pred
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_empty(spark):
    assert langid.identify_held_out(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_long_texts_in_stretches_and_short_texts_are_learned():
    model = langid.train(["der hund und die katze"] * 20 + ["the dog and the cat"] * 20 + ["日本語"] * 20, ["de"] * 20 + ["en"] * 20 + ["ja"] * 20)
    assert "ja" in model.langs
    rng = np.random.default_rng(2)
    emit, inverse = rng.normal(size=(50, 3)), rng.integers(0, 50, 3000)
    weight, row = np.ones(3000), np.zeros(3000, np.int64)
    whole = langid.shares(emit, inverse, weight, row, 1, model)
    parts = langid.shares(emit, inverse, weight, row, 1, model, most=700)
    assert np.allclose(whole, parts, atol=1e-6)


def test_refits_agree_with_repeated_keys(spark):
    rows = [(i % 7, f"wort {i} und der hund" if i % 2 else f"word {i} and the dog", "de" if i % 2 else "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.fit(df, per_lang=9), langid.fit(df.repartition(3), per_lang=9)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights)


def test_memory_of_a_batch():
    """A batch of 4 MB is labelled in slices that keep a worker small."""
    rng = np.random.default_rng(3)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 10))) for _ in range(20_000)])
    texts = [" ".join(rng.choice(vocabulary, 1500)) for _ in range(400)]
    model = langid.Model(list("abcd"), rng.random((1 << langid.BITS, 4), np.float32), np.zeros((4, 4)), np.zeros(4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        got = list(langid._predict(lambda: model)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, got)) == 400
    assert peak < 70e6
