import re

import corpus_pipeline as cp
from wavemill.llm.base import cut

from .test_parity_join import shingles


def test_stages_on_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in cp.STAGES:
        after = cut(stage(spark, before, "/root/testdata/sf0.001"))
        if name != "packing":
            assert after.columns == docs.columns
        rows, left = before.collect(), after.collect()
        if name == "language_id":
            assert len(left) >= 0.98 * len(rows)
        if name == "near_duplicates":
            sets = {r.doc_id: shingles(r.text, 5) for r in rows}
            kept = {r.doc_id for r in left}
            for i, s in sets.items():  # whoever went has a partner, and no two that stay are linked
                near = [j for j, t in sets.items() if j != i and 5 * len(s & t) >= 4 * len(s | t)]
                assert (i in kept) or near
                assert not (i in kept and any(j in kept for j in near))
        if name == "pii":
            assert not any(re.search(r"\w@\w+\.\w", r.text) for r in left) and len(left) == len(rows)
        if name == "mixing":
            words = {r.doc_id: len(r.text.split()) for r in rows}
            assert abs(sum(words[r.doc_id] for r in left) - sum(words.values())) < 0.25 * sum(words.values())
            assert {r.text for r in left} <= {r.text for r in rows}
            assert max(sum(1 for r in left if r.doc_id == i) for i in words) <= 3
        before = after
    assert sum(r.length for r in left) > 0 and {r.doc_id for r in left} == {r.doc_id for r in rows}


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the and of with that", "en", "a", 20), (1, "the and of with that", "en", "a", 20), (None, "of the and with", "en", None, 15), (4, None, None, "a", None), (5, "", "en", None, 0), (6, "1 2 3", "en", "b", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, ""))
    assert docs.count() <= 9
    assert cp.ORACLE_SQL is None
