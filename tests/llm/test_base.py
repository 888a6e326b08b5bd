"""What written tables leave behind."""

import os
import time

from wavemill.llm import mixing_lm
from wavemill.llm.base import CLEANUP, cut, drop, shared_dir


def tables(spark):
    root = shared_dir(spark).removeprefix("file://")
    return {d for d in os.listdir(root) if d.startswith("cut-")} if os.path.isdir(root) else set()


def test_drop(spark):
    """One table goes, the others stay."""
    kept, gone = cut(spark.range(10)), cut(spark.range(20))
    before = tables(spark)
    drop(gone)
    assert len(before - tables(spark)) == 1 and kept.count() == 10


def test_language_model_keeps_what_it_reads(spark):
    """Of its four tables only the two that the last stage reads are left while it runs."""
    before = tables(spark)
    out = mixing_lm.score_texts(spark.createDataFrame([(i, f"one two three {i % 5}") for i in range(40)], "doc_id long, text string"))
    assert len(tables(spark) - before) == 2
    assert out.count() == 40


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_their_query(spark):
    """What a written table was shuffled through is deleted, and the setting is as before."""
    setting, before = spark.conf.get(CLEANUP), shuffle_files(spark)
    made = cut(spark.range(100_000).selectExpr("id", "hash(id) h").repartition(5, "h"))
    deadline = time.time() + 10
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP) == setting and made.count() == 100_000
