"""The corpus pipeline: five stages over ``documents``, each kept whole.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back as the next
stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import langid, mixing, packing, pii
from wavemill.llm.base import cut, table
from wavemill.llm.parity_join import jaccard_components
from wavemill.llm.queries import tokenizer


def _by_row(docs: DataFrame, facts: DataFrame, keep: str) -> DataFrame:
    """``docs`` whose doc_id has a row of ``facts`` that passes ``keep``."""
    ids = facts.where(keep).select("doc_id").distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, code-switched ones too; null or letterless
    texts go. Repeated rows stay, and an empty table stays empty."""
    found = langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang")))
    return _by_row(docs, found, "lang_pred <> 'und'")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group; documents
    without an id stay, once each. Repeated rows, told by a hash of the text, are one."""
    groups = jaccard_components(docs, n=5, num=4, den=5)
    ids = groups.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.withColumn("__text", F.xxhash64("text"))
    # dealt by doc_id for the join, which serves the repeated rows too
    known = rows.where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "__text"])
    return known.unionByName(rows.where("doc_id is null").dropDuplicates(["__text"])).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken / size copies, a fraction
    rounded by a seeded draw on the doc_id, so that sources keep their shares."""
    mixed = mixing.mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source"))
    draw = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    # a document of no words has no share to take and stays out
    dealt = mixed.where("size > 0").select("row", F.explode(F.array_repeat(F.lit(0), copies)))
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: A learned field and a tokenizer are no SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
