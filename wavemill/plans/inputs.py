"""Pipeline inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as PCM chunks of 64 samples; the label is the source."""
    e = table(spark, sf_dir, "embeddings")
    seq = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("source_id"), seq.cast("long").alias("seq"), "vec_id", F.col("embedding").alias("samples"), F.size("embedding").cast("long").alias("n_samples"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored frames of their user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("source_id"), i.cast("long").alias("i"), F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as explicit session times in nanoseconds since 2024-01-01."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)
    return e.select(F.col("user_id").alias("source_id"), i.cast("long").alias("seq"), "event_id", "event_type", "value", (micros * 1000).alias("ts_ns"))
