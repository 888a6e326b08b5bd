"""Tables written once in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this session where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not found:
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: later stages
    neither recompute it nor depend on one executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
