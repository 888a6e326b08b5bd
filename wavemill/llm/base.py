"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: one must fit a Python worker whatever its texts.
ARROW_ROWS, ARROW_BYTES = 4096, 4 << 20
#: Spark's setting by which a finished query deletes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches that the operators' Python stages receive."""
    for name, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, or one of this
    session's own where it is unset (single-machine runs and tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not found:
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back, so
    later stages neither recompute it nor depend on one executor's disk. Its shuffle
    files go at once: nothing reads them any more, and else they would stay until
    the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the folder of a table from ``cut`` that nothing will read any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals a table that arrives in fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of a key's text form, modulo ``divisor`` (null key: null)."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor))
