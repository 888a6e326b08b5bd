"""An upsert sink whose batches count once, for ``foreachBatch``.

A batch's events and replies go to folders of their own, named by the batch and
overwritten if it is replayed; a commit mark makes them visible. Readers see the
latest row of each key over committed batches, so a batch that fails between
write and commit, or is replayed after its commit, changes nothing. Every
``compact`` batches the events are merged to a snapshot, and reading starts there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Replies to a caller; all other kinds are events.
REPLIES = ("reply",)


class UpsertSink:
    """Tables under ``path``, which all machines share: rows of ``kind`` reply apart, the
    others merged by ``keys``; of one key in a batch the row of the highest
    ``order`` wins. Rows without an id (errors, the end of a stream) have their kind
    and source for it."""

    def __init__(self, path: str, keys: tuple[str, ...] = ("session_id", "kind", "id", "source_id"), order: str = "cmd_seq", compact: int = 10):
        self.path, self.keys, self.order, self.compact = path.rstrip("/"), keys, order, compact

    def write(self, batch: DataFrame, number: int) -> None:
        """One batch; the function to give to ``foreachBatch``."""
        spark = batch.sparkSession
        done = self._committed(spark)
        if number in done:
            return
        for name, rows in (("replies", batch.where(F.col("kind").isin(*REPLIES))), ("events", self._latest(batch.where(~F.col("kind").isin(*REPLIES)), None))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        self._commit(spark, number)
        if (number + 1) % self.compact == 0:
            self._events(spark, done | {number}).write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={number}")
            self._commit(spark, number, "merged")

    def _commit(self, spark: SparkSession, number: int, kind: str = "commits") -> None:
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={number}")

    def _committed(self, spark: SparkSession, kind: str = "commits") -> set[int]:
        try:
            return {r.number for r in spark.read.schema("number long").parquet(f"{self.path}/{kind}/batch=*").collect()}
        except AnalysisException as e:  # nothing was committed yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return set()

    def _latest(self, rows: DataFrame, version: str | None) -> DataFrame:
        order = [F.col(version).desc()] if version else []
        w = W.partitionBy(*self.keys).orderBy(*order, F.col(self.order).desc_nulls_first())
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def _events(self, spark: SparkSession, done: set[int]) -> DataFrame | None:
        merged = max((n for n in self._committed(spark, "merged") if n in done), default=-1)
        parts = [spark.read.parquet(f"{self.path}/events/batch={n}").withColumn("__batch", F.lit(n)) for n in sorted(done) if n > merged]
        if merged >= 0:
            parts.append(spark.read.parquet(f"{self.path}/snapshot/upto={merged}").withColumn("__batch", F.lit(merged)))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return self._latest(whole, "__batch").drop("__batch")

    def events(self, spark: SparkSession) -> DataFrame | None:
        """The merged events of all committed batches; None before the first."""
        done = self._committed(spark)
        return self._events(spark, done) if done else None

    def replies(self, spark: SparkSession) -> DataFrame | None:
        """The replies of all committed batches, in no order; None before the first."""
        done = self._committed(spark)
        return spark.read.parquet(*[f"{self.path}/replies/batch={n}" for n in sorted(done)]) if done else None
