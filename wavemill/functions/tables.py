"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Rechunk:
    """``rechunk(TABLE(t), size)``: rows (source, order, samples), in this order of columns
    and of any types, dealt anew to chunks of ``size`` samples as they stream by; the
    last of a source may be shorter. The function itself asks for the table by
    source and in order. Null samples count as none; further columns are ignored."""

    def __init__(self, plan: AnalyzeResult | None = None):
        self.held, self.source, self.number, self.size = [], None, 0, None

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        fields = table.dataType.fields if table.isTable else []
        if len(fields) < 3 or not isinstance(fields[2].dataType, ArrayType):
            raise ValueError("rechunk needs a table of source, order and an array of samples")
        if size.value is None or size.value < 1:
            raise ValueError("rechunk needs a constant size of 1 or more")
        kind: DataType = fields[0].dataType
        schema = StructType([StructField(fields[0].name, kind), StructField("chunk", LongType()), StructField("n", LongType()), StructField("samples", fields[2].dataType)])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(fields[0].name)], orderBy=[OrderingColumn(fields[1].name)])

    def eval(self, row, size: int) -> Iterator[tuple]:
        self.source, self.size = row[0], size
        self.held += row[2] or []
        whole = len(self.held) // size * size
        for lo in range(0, whole, size):
            yield self.source, self.number, size, self.held[lo : lo + size]
            self.number += 1
        self.held = self.held[whole:]

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self.source, self.number, len(self.held), self.held


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("rechunk", udtf(Rechunk))
