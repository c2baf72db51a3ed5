"""Sources: text lines, record files, fixed-width records, rows in memory, generated rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.types import PlanError

FORMATS = ("text", "parquet", "orc", "json", "csv", "avro")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file, or the direct child files of a folder.  Text is read line by line; \\n, \\r and \\r\\n end a line."""
    if format not in FORMATS:
        raise PlanError(f"no format {format}")
    if format in ("json", "csv") and schema is None:
        raise PlanError(f"{format} needs a schema; none is inferred")
    reader = spark.read.options(**options)
    if schema is not None and format != "text":
        reader = reader.schema(schema)
    df = reader.format(format).load(path)
    if not df.inputFiles():
        raise PlanError(f"no non-empty file under {path}")
    return df


def fixed_records(spark: SparkSession, path: str, width: int = 100, key_bytes: int = 10) -> DataFrame:
    """Records of a fixed number of bytes: key and record, both binary.  The Hadoop reader splits files at multiples of the width."""
    rows = spark.sparkContext.binaryRecords(path, width).map(lambda b: (bytes(b),))
    df = spark.createDataFrame(rows, "record binary")
    return df.select(F.substring("record", 1, key_bytes).alias("key"), "record")


def printable_records(spark: SparkSession, path: str, key_bytes: int = 10) -> DataFrame:
    """Records that end in \\r\\n: key and record as binary columns, read and split by the JVM's text reader."""
    value = F.concat(F.col("value").cast("binary"), F.lit(b"\r\n"))
    return spark.read.option("lineSep", "\r\n").text(path).select(F.substring(value, 1, key_bytes).alias("key"), value.alias("record"))


def register_source(spark: SparkSession, name: str, schema: str, plan: Callable[[dict], Sequence], read: Callable[[object], Iterable]) -> None:
    """A source of one's own for spark.read.format(name): plan(options) lists splits, read(split) gives tuples or Arrow batches.

    Each split is one task, read again if its executor is lost.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self):
            return [InputPartition(x) for x in plan(self.options)]

        def read(self, partition):
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def generate(spark: SparkSession, n: int, tasks: int, *columns: Column, fn: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]] | None = None, schema: str | None = None) -> DataFrame:
    """n numbered rows (column id) in so many tasks, with further columns, or through a function of their batches."""
    if tasks < 1 or n < 0:
        raise PlanError("generate needs a task and no negative count")
    rows = spark.range(0, n, 1, tasks)
    if fn is not None:
        if schema is None:
            raise PlanError("a generating function needs a schema")
        return rows.mapInPandas(fn, schema)
    return rows.select("id", *columns)
