"""Column types for the record types of a dataflow job, and checks made while a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "int128": T.DecimalType(38, 0), "uint128": T.BinaryType(), "decimal": T.DecimalType(38, 10),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(),
    "datetime": T.TimestampType(), "timespan": T.DayTimeIntervalType(), "guid": T.StringType(), "enum": T.IntegerType(), "bytes": T.BinaryType(),
}


class PlanError(ValueError):
    """A plan that can't run; raised while it is built, before any job starts."""


def pair(key: T.DataType, value: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", key, False), T.StructField("value", value, False)])


def record(*fields: T.DataType) -> T.StructType:
    """A tuple of 1 to 8 fields, as _1 to _n."""
    if not 1 <= len(fields) <= 8:
        raise PlanError("a tuple has 1 to 8 fields")
    return T.StructType([T.StructField(f"_{i}", f) for i, f in enumerate(fields, 1)])


def variants(**kinds: T.StructType) -> T.StructType:
    """A closed set of record kinds: a type tag and one nullable struct for each."""
    return T.StructType([T.StructField("type", T.StringType(), False), *(T.StructField(k, v) for k, v in kinds.items())])


def need(df: DataFrame, columns: Iterable[str], where: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise PlanError(f"{where}: no column {', '.join(missing)} among {', '.join(df.columns)}")


def same_schema(a: DataFrame, b: DataFrame, where: str) -> None:
    kinds = [[(f.name, f.dataType) for f in x.schema.fields] for x in (a, b)]
    if kinds[0] != kinds[1]:
        raise PlanError(f"{where}: the inputs' columns differ: {a.schema.simpleString()} and {b.schema.simpleString()}")


def same_key_type(a: DataFrame, b: DataFrame, left: str, right: str, where: str) -> None:
    if a.schema[left].dataType != b.schema[right].dataType:
        raise PlanError(f"{where}: {left} is {a.schema[left].dataType.simpleString()}, {right} is {b.schema[right].dataType.simpleString()}")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; a null in one of the columns fails the job."""
    need(df, columns, "not_null")
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c)) for c in columns})
