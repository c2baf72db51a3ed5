"""Sinks: record files, text, printable records of a fixed width, fan-out by a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowjob.functions.scalars import pair_text
from flowjob.types import PlanError, need

MODES = ("errorifexists", "overwrite", "append")


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, compression: str | None = None) -> str:
    """One file for each partition, committed by renaming; returns the path."""
    if mode not in MODES:
        raise PlanError(f"no mode {mode}")
    need(df, by or [], "write")
    out = df.write.mode(mode)
    if compression:
        out = out.option("compression", compression)
    if by:
        out = out.partitionBy(*by)
    if format == "text" and len(df.columns) - len(by or []) != 1:
        raise PlanError("text takes one column; see write_pairs")
    out.format(format).save(path)
    return path


def write_pairs(df: DataFrame, path: str, key: str = "key", value: str = "value", mode: str = "errorifexists") -> str:
    """Lines like [word, 3]."""
    need(df, [key, value], "write_pairs")
    return write(df.select(pair_text(F.col(key), F.col(value)).alias("value")), path, "text", mode)


def write_records(df: DataFrame, path: str, record: str = "record", width: int = 100, mode: str = "errorifexists") -> str:
    """Printable binary records of `width` bytes that end in \\r\\n, one after another with nothing between; others fail the job."""
    need(df, [record], "write_records")
    body, end = F.expr(f"substring(`{record}`, 1, {width - 2})"), F.expr(f"substring(`{record}`, {width - 1}, 2)")
    fits = (F.octet_length(record) == width) & (end == F.lit(b"\r\n"))
    text = F.when(fits, body.cast("string")).otherwise(F.raise_error(F.lit(f"a record that isn't {width} bytes with its line end")).cast("string"))
    df.select(text.alias("value")).write.mode(mode).option("lineSep", "\r\n").text(path)
    return path
