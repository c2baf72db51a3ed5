"""Event-time windows, over bounded tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total.  late: for streams, how long after the newest event a window stays open."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_tumbling(spark: SparkSession, folder: str, schema, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return tumbling(spark.readStream.schema(schema).parquet(folder), width, late)
