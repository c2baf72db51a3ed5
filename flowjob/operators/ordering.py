"""Partitioning, sorting and ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowjob.types import PlanError, need


def partition(df: DataFrame, n: int, by: str | Column | None = None, method: str = "hash") -> DataFrame:
    """hash: equal keys together; range: ranges of keys; custom: the expression is the partition's number; round_robin: equal sizes."""
    if method == "round_robin":
        return df.repartition(n)
    by = F.col(by) if isinstance(by, str) else by
    if method == "hash":
        return df.repartition(n, by)
    if method == "range":
        return df.repartitionByRange(n, by)
    if method == "custom":
        return df.repartitionById(n, by.cast("int"))
    raise PlanError(f"no method {method}")


def sort_partitions(df: DataFrame, *order: str | Column, partitions: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sorted within partitions, with no order between them; equal keys of `by` share a partition."""
    need(df, by, "sort_partitions")
    if by:
        df = df.repartition(partitions, *by) if partitions else df.repartition(*by)
    elif partitions:
        df = df.repartition(partitions)
    return df.sortWithinPartitions(*order)


def sort_total(df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """One order over all rows: partitions are ranges of sampled keys, each sorted."""
    return (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)


def number_rows(df: DataFrame, *order: str | Column, path: str, name: str = "row", partitions: int | None = None) -> DataFrame:
    """Each row's number, from 1, in one order over all rows; any types, directions and places of nulls.

    The sorted ranges are written once below `path`, each row with its place in its
    range, so numbers and counts come from the same ranges.  Equal rows get
    different numbers in no set order.
    """
    at = F.monotonically_increasing_id()
    rows = sort_total(df, *order, partitions=partitions).withColumns({"__p": F.shiftright(at, 33), "__i": at.bitwiseAND(F.lit((1 << 33) - 1))})
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy("__p").count()
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))  # a row for each range
    return rows.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i") + 1).drop("__p", "__i", "__before")


def interleave(inputs: Sequence[DataFrame], order: Sequence[str], paths: Sequence[str], name: str = "row") -> DataFrame:
    """Rows of the inputs taken in turn, one from each, in each input's own order: turn, input and row number."""
    numbered = [number_rows(x, *order, path=p, name="turn").withColumn("input", F.lit(i)) for i, (x, p) in enumerate(zip(inputs, paths[:-1], strict=True))]
    return number_rows(concat(*numbered), "turn", "input", path=paths[-1], name=name)


def merge_partitions(df: DataFrame, n: int) -> DataFrame:
    """At most n partitions, each several of the old ones read one after another; no shuffle."""
    return df.coalesce(n)


def total_rank(df: DataFrame, key: str, *ties: str, name: str = "rank", buckets: int = 200) -> DataFrame:
    """Each row's number in the order of a numeric key, then of ties.

    No task sees all rows: rows go to ranges between quantiles of the key, are
    numbered there, and a range's number starts after the rows of those before it.
    Equal keys share a range.  The ranges' sizes, a row for each, come to the driver:
    joined with the rows that they count, they let the optimizer infer a filter that
    names a column of the other side.
    """
    need(df, [key, *ties], "total_rank")
    cuts = sorted({c + 0.0 for c in df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.001) if math.isfinite(c)})
    value = F.col(key).cast("double")
    rows = df.withColumn("__value", F.when(value == 0, 0.0).otherwise(value))  # -0.0 equals 0.0
    if cuts:
        rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__value", outputCol="__range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("__range", F.lit(0))
    rows = rows.withColumn("__bucket", F.when(F.col(key).isNull(), 0).otherwise(F.col("__range").cast("int") + 1)).drop("__value", "__range")
    sizes = dict(rows.groupBy("__bucket").count().collect())  # at most `buckets` rows, one for nulls, one for NaN
    before = F.array(*(F.lit(n).cast("bigint") for n in accumulate((sizes.get(i, 0) for i in range(len(cuts) + 2)), initial=0)))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(key, *ties))
    return rows.withColumn("__own", own).withColumn(name, F.col("__own") + F.get(before, F.col("__bucket"))).drop("__bucket", "__own")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark's window group limit keeps k rows a key in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


def concat(*inputs: DataFrame) -> DataFrame:
    out = inputs[0]
    for x in inputs[1:]:
        if [f.dataType for f in x.schema.fields] != [f.dataType for f in out.schema.fields]:
            raise PlanError("concatenated inputs need the same columns")
        out = out.unionByName(x)
    return out
