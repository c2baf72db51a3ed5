"""Joins of two inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.operators.aggregate import reduce_groups, reduce_rows
from flowjob.types import PlanError, need, same_key_type

HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")
#: Bytes up to which the optimizer's estimate lets a lookup table be broadcast.
LOOKUP_BYTES = 64 << 20


def join(outer: DataFrame, inner: DataFrame, on: Sequence[tuple[str, str]] | Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """on: pairs of key columns, or a condition.  strategy: merge, shuffle_hash or none for Catalyst's choice; nulls match nothing."""
    if how not in HOW:
        raise PlanError(f"no join {how}")
    if not isinstance(on, Column):
        need(outer, [a for a, _ in on], "join")
        need(inner, [b for _, b in on], "join")
        for a, b in on:
            same_key_type(outer, inner, a, b, "join")
        condition = F.lit(True)
        for a, b in on:
            condition = condition & (outer[a] == inner[b])
        on = condition
    return outer.join(inner.hint(strategy) if strategy else inner, on, how)


def inner_join(outer: DataFrame, inner: DataFrame, on: Sequence[tuple[str, str]] | Column, select: Sequence[str | Column] | None = None, strategy: str | None = "merge") -> DataFrame:
    """Sort-merge inner join; runs of equal keys on both sides spill."""
    out = join(outer, inner, on, "inner", strategy)
    return out.select(*select) if select else out


def lookup_join(facts: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Broadcast of the table where the optimizer's size estimate is within LOOKUP_BYTES, a merge join beyond."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return facts.join(F.broadcast(table) if size <= LOOKUP_BYTES else table.hint("merge"), on, how)


def cogroup(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], fn: Callable, schema: str | T.StructType) -> DataFrame:
    """fn(left pandas, right pandas) -> pandas for each key of either side; a key's rows must fit in a task.

    Frames cost milliseconds for each key: of many small groups, cogroup_rows makes none.
    """
    need(left, left_on, "cogroup")
    need(right, right_on, "cogroup")
    return left.groupBy(*left_on).cogroup(right.groupBy(*right_on)).applyInPandas(fn, schema)


def cogroup_rows(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], fn: Callable[[tuple, list[tuple], Iterable[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """fn(key, left rows, right rows) -> rows for each key of either side; rows are tuples of plain values, nulls None.

    A key's left rows are held, its right ones stream by.  Null keys of both sides
    are one group.
    """
    need(left, left_on, "cogroup_rows")
    need(right, right_on, "cogroup_rows")
    for a, b in zip(left_on, right_on, strict=True):
        same_key_type(left, right, a, b, "cogroup_rows")
    keys = [f"__k{i}" for i in range(len(left_on))]
    n, m = len(keys) + 1, len(keys) + 1 + len(left.columns)
    names = [*keys, "__side", *(f"__l{i}" for i in range(len(left.columns))), *(f"__r{i}" for i in range(len(right.columns)))]
    none = lambda x: [F.lit(None).cast(f.dataType) for f in x.schema.fields]
    mine = left.select(*(F.col(c) for c in left_on), F.lit(0), *(F.col(c) for c in left.columns), *none(right)).toDF(*names)
    theirs = right.select(*(F.col(c) for c in right_on), F.lit(1), *none(left), *(F.col(c) for c in right.columns)).toDF(*names)

    def run(key: tuple, rows: Iterable[tuple]) -> Iterable[tuple]:
        held, rest = [], ()
        for x in rows:
            if x[n - 1]:
                rest = (y[m:] for y in chain([x], rows))
                break
            held.append(x[n:m])
        return fn(key, held, iter(rest))

    return reduce_rows(mine.unionByName(theirs), keys, run, schema, order=["__side"])


def combine(inputs: Sequence[DataFrame], keys: Sequence[str], fn: Callable, schema: str | T.StructType) -> DataFrame:
    """fn(key, batches) -> batches for each key of any of n inputs; rows stream by, input after input.

    Each row has the keys, `input` (its number) and one struct column `rowN` for each
    input, null but for its own.  Neither a key's rows nor an input are held whole.
    """
    tagged = []
    for i, x in enumerate(inputs):
        need(x, keys, "combine")
        own = F.struct(*(F.col(c) for c in x.columns))
        rows = [own.alias(f"row{j}") if j == i else F.lit(None).cast(y.schema).alias(f"row{j}") for j, y in enumerate(inputs)]
        tagged.append(x.select(*keys, F.lit(i).alias("input"), *rows))
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    return reduce_groups(out, keys, fn, schema, order=["input"])


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: Sequence[str]) -> DataFrame:
    """Each left row with `value` of the last right row of the same `by` at or before its `time`; null where there is none.

    One shuffle and one sort of both sides together, so right rows are never paired
    with left rows.  Null keys are one group.  Of right rows at the same time, the
    one that is last by `value` counts.
    """
    need(left, [*by, time], "asof_join")
    need(right, [*by, time, *value], "asof_join")
    mine = [c for c in left.columns if c not in (*by, time)]
    a = left.select(*by, time, F.struct(*mine).alias("__mine"), F.lit(None).cast(right.select(*value).schema).alias("__theirs"), F.lit(1).alias("__side"))
    b = right.select(*by, time, F.lit(None).cast(left.select(*mine).schema).alias("__mine"), F.struct(*value).alias("__theirs"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(time, "__side", "__theirs").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("__theirs", F.last("__theirs", ignorenulls=True).over(w)).where("__side = 1")
    return rows.select(*by, time, *(F.col("__mine")[c].alias(c) for c in mine), *(F.col("__theirs")[c].alias(c) for c in value))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high.  Ranges go to every bucket of `width` that they touch, points to their own: an equi-join with a check."""
    need(points, [point], "range_join")
    need(ranges, [low, high], "range_join")
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return points.withColumn("__bucket", bucket(F.col(point))).join(spread, "__bucket").where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("__bucket")
