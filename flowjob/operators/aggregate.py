"""Grouping: declared aggregates, associative folds, and functions of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowjob.types import PlanError, need


def group_aggregate(df: DataFrame, keys: Sequence[str | Column], *aggs: Column) -> DataFrame:
    """Partial aggregation in each task, then one shuffle of one row for each key and task."""
    if not aggs:
        raise PlanError("group_aggregate needs an aggregate")
    need(df, [k for k in keys if isinstance(k, str)], "group_aggregate")
    return df.groupBy(*keys).agg(*aggs)


def group_fold(df: DataFrame, key: str, value: str, fold: Callable[[object, object], object]) -> DataFrame:
    """key, value: an opaque associative and commutative fold of each key's values, the first value its start.

    Tasks fold what they have; only one partial result for each key and task is
    shuffled, so a key with a third of all rows is no burden.  Null keys or values fail.
    """
    need(df, [key, value], "group_fold")
    kind = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("value", df.schema[value].dataType)])

    def partial(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            if b.isna().any(axis=None):
                raise ValueError("a null key or value")
            for k, v in zip(b["key"].tolist(), b["value"].tolist(), strict=True):
                held[k] = fold(held[k], v) if k in held else v
            if len(held) > 100_000:
                yield pd.DataFrame({"key": list(held), "value": list(held.values())})
                held = {}
        if held:
            yield pd.DataFrame({"key": list(held), "value": list(held.values())})

    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInPandas(partial, kind)
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_settle(fold), kind)


def _settle(fold: Callable) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        last: list[tuple] = []  # the key that the next batch may go on with
        for b in batches:
            done = last
            for k, v in zip(b["key"].tolist(), b["value"].tolist(), strict=True):
                if done and done[-1][0] == k:
                    done[-1] = (k, fold(done[-1][1], v))
                else:
                    done.append((k, v))
            last = done[-1:]
            yield pd.DataFrame(done[:-1], columns=["key", "value"])
        yield pd.DataFrame(last, columns=["key", "value"])

    return run


def reduce_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[tuple, Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str | T.StructType, order: Sequence[str] = ()) -> DataFrame:
    """fn(key, batches) -> batches for each group, 0 or more rows; the group streams by in batches (in `order`) and is never held whole.

    Frames cost some 0.4 ms for each group: of many small groups, reduce_rows makes none.
    """
    need(df, keys, "reduce_groups")
    where = [df.columns.index(k) for k in keys]

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        def parts():
            for b in batches:
                if len(b):
                    keys = b.iloc[:, where]
                    cuts = [0, *np.flatnonzero(keys.ne(keys.shift()).any(axis=1).to_numpy())[1:].tolist(), len(b)]
                    names = list(zip(*(keys[c].tolist() for c in keys), strict=True))
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        yield names[x], b.iloc[x:y]

        source, ahead = parts(), []

        def group(key):
            while ahead and ahead[0][0] == key:
                yield ahead.pop()[1]
                ahead.extend(x for x in [next(source, None)] if x)

        ahead.extend(x for x in [next(source, None)] if x)
        out, size = [], 0
        while ahead:
            key = ahead[0][0]
            values = group(key)
            for made in fn(key, values):
                out.append(made)
                size += len(made)
            for _ in values:  # what the function left unread
                pass
            if size >= 10_000:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def reduce_rows(df: DataFrame, keys: Sequence[str], fn: Callable[[tuple, Iterable[tuple]], Iterable[tuple]], schema: str | T.StructType, order: Sequence[str] = ()) -> DataFrame:
    """fn(key, rows) -> rows for each group, 0 or more; rows are tuples of plain values, nulls None.

    The group streams by (in `order`) and is never held whole, nor is what the
    function makes.  Null keys are one group, as are NaN ones.
    """
    need(df, keys, "reduce_rows")
    where = [df.columns.index(k) for k in keys]
    key_of = itemgetter(*where)
    kind = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def values(column: pa.Array, is_key: bool) -> list:
        real = pa.types.is_floating(column.type)
        plain = column.null_count == 0 and (real or pa.types.is_integer(column.type))
        out = column.to_numpy().tolist() if plain else column.to_pylist()
        return [x if x == x else np.nan for x in out] if is_key and real else out  # one object, equal to itself

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(values(c, i in where) for i, c in enumerate(b.columns)), strict=True) for b in batches)
        made = chain.from_iterable(fn(key if len(where) > 1 else (key,), group) for key, group in groupby(rows, key_of))
        while out := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
