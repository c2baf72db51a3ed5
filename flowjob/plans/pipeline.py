"""A small fluent job builder: every step is an ordinary DataFrame plan, checked when it is added."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowjob.operators import aggregate, joins, ordering
from flowjob.sources import readers, sinks
from flowjob.types import PlanError, need, same_schema


class Pipeline:
    """Steps return frames; writes and barriers are kept and run in order by ``run``."""

    def __init__(self, spark: SparkSession, name: str = "job", settings: dict[str, str] | None = None):
        self.spark, self.name, self.settings = spark, name, dict(settings or {})
        self._steps: list[Callable[[], object]] = []
        self._outputs: set[str] = set()

    # ---- sources and sinks
    def read(self, path: str, format: str = "parquet", schema=None, **options: str) -> DataFrame:
        return readers.read(self.spark, path, format, schema, **options)

    def generate(self, n: int, tasks: int, *columns: Column, fn=None, schema: str | None = None) -> DataFrame:
        return readers.generate(self.spark, n, tasks, *columns, fn=fn, schema=schema)

    def write(self, df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, compression: str | None = None) -> None:
        if path in self._outputs:
            raise PlanError(f"two outputs at {path}")
        self._outputs.add(path)
        self._steps.append(lambda: sinks.write(df, path, format, mode, by, compression))

    # ---- rows
    def map(self, df: DataFrame, *columns: str | Column, where: Column | None = None) -> DataFrame:
        """Declared columns (also explode: none or several rows for each), of the rows that pass."""
        return (df if where is None else df.where(where)).select(*columns)

    def process(self, df: DataFrame, fn: Callable[[Iterable], Iterable], schema: str, arrow: bool = False) -> DataFrame:
        """A function of a whole partition's batches; code after its loop runs at the partition's end."""
        return df.mapInArrow(fn, schema) if arrow else df.mapInPandas(fn, schema)

    def process_partitions(self, df: DataFrame, fn: Callable[[int, Iterable], Iterable], schema: str) -> DataFrame:
        """Like process, but the function also gets the partition's number."""

        def run(batches):
            return fn(TaskContext.get().partitionId(), batches)

        return df.mapInPandas(run, schema)

    # ---- grouping
    def group_aggregate(self, df: DataFrame, keys: Sequence[str | Column], *aggs: Column) -> DataFrame:
        return aggregate.group_aggregate(df, keys, *aggs)

    def group_fold(self, df: DataFrame, key: str, value: str, fold: Callable) -> DataFrame:
        return aggregate.group_fold(df, key, value, fold)

    def reduce(self, df: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
        return aggregate.reduce_groups(df, keys, fn, schema)

    # ---- order
    def memory_sort(self, df: DataFrame, *order: str | Column, partitions: int | None = None, by: Sequence[str] = ()) -> DataFrame:
        return ordering.sort_partitions(df, *order, partitions=partitions, by=by)

    spill_sort = memory_sort

    def spill_sort_combine(self, df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
        """Combined in each task before the shuffle, and sorted by the keys within partitions after it."""
        return aggregate.group_aggregate(df, keys, *aggs).sortWithinPartitions(*keys)

    def sort_total(self, df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
        return ordering.sort_total(df, *order, partitions=partitions)

    def partition(self, df: DataFrame, n: int, by: str | Column, method: str = "hash") -> DataFrame:
        return ordering.partition(df, n, by, method)

    def concat(self, *inputs: DataFrame) -> DataFrame:
        for x in inputs[1:]:
            same_schema(inputs[0], x, "concat")
        return ordering.concat(*inputs)

    # ---- joins
    def inner_join(self, outer: DataFrame, inner: DataFrame, on, select=None, strategy: str | None = "merge") -> DataFrame:
        return joins.inner_join(outer, inner, on, select, strategy)

    def lookup_join(self, facts: DataFrame, table: DataFrame, on: str) -> DataFrame:
        return joins.lookup_join(facts, table, on)

    # ---- control
    def after(self, action: Callable[[], object]) -> None:
        """A barrier: the action runs once all outputs added so far are committed, and before those added later."""
        self._steps.append(action)

    def setting(self, name: str, default: str | None = None) -> str | None:
        return self.settings.get(name, default)

    def explain(self, df: DataFrame) -> str:
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def run(self) -> list[object]:
        self.spark.sparkContext.setJobGroup(self.name, self.name)
        return [step() for step in self._steps]

    def observed(self, df: DataFrame, name: str = "rows") -> DataFrame:
        """Counts rows while they pass, as a metric of the query."""
        return df.observe(name, F.count(F.lit(1)).alias("rows"))


def arguments(argv: Sequence[str]) -> dict[str, str]:
    """--setting name=value, any number of times."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--setting", action="append", default=[])
    return dict(x.split("=", 1) for x in parser.parse_args(argv).setting)


__all__ = ["Pipeline", "arguments", "need"]
