"""Sort benchmark: records of 100 bytes, and the validation of a sorted data set."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowjob.types import need

_A, _C, _MASK = 0x2360ED051FC65DA44385DF649FCCF645, 0x4A696D47726179524950202020202001, (1 << 128) - 1


def skip(n: int, start: int = 0) -> int:
    """The n-th number of the 128-bit linear congruential generator after `start`, in log n steps."""
    a, c, x = _A, _C, start
    while n:
        if n & 1:
            x = (a * x + c) & _MASK
        c = (a + 1) * c & _MASK
        a = a * a & _MASK
        n >>= 1
    return x


def ascii_record(number: int, x: int) -> bytes:
    """Ten printable key bytes, the record's number in hex, and thirteen hex digits four times each."""
    high, low = x >> 64, x & ((1 << 64) - 1)
    key = bytearray()
    for _ in range(8):
        high, d = divmod(high, 95)
        key.append(32 + d)
    v = low
    for _ in range(2):
        v, d = divmod(v, 95)
        key.append(32 + d)
    filler = "".join(f"{(low >> shift) & 15:X}" * 4 for shift in range(48, -1, -4))
    return bytes(key) + b"  " + f"{number:032X}".encode() + b"  " + filler.encode() + b"\r\n"


def generate_records(spark: SparkSession, n: int, tasks: int = 8) -> DataFrame:
    """number, key (10 bytes), record (100 bytes); each batch skips ahead in the generator to its own first number."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            last, x, out = None, 0, []
            for i in b["id"].tolist():
                x = (_A * x + _C) & _MASK if last is not None and i == last + 1 else skip(i + 1)
                last = i
                out.append(ascii_record(i, x))
            yield pd.DataFrame({"number": b["id"], "key": [r[:10] for r in out], "record": out})

    return spark.range(0, n, 1, tasks).mapInPandas(run, "number bigint, key binary, record binary")


def validate(df: DataFrame, key: str, position: str, checksum_of: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row: records, unsorted, duplicates, first_unsorted (0-based, null if none), first_key, last_key, checksum.

    position gives the order in which the data set is read; keys are not null.  Each range of
    positions is summed up in one pass that holds one batch; the summaries, one a
    partition, are then checked at their boundaries.
    """
    need(df, [key, position], "validate")
    crc = F.crc32(F.col(checksum_of or key).cast("string").cast("binary"))
    rows = df.select(F.col(position).alias("p"), F.col(key).alias("k"), crc.alias("c"))
    rows = (rows.repartitionByRange(partitions, "p") if partitions else rows.repartitionByRange("p")).sortWithinPartitions("p")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        n = unsorted = same = total = 0
        first = last = start = None
        bad = None
        for b in batches:
            if not len(b):
                continue
            k = b["k"].to_numpy()
            if n == 0:
                first, start = k[0], b["p"].iloc[0]
            else:
                k = np.concatenate([np.array([last], k.dtype), k])
            less = np.flatnonzero(k[1:] < k[:-1])
            if bad is None and len(less):
                bad = int(less[0]) + n + (n == 0)
            unsorted += len(less)
            same += int((k[1:] == k[:-1]).sum())
            last, n, total = k[-1], n + len(b), total + int(b["c"].sum())
        if n:
            yield pd.DataFrame({"start": [start], "n": [n], "unsorted": [unsorted], "same": [same], "bad": pd.array([bad], "Int64"), "first": [first], "last": [last], "total": [total]})

    parts = rows.mapInPandas(run, f"start {rows.schema['p'].dataType.simpleString()}, n bigint, unsorted bigint, same bigint, bad bigint, first {kind}, last {kind}, total bigint")
    w = Window.orderBy("start")  # one row for each partition
    parts = parts.withColumns({"before": F.lag("last").over(w), "offset": F.sum("n").over(w) - F.col("n")})
    crossed, met = F.coalesce(F.col("first") < F.col("before"), F.lit(False)), F.coalesce(F.col("first") == F.col("before"), F.lit(False))
    at = F.when(crossed, F.col("offset")).otherwise(F.col("offset") + F.col("bad"))
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"),
        F.coalesce(F.sum(F.col("unsorted") + crossed.cast("int")), F.lit(0)).cast("bigint").alias("unsorted"),
        F.coalesce(F.sum(F.col("same") + met.cast("int")), F.lit(0)).cast("bigint").alias("duplicates"),
        F.min(at).cast("bigint").alias("first_unsorted"),
        F.min_by("first", "start").alias("first_key"),
        F.max_by("last", "start").alias("last_key"),
        F.sum(F.col("total").cast("decimal(38,0)")).alias("checksum"),
    )


def generate_text(spark: SparkSession, n: int, tasks: int, words: int, vocabulary: Sequence[str]) -> DataFrame:
    """number, line: n lines of so many words of the vocabulary, drawn by a multiplicative rule from line and place; JVM only."""
    if not vocabulary or tasks < 1:
        raise ValueError("a vocabulary and a task are needed")
    # fixed values: multipliers and modulus of the rule
    draw = lambda j: F.pmod((F.col("id") * 1103515 + j * 12345) % 2147483647 * 48271 % 2147483647, F.lit(len(vocabulary)))
    names = F.array(*map(F.lit, vocabulary))
    line = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(words).cast("bigint")), lambda j: F.get(names, draw(j).cast("int"))), " ")
    return spark.range(0, n, 1, tasks).select(F.col("id").alias("number"), line.alias("line"))


def record_checksum(record: bytes) -> int:
    return zlib.crc32(record)
