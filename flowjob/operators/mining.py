"""Parallel FP-growth: closed frequent patterns, and the top k of them for each item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from heapq import heappush, heapreplace
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowjob.operators.ordering import top_k_per_group
from flowjob.types import need


def frequent_items(df: DataFrame, basket: str, item: str, min_support: int) -> DataFrame:
    """item, support: items in so many baskets or more; an item counts once a basket."""
    need(df, [basket, item], "frequent_items")
    return df.select(basket, F.col(item).alias("item")).distinct().groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def rank_items(items: DataFrame, groups: int) -> DataFrame:
    """item, support, rank (from 1; support descending, then item), group_id: contiguous blocks of ranks.

    The frequent items are ranked within ranges of their supports, not in one task.
    """
    sizes = items.groupBy("support").agg(F.count("*").alias("n"))
    above = sizes.select("support", (F.sum("n").over(Window.orderBy(F.desc("support"))) - F.col("n")).alias("above"))  # a row for each different support
    own = F.row_number().over(Window.partitionBy("support").orderBy("item"))
    total = items.count()
    size = max(1, -(-total // groups))
    ranked = items.join(above, "support").select("item", "support", (own + F.col("above")).cast("bigint").alias("rank"))
    return ranked.withColumn("group_id", F.floor((F.col("rank") - 1) / F.lit(size)).cast("bigint"))


def group_transactions(df: DataFrame, basket: str, item: str, ranked: DataFrame) -> DataFrame:
    """basket, group_id, items: for each group with an item in the basket, the ranks up to the group's last one, ascending."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct().join(ranked.select("item", "rank", "group_id"), "item")
    lists = rows.groupBy("basket").agg(F.array_sort(F.collect_list(F.struct("rank", "group_id"))).alias("all"))
    last = F.transform(F.col("all"), lambda x, i: F.struct(x["group_id"].alias("g"), (i + 1).alias("n")))
    ends = F.filter(last, lambda x: (x["n"] == F.size("all")) | (F.get(F.col("all"), x["n"])["group_id"] != x["g"]))
    return lists.select("basket", "all", F.explode(ends).alias("x")).select("basket", F.col("x.g").alias("group_id"), F.slice(F.transform("all", lambda y: y["rank"]), 1, F.col("x.n")).alias("items"))


def grow(transactions: Iterable[tuple[tuple[int, ...], int]], own: set[int], min_support: int, longest: int | None = None) -> Iterable[tuple[tuple[int, ...], int]]:
    """Patterns of up to `longest` items with support, whose last item is one of the group's own, from (ascending ranks, count) pairs."""

    def mine(base: list[tuple[tuple[int, ...], int]], suffix: tuple[int, ...], allowed: set[int] | None):
        counts: Counter = Counter()
        for items, n in base:
            for i in items:
                counts[i] += n
        for i, n in counts.items():
            if n >= min_support and (allowed is None or i in allowed):
                yield (i, *suffix), n
                if longest is not None and len(suffix) + 1 >= longest:
                    continue
                below: Counter = Counter()
                for items, m in base:
                    if i in items and (at := items.index(i)):
                        below[items[:at]] += m
                yield from mine(list(below.items()), (i, *suffix), None)

    yield from mine(list(transactions), (), own)


def grow_closed(transactions: Iterable[tuple[tuple[int, ...], int]], own: set[int], min_support: int, k: int | None = None) -> Iterable[tuple[tuple[int, ...], int]]:
    """Patterns closed among the transactions given, the last item one of the group's own; with k, those that can be in an item's top k.

    Transactions are bitmaps.  Items in every transaction of a pattern join it at
    once; a pattern that thereby gains an item after the one it was extended by is
    reached from there, and its branch is left.  Once every item of a branch has k
    patterns of larger support, the branch is left too.
    """
    rows = list(transactions)
    names = sorted({i for items, _ in rows for i in items})
    bit = {i: 1 << n for n, i in enumerate(names)}
    root = [(sum(bit[i] for i in items), n) for items, n in rows]
    best: dict[int, list[int]] = {}

    def members(mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    def useless(mask: int, support: int) -> bool:
        return k is not None and all(len(best.get(i, ())) >= k and best[i][0] > support for i in members(mask))

    stack = [(root, 0, n) for n, i in reversed(list(enumerate(names))) if i in own]
    while stack:
        base, pattern, i = stack.pop()
        under = [(mask, n) for mask, n in base if mask >> i & 1]
        support = sum(n for _, n in under)
        if support < min_support:
            continue
        whole, seen = -1, 0
        for mask, _ in under:
            whole &= mask
            seen |= mask
        if whole >> (i + 1) != pattern >> (i + 1):
            continue
        lower = (1 << i) - 1
        if useless(whole | seen & lower, support):
            continue
        inside = members(whole)
        yield tuple(names[x] for x in inside), support
        if k is not None:
            for x in inside:
                heap = best.setdefault(x, [])
                if len(heap) < k:
                    heappush(heap, support)
                elif support > heap[0]:
                    heapreplace(heap, support)
        stack += [(under, whole, x) for x in members(seen & lower & ~whole)]


def _mined(df: DataFrame, basket: str, item: str, min_support: int, groups: int, ranks_at: str | None, miner) -> tuple[DataFrame, DataFrame]:
    ranked = rank_items(frequent_items(df, basket, item, min_support), groups)
    if ranks_at:
        ranked.write.parquet(ranks_at)
        ranked = df.sparkSession.read.schema(ranked.schema).parquet(ranks_at)
    shards = group_transactions(df, basket, item, ranked).groupBy("group_id", "items").agg(F.count("*").alias("n"))
    own = ranked.groupBy("group_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))  # a row for each group

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        def mined(group: int, lo: int, hi: int, rows: list) -> Iterable[pd.DataFrame]:
            got = iter(miner(rows, set(range(lo, hi + 1))))
            while part := list(islice(got, 10_000)):
                yield pd.DataFrame({"group_id": group, "pattern": [list(p) for p, _ in part], "support": [s for _, s in part]})

        head, rows = None, []
        for b in batches:
            for g, lo, hi, items, n in zip(b["group_id"], b["lo"], b["hi"], b["items"], b["n"], strict=True):
                if head != (g, lo, hi):
                    if rows:
                        yield from mined(*head, rows)
                    head, rows = (g, lo, hi), []
                rows.append((tuple(int(i) for i in items), int(n)))
        if rows:
            yield from mined(*head, rows)

    placed = shards.join(F.broadcast(own), "group_id").select("group_id", "lo", "hi", "items", "n").repartition("group_id").sortWithinPartitions("group_id")
    return placed.mapInPandas(run, "group_id bigint, pattern array<bigint>, support bigint"), ranked


def frequent_patterns(df: DataFrame, basket: str, item: str, min_support: int, groups: int = 64, longest: int | None = None, ranks_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, ranked): pattern (ascending ranks) with support, all frequent ones of up to `longest` items.

    Equal prefixes of a group are counted before they meet, so a group's task sees
    different prefixes only; more groups make them smaller.  Patterns leave the task
    while it mines.  ranks_at: where to keep the ranks, which are otherwise computed
    for each use.
    """
    patterns, ranked = _mined(df, basket, item, min_support, groups, ranks_at, lambda rows, own: grow(rows, own, min_support, longest))
    return patterns.select("pattern", "support"), ranked


def closed_patterns(df: DataFrame, basket: str, item: str, min_support: int, groups: int = 64, k: int | None = None, ranks_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, ranked): the closed frequent patterns, or with k those that can be in the top k of one of their items.

    A group's patterns are closed among items up to its own.  One that a later
    group's pattern continues with the same support is not closed, and goes.
    """
    patterns, ranked = _mined(df, basket, item, min_support, groups, ranks_at, lambda rows, own: grow_closed(rows, own, min_support, k))
    size = ranked.agg(F.max(F.when(F.col("group_id") == 0, F.col("rank")))).first()[0] or 1
    group = lambda x: F.floor((x - 1) / F.lit(size))
    last = F.filter(F.sequence(F.lit(1), F.size("pattern") - 1), lambda i: group(F.element_at("pattern", i)) != group(F.element_at("pattern", i + 1)))
    shorter = patterns.where(F.size("pattern") > 1).select(F.explode(F.transform(last, lambda i: F.slice("pattern", 1, i))).alias("pattern"), "support").distinct()
    return patterns.select("pattern", "support").join(shorter, ["pattern", "support"], "left_anti"), ranked


def top_patterns(df: DataFrame, basket: str, item: str, min_support: int = 2, k: int = 50, groups: int = 64, ranks_at: str | None = None) -> DataFrame:
    """item, rank, support, pattern (array of items): each item's k closed patterns by support, then length, then items."""
    patterns, ranked = closed_patterns(df, basket, item, min_support, groups, k, ranks_at)
    each = patterns.select("pattern", "support", F.explode("pattern").alias("r"))
    best = top_k_per_group(each, ["r"], [F.desc("support"), F.desc(F.size("pattern")), F.col("pattern")], k)
    names = ranked.select(F.col("rank").alias("r2"), F.col("item").cast("string").alias("name"))
    named = best.select("r", F.col("rank"), "support", F.posexplode("pattern")).join(names, F.col("col") == F.col("r2")).groupBy("r", "rank", "support").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("pattern"))
    return named.join(names.withColumnRenamed("name", "item"), F.col("r") == F.col("r2")).select("item", "rank", "support", "pattern")
