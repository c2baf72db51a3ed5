"""Connected components of an undirected graph, by alternating stars.

Large-star and small-star steps (Kiveris and others, 2014) turn each component
into a star around its least node.  Every step is a group-by and a join; nothing
is gathered on the driver but a count and a checksum, and each round is written to
the shared folder, so a lost executor costs no more than the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowjob.llm.tables import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges a, b (no nulls) of any sortable type; gives node, root for every node with a link, root the least node of its component."""
    now, before = written(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    for _ in range(rounds):
        last, now = now, written(_small(_large(now)), "stars")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = mark
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
