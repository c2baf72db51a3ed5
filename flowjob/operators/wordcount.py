"""Counting words and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowjob.functions import scalars as S


def word_counts(df: DataFrame, text_col: str = "text", ignore: Sequence[str] = (), fold_case: bool = False) -> DataFrame:
    """word, cnt.  Case-insensitive counts carry the word in lower case."""
    text: Column = S.without(F.col(text_col), ignore)
    word = F.explode(S.words(F.lower(text) if fold_case else text)).alias("word")
    return df.select(word).groupBy("word").agg(F.count("*").alias("cnt"))


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent words; of equally frequent ones the first by bytes."""
    return counts.orderBy(F.desc("cnt"), "word").limit(k)


def line_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.agg(F.sum(F.size(S.lines(F.col(text_col)))).cast("bigint").alias("n_lines"))
