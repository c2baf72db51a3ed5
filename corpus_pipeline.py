"""A cleaning pipeline over documents: five operators, each on all that the one before it kept.

The quality rules drop rejected documents, line dedup removes repeated chunks of
lines (and documents of which nothing is left), near-dedup keeps one document of
each group, decontamination drops documents with benchmark passages, and packing
deals the rest to training sequences.  Executors exchange rows with their Python workers
in small batches, a setting that stays with the session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowjob.llm import decontaminate, linechunks, nearmin, packing, quality
from flowjob.llm.tables import small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage; each sets the bound itself, as it may run alone."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that base rules or perplexity bands reject; a null text is rejected."""
    return quality.keep(docs)


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated chunks of lines; a document goes if all its lines were repeated.  n_chars follows the text."""
    out = linechunks.dedup(docs).where(F.length("text") > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with similarity 0.8 or more: that with the least doc_id."""
    return nearmin.keep(docs, shingle=5)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold eight words in a row of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequences they go to; the last stage."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing_stage),
]

#: Perplexity bands, shift-resistant chunks and best-fit order have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
