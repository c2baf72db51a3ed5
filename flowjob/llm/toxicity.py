"""Toxicity: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text, each present or absent: its words, their first five bytes
(languages that inflect or compound share stems), pairs of neighbouring words, and
pairs with one word between them, hashed to `2**BITS` buckets.  FTRL-proximal
(McMahan and others, 2013) gives each bucket its own learning rate; its L1 term
keeps nearly all weights at 0.  The other weights, at most one for each bucket,
are the broadcast.

The classifier is fitted on at most `max_rows` labelled documents, those with the
least hash of their id; every document is scored, on its whole text.

Defined results: a null or empty text has no features and gets the score of the
bias alone; labels that are null, or whose document is missing, are ignored; a
document with several labels is a row of the sample for each; without any label
the score is 0.5; repeated rows are scored alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.llm import textkit as K

BITS = 20
MAX_ROWS = 8_000
STEM_BYTES = 5
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 20.0, 0.02, 8
#: Weight of an example of label 1, which is the rarer one.
POSITIVE = 6.0
_TAGS = [np.uint64(t) for t in (0x51ED270B27B4F3CF, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F)]


def families(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the texts' numbers and the buckets, one entry for each occurrence."""
    words = K.split_words(texts, K.NON_ALNUM)
    h = words.hashes(lower=True)
    stem = K.span_hashes(words.data, words.starts, np.minimum(words.ends, words.starts + STEM_BYTES), lower=True)
    text, mask = words.text_of(), np.uint64((1 << bits) - 1)

    def bucket(x: np.ndarray, tag: np.uint64) -> np.ndarray:
        return (K.mix(x ^ tag) & mask).astype(np.int64)

    yield text, bucket(h, _TAGS[0])
    yield text, bucket(stem, _TAGS[1])
    for gap, tag in ((1, _TAGS[2]), (2, _TAGS[3])):
        inner = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        yield text[gap:][inner], bucket(K.pair(h[:-gap][inner], h[gap:][inner]), tag)


def features(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    key = np.unique(np.concatenate([t << bits | b for t, b in families(texts, bits)]))
    ptr = np.searchsorted(key, np.arange(len(texts) + 1) << bits)
    return [(key[a:b] & ((1 << bits) - 1)).astype(np.int32) for a, b in zip(ptr, ptr[1:], strict=False)]


def fit(rows: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, positive: float = POSITIVE) -> np.ndarray:
    """Weights, the last one the bias, by `epochs` passes in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rows = [np.append(r, 1 << bits) for r in rows]

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (positive if y else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with a weight, and their weights; the last bucket is the bias.

    Only the sample's texts are hashed to features, by all tasks; one task then
    learns from them, and only weights come to the driver.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    sample = known.withColumn("h", F.xxhash64("i", "y")).orderBy("h", "i").limit(max_rows)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    held = docs.join(F.broadcast(sample), "i").select("h", "i", "y", "text")
    schema = T.StructType([held.schema["h"], held.schema["i"], held.schema["y"], T.StructField("f", T.BinaryType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b in K.slices(x.column(3)):
                f = [r.tobytes() for r in features(x.column(3)[a:b])]
                yield pa.RecordBatch.from_arrays([*(x.column(k)[a:b] for k in range(3)), pa.array(f, pa.binary())], schema.names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for x in batches:
            rows += [np.frombuffer(r, np.int32) for r in x.column(3).to_pylist()]
            y += x.column(2).to_pylist()
        w = fit(rows, np.array(y, float)) if rows else np.zeros((1 << BITS) + 1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["bucket", "weight"])

    one = held.mapInArrow(hashed, schema).repartition(1).sortWithinPartitions("h", "i", "f")  # texts are read and hashed where they lie; only features move
    got = one.mapInArrow(learn, "bucket bigint, weight double").toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str, *, text_col: str = "text") -> DataFrame:
    """The documents with one more column, the probability of the label 1."""
    if column in documents.columns:
        raise ValueError(f"there is a column {column} already")
    held = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)
    schema = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[held.value[0]] = held.value[1]
        there = w != 0
        for x in batches:
            for a, b in K.slices(x.column(at)):
                part = x.slice(a, b - a)
                keys = []
                for text, bucket in families(part.column(at)):
                    some = there[bucket]
                    keys.append(text[some] << BITS | bucket[some])
                key = np.unique(np.concatenate(keys))
                total = w[-1] + np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)], b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], schema.names)

    return documents.mapInArrow(run, schema)
