"""Conflict-constrained best-fit packing of documents into training sequences.

A text's words are cut into pieces of at most `capacity` words; full pieces are
bins of their own.  The rest are packed best-fit in decreasing length: bins stand
in the order of their residual space, each with a bitmap of the sources and of the
duplicate clusters in it.  A piece goes to the tightest bin that has room, holds
none of its source and none of its cluster.  A tree over the residuals keeps, for
each range, the sources that every bin in it holds, so that the successor search
passes over ranges without a compatible bin in one step; no bin is left out of the
search.

Documents are dealt to shards by a hash (about `shard_rows` documents each, so any
source, however large, is spread evenly) and shards are packed side by side.  Best
fit has no larger scope than a shard.

Defined results: null or empty texts have no words and get one empty piece in no
bin (bin null); a null source conflicts with nothing; a null cluster likewise;
repeated rows conflict through their cluster; an empty table gives an empty
result.  Columns beside those named are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.llm import textkit as K

CAPACITY = 2048
SHARD_ROWS = 8_192


class Shelf:
    """Bins of one shard in the order of their residual space, each with a bitmap of the sources and clusters in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)  # per range of residuals: what all its bins hold (-1: there is no bin)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]
        self.held: list[int] = []

    def _changed(self, residual: int) -> None:
        common = -1
        for b in self.bins[residual]:
            common &= self.held[b]
        at = residual + self.size
        self.common[at] = common
        while at > 1:
            at >>= 1
            both = self.common[2 * at] & self.common[2 * at + 1]
            if self.common[at] == both:
                break
            self.common[at] = both

    def _open(self, at: int, mask: int) -> bool:
        common = self.common[at]
        return common != -1 and common & mask == 0

    def successor(self, least: int, mask: int) -> int:
        """The smallest residual from `least` on where not every bin holds a bit of the mask in common; -1: none."""
        if least >= self.size:
            return -1
        at = least + self.size
        while not self._open(at, mask):
            while at & 1:  # the range to the right of this one begins under an ancestor
                at >>= 1
            if at == 0:
                return -1
            at += 1
        while at < self.size:
            at *= 2
            if not self._open(at, mask):
                at += 1
        return at - self.size

    def put(self, length: int, mask: int) -> int:
        """The tightest compatible bin gets the piece; a new one, where there is none."""
        residual = self.successor(length, mask)
        while residual >= 0:
            row = self.bins[residual]
            for i, b in enumerate(row):
                if self.held[b] & mask == 0:
                    row.pop(i)
                    self.held[b] |= mask
                    self._changed(residual)
                    self._add(b, residual - length)
                    return b
            residual = self.successor(residual + 1, mask)
        self.held.append(mask)
        self._add(len(self.held) - 1, self.capacity - length)
        return len(self.held) - 1

    def _add(self, b: int, residual: int) -> None:
        insort(self.bins[residual], b)
        self._changed(residual)


def pack_shard(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """A bin's number for each piece; longest pieces first, equal ones in the order given."""
    shelf, out, bits = Shelf(capacity), [0] * len(lengths), {}
    for kind, values in (("source", sources), ("cluster", clusters)):
        for value, n in Counter(values).items():
            if value is not None and n > 1:  # what stands once conflicts with nothing
                bits[kind, value] = 1 << len(bits)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = shelf.put(lengths[i], bits.get(("source", sources[i]), 0) | bits.get(("cluster", clusters[i]), 0))
    return out


def _pieces(docs: DataFrame, capacity: int, with_text: bool) -> DataFrame:
    """docs: doc_id, tkey, source, cluster, text.  One row for each piece; the cluster, where null, becomes a hash of the words."""
    names = ["doc_id", "tkey", "source", "cluster"]
    text = [T.StructField("text", T.StringType())] * with_text
    schema = T.StructType([*(docs.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in ("piece", "first_word", "n_words")), *text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(4)):
                part = batch.slice(a, b - a)
                words = K.split_words(part.column(4))
                n = words.counts
                h = words.hashes(lower=True)
                k = np.arange(len(h)) - np.repeat(words.ptr[:-1], n)
                own = np.zeros(len(n), np.uint64)
                if len(h):
                    some = n > 0
                    own[some] = K.mix(np.add.reduceat(K.mix(h + K.mix(k.astype(np.uint64))), words.ptr[:-1][some]) + n[some].astype(np.uint64))
                own_cluster = pa.array(own.view(np.int64), mask=n == 0)
                pieces = np.maximum(-(-n // capacity), 1)
                at = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = number * capacity
                size = np.minimum(n[at] - first, capacity)
                take = pa.array(at)
                cols = [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.compute.coalesce(part.column(3), own_cluster).take(take), pa.array(number), pa.array(first), pa.array(size)]
                if with_text:
                    bounds = np.append(words.starts, len(words.data))
                    start = np.where(number == 0, words.offsets[at], bounds[np.minimum(words.ptr[at] + first, len(bounds) - 1)])
                    end = np.where(number == pieces[at] - 1, words.offsets[at + 1], bounds[np.minimum(words.ptr[at] + first + size, len(bounds) - 1)])
                    raw = words.data.tobytes()
                    cols.append(pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(K.releasing(run), schema)


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, with_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, source, piece, first_word, n_words, shard, bin[, text]; bin is null for texts without words.

    (shard, bin) names a sequence.  cluster_col: a bigint column of duplicate
    clusters; without it, texts with the same words (case aside) are a cluster.
    The pieces of a document, one after another, are its text.
    """
    cluster = F.col(cluster_col).cast("bigint") if cluster_col else F.lit(None).cast("bigint")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), text.alias("text"))
    shards = max(1, -(-documents.count() // shard_rows))
    rows = _pieces(docs, capacity, with_text).withColumn("shard", F.pmod(F.xxhash64("doc_id", "tkey", F.lit(17)), F.lit(shards)))
    order = rows.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "tkey", "piece")
    out = ["doc_id", "source", "piece", "first_word", "n_words", "shard", "bin", *["text"] * with_text]
    schema = T.StructType([T.StructField("bin", T.LongType()) if n == "bin" else rows.schema[n] for n in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
                lengths = part.column("n_words").to_pylist()
                some = [i for i, n in enumerate(lengths) if n]
                sources, clusters = part.column("source").to_pylist(), part.column("cluster").to_pylist()
                bins: list[int | None] = [None] * len(lengths)
                for i, b in zip(some, pack_shard([lengths[i] for i in some], [sources[i] for i in some], [clusters[i] for i in some], capacity), strict=True):
                    bins[i] = b
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()) if n == "bin" else part.column(n) for n in out], out)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and held[-1].column("shard")[0] != batch.column("shard")[a]:
                        yield from packed(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        yield from packed(held)

    return order.mapInArrow(K.releasing(run), schema)
