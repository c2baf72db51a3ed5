"""Language-model scoring with an Elias-Fano n-gram trie in shards.

Words (lower case) and a closing mark are tokens.  The model has every word, pair and
triple of the training documents, however rare, so it grows with the corpus; no part
of it stands in one place.  A triple (a, b, c), the token c after a b, belongs to the
shard of its middle word b, and so do the pairs (b, c): what one token's probability
needs lies in one shard.  Frequent middle words are dealt to several shards by the
word before them, in proportion to their count; their pairs go to each of these.

A shard is a trie rooted at middle words.  A root points to its successors c, and to
the words a before it; each of those points to the triples, whose last word is stored
as its number among the root's successors.  All of these lists are Elias-Fano
sequences with monotone pointers (``eliasfano.Ranges``), in one buffer of mapped
memory; a look-up is a successor search within the range of its context.
Probabilities and back-off weights are 8-bit codes of a codebook of quantiles.

Each order is interpolated with the one below by absolute discounting: after a context
with count n and t different successors, p = (c - D) / n + D * t / n * p_below.  Single
tokens have p = (c + 0.5) / (N + 0.5 (V + 1)); words beyond the `base_words` most
frequent ones share the mean of theirs (and of one unknown word).  That bounds what is
broadcast; pairs and triples with such words are kept like all others.

Training counts and the tokens to be scored are dealt to the shards as arrays of packed
numbers; a shard's task builds its trie, asks it, and each document's parts are added up.  The base score needs exact
counts of every word: those of a text's words that are not among the broadcast ones are
joined with the table of counts.  Words are told apart by 64-bit hashes (62 bits in
shards).

Defined results: a null or empty text is its closing mark alone; texts of null ids
are scored and, their fold being unknown, learnt from; repeated rows are rows of
their own; without training documents the score is that of unknown words; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.llm import textkit as K
from flowjob.llm.eliasfano import EliasFano, Ranges, from_buffer, mapped, to_bytes
from flowjob.llm.tables import written

#: Words that are broadcast with their counts.
BASE_WORDS = 1_000_000
#: Training tokens of one shard, about.
SHARD_TOKENS = 1 << 19
DISCOUNT = 0.75
PAD, BEGIN, END, ANY, FIRST = range(5)  # codes of marks; from FIRST on the frequent words
_NARROW = 21  # bits of a frequent word's code
_RARE = 1 << 62  # other words' codes: this, and 62 bits of their hash
_ENTRIES = 1024  # of one row on its way to a shard
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
CHUNK_BYTES, CHUNK_TEXTS = 4 << 20, 1 << 16


class Index:
    """Sorted hashes with a directory of their upper bits, for vectorised look-ups."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(4, int(len(hashes)).bit_length()))
        self.starts = np.searchsorted(hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where they are missing."""
        out = np.full(len(q), -1, np.int64)
        bucket = (q >> self.shift).astype(np.int64)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = self.hashes[at[open_]] == q[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _classes(count: Column) -> Column:
    """Counts in classes whose order is that of the counts: exact below 1024, sixteenths of a doubling above."""
    return F.when(count < 1024, count).otherwise(F.lit(1024) + F.floor(F.log2(count) * 16)).cast("bigint")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows (column n) of the highest classes of counts that hold no more than `most` rows; at most a few thousand classes reach the driver."""
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(_classes(F.col("n"))).count().collect()), reverse=True)
    total, least = 0, None
    for k, size in sizes:
        if total + size > most:
            break
        total, least = total + size, k
    return counts.where(_classes(F.col("n")) >= least) if least is not None else counts.where("false")


def count_words(docs: DataFrame) -> DataFrame:
    """key, n: each word's hash with its count, and under END the number of texts; tasks count before Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 200_000].view(np.int64)), pa.array(n[a : a + 200_000].astype(np.int64))], ["key", "n"])

        for x in batches:
            for a, b in K.slices(x.column(0)):
                held.append(np.append(K.split_words(x.column(0)[a:b]).hashes(lower=True), np.full(b - a, END, np.uint64)))
                size += len(held[-1])
                if size > 6_000_000:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words' hashes and counts, totals of the corpus, and how words are dealt to shards."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, texts: int, shard_tokens: int):
        order = np.argsort(hashes)
        self.index, self.counts = Index(hashes[order]), counts[order]
        by_count = np.argsort(-self.counts, kind="stable")  # the more frequent, the smaller the code
        self.code_at = np.empty(len(counts), np.int64)
        self.code_at[by_count] = np.arange(FIRST, FIRST + len(counts))
        self.tokens, self.types, self.texts = tokens, types, texts
        self.shards = max(1, -(-tokens // shard_tokens))
        self.code_counts = np.concatenate([[0, texts, texts, 0], self.counts[by_count]])  # by code; BEGIN stands in each text once
        rare = max(types - (texts > 0) - len(counts), 0)
        rare_tokens = tokens - texts - int(counts.sum())
        size = tokens + 0.5 * (types + 1)
        self.p1 = (self.code_counts + 0.5) / size
        self.p1_rare = (rare_tokens + 0.5 * (rare + 1)) / (size * (rare + 1))

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its place among the frequent ones (-1: it is none) and its code."""
        at = self.index.find(hashes)
        codes = (hashes >> np.uint64(2)).astype(np.int64) | _RARE
        some = np.flatnonzero(at >= 0)
        codes[some] = self.code_at[at[some]]
        return at, codes

    def probability(self, codes: np.ndarray) -> np.ndarray:
        narrow = codes < len(self.p1)
        return np.where(narrow, self.p1[np.where(narrow, codes, 0)], self.p1_rare)

    def salts(self, middle: np.ndarray) -> np.ndarray:
        """To how many shards a middle word is dealt."""
        narrow = middle < len(self.code_counts)
        n = np.where(narrow, self.code_counts[np.where(narrow, middle, 0)], 0)
        return np.minimum(1 + n * self.shards // max(2 * self.tokens, 1), self.shards)

    def shard(self, middle: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (K.mix(middle.astype(np.uint64) + K.mix(salt.astype(np.uint64))) % np.uint64(self.shards)).astype(np.int64)

    def shard_of(self, before: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return self.shard(middle, (K.mix(before.astype(np.uint64)) % self.salts(middle).astype(np.uint64)).astype(np.int64))


def events(words: K.Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token with the two before it, and its text: words and an end, after two marks."""
    n = words.counts + 3
    first = np.cumsum(n) - n
    tokens = np.full(int(n.sum()), END, np.int64)
    tokens[first], tokens[first + 1] = PAD, BEGIN
    text = words.text_of()
    tokens[np.arange(len(codes)) + 3 * text + 2] = codes
    at = np.ones(len(tokens), bool)
    at[first] = at[first + 1] = False
    at = np.flatnonzero(at)
    return tokens[at - 2], tokens[at - 1], tokens[at], np.repeat(np.arange(len(n)), words.counts + 1)


def _bytes_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as sums of bytes: how many each takes, and all of them."""
    times = -(-n // 255)
    out = np.full(int(times.sum()), 255, np.uint8)
    out[np.cumsum(times) - 1] = n - 255 * (times - 1)
    return times, out


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return b << 2 * _NARROW | a << _NARROW | c


def _counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray | None = None):
    """The different triples and how often they stand there."""
    n = np.ones(len(a), np.int64) if n is None else n
    outs = []
    wide = (a | b | c) >> _NARROW > 0
    for narrow in (True, False):
        some = np.flatnonzero(wide != narrow)
        x, y, z = a[some], b[some], c[some]
        order = np.argsort(_packed(x, y, z)) if narrow else np.lexsort((z, x, y))
        x, y, z, m = x[order], y[order], z[order], n[some][order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        new = np.flatnonzero(new)
        outs.append((x[new], y[new], z[new], np.add.reduceat(m, new) if len(new) else m))
    return tuple(np.concatenate(p) for p in zip(*outs, strict=True))


def _squeezed(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Rows of entries as compressed bytes: all first bytes, then all second ones (entropy coding gains most so)."""
    end = np.append(begin[1:], len(values))
    return pa.array([_ZIP.compress(values[a:b].T.tobytes()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())


def _unsqueezed(rows: list[bytes], width: int) -> np.ndarray:
    parts = [np.frombuffer(_UNZIP.decompress(x), np.uint8).reshape(width, -1).T for x in rows]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.uint8)


def _shipped(shard: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, aux: np.ndarray, base: int, first_kind: int) -> Iterator[dict[str, pa.Array]]:
    """Rows of up to _ENTRIES entries for a shard: shard, kind (the first one: three bytes for each word; the next: eight), base, keys, aux."""
    wide = (a | b | c) >> _NARROW > 0
    for kind, some in ((0, np.flatnonzero(~wide)), (1, np.flatnonzero(wide))):
        if not len(some):
            continue
        order = some[np.argsort(shard[some].astype(np.uint16 if shard.max() < 1 << 16 else np.int64), kind="stable")]
        s = shard[order]
        begin = np.flatnonzero(np.diff(s, prepend=-1))
        place = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
        begin = np.flatnonzero(place % _ENTRIES == 0)
        words = [x[order].astype("<i8").view(np.uint8).reshape(-1, 8)[:, : 8 if kind else 3] for x in (c, a, b)]
        x = aux[order]
        yield {"shard": pa.array(s[begin].astype(np.int32)), "kind": pa.array(np.full(len(begin), first_kind + kind, np.int8)), "base": pa.array(np.full(len(begin), base, np.int64)), "keys": _squeezed(np.concatenate(words, 1), begin), "aux": _squeezed(x.view(np.uint8).reshape(len(x), -1), begin)}


def _entries(keys: tuple[list[bytes], list[bytes]], aux: tuple[list[bytes], list[bytes]], aux_type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, c and aux of shipped rows, narrow ones first."""
    parts = []
    for rows, width in zip(keys, (3, 8), strict=True):
        packed = _unsqueezed(rows, 3 * width)
        flat = np.zeros((len(packed), 3, 8), np.uint8)
        flat[:, :, :width] = packed.reshape(-1, 3, width)
        parts.append(flat.reshape(-1).view("<i8").reshape(-1, 3))
    c, a, b = np.ascontiguousarray(np.concatenate(parts).T)
    width = np.dtype(aux_type).itemsize
    return a, b, c, np.concatenate([_unsqueezed(rows, width).reshape(-1).view(aux_type) for rows in aux])


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in K.slices(column, CHUNK_BYTES):
        for c in range(a, b, CHUNK_TEXTS):
            yield c, min(c + CHUNK_TEXTS, b)


# ---------------------------------------------------------------- a shard's trie


def codebook(values: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the values and the codebook: the values themselves if they are few, else means of ranges with equally many different values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(size)
    uniq = K.distinct(values)
    if len(uniq) <= size:
        return np.searchsorted(uniq, values).astype(np.uint8), np.append(uniq, np.zeros(size - len(uniq)))
    cuts = uniq[np.arange(1, size) * len(uniq) // size]
    codes = np.searchsorted(cuts, values, "right")
    n = np.bincount(codes, minlength=size)
    return codes.astype(np.uint8), np.bincount(codes, values, size) / np.maximum(n, 1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(n[order], new) if len(new) else n


def _places(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where these values, all of which are there, stand in the sorted codes."""
    narrow = int(np.searchsorted(codes, 1 << _NARROW))
    table = np.zeros(1 << _NARROW, np.int64)
    table[codes[:narrow]] = np.arange(narrow)
    out = table[np.minimum(x, (1 << _NARROW) - 1)]
    wide = np.flatnonzero(x >> _NARROW)
    out[wide] = np.searchsorted(codes, x[wide])
    return out


def _discounted(counts: np.ndarray, parent: np.ndarray, parents: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Each count's own part of its probability, and each parent's weight of the order below."""
    total = np.bincount(parent, counts, parents)
    return (counts - discount) / total[parent], discount * np.bincount(parent, minlength=parents) / np.maximum(total, 1)


def build(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, words: Vocabulary, discount: float = DISCOUNT) -> bytes:
    """The trie of a shard's counts; a is ANY for the pairs of words that have several shards."""
    n = n.astype(np.int64)
    pair = a == ANY
    codes = K.distinct(np.concatenate([K.distinct(x) for x in (a, b, c)]))
    size = len(codes)
    a, b, c = (_places(codes, x) for x in (a, b, c))
    dealt = np.zeros(size, bool)
    dealt[b[pair]] = True
    one = ~pair & ~dealt[b]
    k2, n2 = _summed(np.append(b[pair], b[one]) * size + np.append(c[pair], c[one]), np.append(n[pair], n[one]))
    roots = K.distinct(k2 // size)
    parent2 = np.searchsorted(roots, k2 // size)
    own2, weight2 = _discounted(n2, parent2, len(roots), discount)
    p2 = own2 + weight2[parent2] * words.probability(codes[k2 % size])
    starts = np.searchsorted(parent2, np.arange(len(roots) + 1))
    a, b, c, n = (x[~pair] for x in (a, b, c, n))
    place = np.empty(len(a), np.int64)
    order = np.argsort(b * size + c)  # sorted questions stay close to one another
    place[order] = np.searchsorted(k2, (b * size + c)[order])
    order = np.argsort(b * size + a)
    number, n = (place - starts[parent2[place]])[order], n[order]
    key = (b * size + a)[order]
    new = np.diff(key, prepend=-1) != 0
    node, context = key[new], np.cumsum(new) - 1
    widest = int(np.diff(starts).max()) if len(roots) else 1
    k3, n3 = _summed(context * widest + number, n)
    parent3, number = k3 // widest, k3 % widest
    own3, weight3 = _discounted(n3, parent3, len(node), discount)
    root3 = np.searchsorted(roots, node // size)
    p3 = own3 + weight3[parent3] * p2[starts[root3[parent3]] + number]
    levels = {
        "words": EliasFano.build(codes, 1 << 63),
        "roots": EliasFano.build(roots, size + 1),
        "successors": Ranges.build(np.diff(starts), k2 % size),
        "before": Ranges.build(np.bincount(root3, minlength=len(roots)), node % size),
        "triples": Ranges.build(np.bincount(parent3, minlength=len(node)), number),
    }
    arrays = {}
    for name, values in (("p2", p2), ("b2", weight2), ("p3", p3), ("b3", weight3)):
        arrays[name], arrays[f"{name}_book"] = codebook(np.log10(values))
    return to_bytes(levels, arrays, {})


def _once(x: np.ndarray, look) -> np.ndarray:
    """look(x), once for each run of equal values; negative ones are not looked up and give -1."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    uniq = x[new]
    got = np.full(len(uniq), -1, np.int64)
    got[uniq >= 0] = look(uniq[uniq >= 0])
    return np.maximum(got, -1)[np.cumsum(new) - 1]


class Trie:
    """A shard's mapped levels, and probabilities of tokens."""

    def __init__(self, raw: bytes):
        self.levels, self.arrays, _ = from_buffer(mapped(raw))

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.arrays[f"{name}_book"][self.arrays[name][at]]

    def score(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, words: Vocabulary) -> np.ndarray:
        """log10 of each token c's probability after a b."""
        uniq = K.distinct(np.concatenate([K.distinct(x) for x in (a, b, c)]))
        local = self.levels["words"].find(uniq)
        la, lb, lc = (local[_places(uniq, x)] for x in (a, b, c))
        pair, node, triple = (np.full(len(a), -1, np.int64) for _ in range(3))
        root = _once(lb, lambda x: self.levels["roots"].find(x))
        some = np.flatnonzero((root >= 0) & (lc >= 0))
        key = root[some] << 31 | lc[some]
        order = np.argsort(key)
        pair[some[order]] = _once(key[order], lambda x: self.levels["successors"].find(x >> 31, x & (1 << 31) - 1))
        some = np.flatnonzero((root >= 0) & (la >= 0))
        node[some] = _once(root[some] << 31 | la[some], lambda x: self.levels["before"].find(x >> 31, x & (1 << 31) - 1))
        some = np.flatnonzero((pair >= 0) & (node >= 0))
        first = _once(root[some], self.levels["successors"].pointers.get)
        triple[some] = self.levels["triples"].find(node[some], pair[some] - first)
        out = np.zeros(len(a))
        one = np.flatnonzero(pair < 0)
        out[one] = np.log10(words.probability(c[one]))
        some = one[root[one] >= 0]
        out[some] += self._value("b2", root[some])
        two = np.flatnonzero((pair >= 0) & (triple < 0))
        out[two] = self._value("p2", pair[two])
        some = np.flatnonzero((triple < 0) & (node >= 0))
        out[some] += self._value("b3", node[some])
        some = np.flatnonzero(triple >= 0)
        out[some] = self._value("p3", triple[some])
        return out


# ---------------------------------------------------------------- over the documents


#: Kinds of rows on their way to a shard; those of training and of tokens have a narrow and a wide form.
TRIE, COUNTS, TOKENS, SUMS, DOCUMENT = 0, 1, 3, 5, 6
_WAYS = "shard int, kind tinyint, base bigint, keys binary, aux binary"


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices: rows on their way are long, and copies are made of one slice at a time."""
    for x in batches:
        for i in range(0, x.num_rows, rows):
            yield x.slice(i, rows)


class _Shard:
    """What came of a shard's training counts so far, and the trie of them."""

    def __init__(self, words: Vocabulary):
        self.words, self.keys, self.counts = words, ([], []), ([], [])

    def add(self, kind: int, keys: bytes, counts: bytes) -> None:
        self.keys[kind - COUNTS].append(keys)
        self.counts[kind - COUNTS].append(counts)

    def built(self) -> bytes | None:
        return build(*_entries(self.keys, self.counts, np.uint8), self.words) if any(self.keys) else None


class Model:
    """What ``train`` gives to ``score``: the broadcast vocabulary, the table of counts, and `rows` for the shards.

    The rows are training counts, which ``score`` brings to the shards along with
    the tokens, or, once ``keep_tries`` has written these, the tries.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, base_words: int, shard_tokens: int):
        if base_words > (1 << _NARROW) - FIRST:
            raise ValueError(f"at most {(1 << _NARROW) - FIRST} words can be broadcast")
        self.counts = written(count_words(docs), "words")
        total = self.counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("key") == END, F.col("n")))).first()
        got = most_frequent(self.counts.where(F.col("key") != END), base_words).toArrow()
        words = Vocabulary(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy(), int(total[0] or 0), int(total[1]), int(total[2] or 0), shard_tokens)
        self.words = held = spark.sparkContext.broadcast(words)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = held.value
            for x in batches:
                for i, j in _chunks(x.column(0)):
                    words = K.split_words(x.column(0)[i:j])
                    a, b, c, n = _counted(*events(words, v.codes(words.hashes(lower=True))[1])[:3])
                    _, b2, c2, n2 = _counted(np.full(len(b), ANY), b, c, n)
                    times = v.salts(b2)
                    times[times == 1] = 0  # a word of one shard has its pairs there in its triples
                    salt = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    which = np.repeat(np.arange(len(b2)), times)
                    which, shard = np.divmod(K.distinct(which * v.shards + v.shard(b2[which], salt)), v.shards)  # once to each shard
                    b2, c2, n2 = b2[which], c2[which], n2[which]
                    shard = np.append(v.shard_of(a, b), shard)
                    more, parts = _bytes_of(np.append(n, n2))
                    entries = (shard, np.append(a, np.full(len(b2), ANY)), np.append(b, b2), np.append(c, c2))
                    for row in _shipped(*(np.repeat(y, more) for y in entries), parts, 0, COUNTS):
                        yield pa.RecordBatch.from_pydict(row)

        self.rows = docs.select("text").mapInArrow(emit, _WAYS)

    def keep_tries(self) -> Model:
        """Writes the tries in the shared folder, so that they are built once for any number of calls of ``score``."""
        held = self.words

        def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, shard = None, None

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "kind": pa.array([TRIE], pa.int8()), "base": pa.nulls(1, pa.int64()), "keys": pa.array([shard.built()], pa.binary()), "aux": pa.nulls(1, pa.binary())})

            for x in _sliced(batches):
                for number, kind, keys, aux in zip(*(x.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                    if number != now:
                        if now is not None:
                            yield made()
                        now, shard = number, _Shard(held.value)
                    shard.add(kind, keys, aux)
            if now is not None:
                yield made()

        self.rows = written(self.rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(tries, _WAYS), "tries")
        return self


def train(documents: DataFrame, *, text_col: str = "text", base_words: int = BASE_WORDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    docs = documents.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return Model(documents.sparkSession, docs, base_words, shard_tokens)


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = model.words
    ways = T._parse_datatype_string(_WAYS)
    facts = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_tokens bigint, known bigint, logs double, rare array<bigint>, score double").fields])
    names = [*ways.names, *facts.names]
    schema = T.StructType([*ways.fields, *facts.fields])
    kinds = dict(zip(names, _arrow(schema), strict=True))

    def filled(rows: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[n] if n in given else pa.nulls(rows, kinds[n]) for n in names], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens on their way to the shards, and each document's own facts."""
        v, row = held.value, TaskContext.get().partitionId() << 33
        for x in batches:
            for i, j in _chunks(x.column(1)):
                words = K.split_words(x.column(1)[i:j])
                h = words.hashes(lower=True)
                at, codes = v.codes(h)
                n = np.where(at >= 0, v.counts[at] if len(v.counts) else 0, 0)
                a, b, c, text = events(words, codes)
                known = K.sums((at >= 0).astype(np.int64), words.ptr) + (v.texts > 0)
                logs = K.sums(np.log10(2.0 * n + 1), words.ptr) + math.log10(2 * v.texts + 1)
                ptr = np.zeros(len(words.ptr), np.int32)
                np.cumsum(K.sums((at < 0).astype(np.int64), words.ptr), out=ptr[1:])
                own = np.arange(row, row + j - i)
                rare = pa.ListArray.from_arrays(pa.array(ptr), pa.array(h[at < 0].view(np.int64)))
                yield filled(j - i, shard=pa.array((own % v.shards).astype(np.int32)), kind=pa.array(np.full(j - i, DOCUMENT, np.int8)), base=pa.array(own), doc_id=x.column(0)[i:j], n_tokens=pa.array(words.counts.astype(np.int64) + 1), known=pa.array(known), logs=pa.array(logs), rare=rare)
                order = np.argsort(_packed(a, b, c))
                a, b, c, text = a[order], b[order], c[order], text[order]
                for part in _shipped(v.shard_of(a, b), a, b, c, text.astype(np.uint16), row, TOKENS):
                    yield filled(len(part["shard"]), **part)
                row += j - i

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's trie or counts come first, then the tokens; the sums of each document's tokens go out."""
        v = held.value
        now, shard, trie = None, None, None
        waiting: list[tuple[int, bytes, bytes, int, int]] = []
        size = 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            by = [[w for w in waiting if w[0] == k] for k in (TOKENS, TOKENS + 1)]
            a, b, c, text = _entries(tuple([w[1] for w in rows] for rows in by), tuple([w[2] for w in rows] for rows in by), np.uint16)
            doc = text + np.repeat([w[3] for rows in by for w in rows], [w[4] for rows in by for w in rows])
            narrow = sum(w[4] for w in by[0])
            key = _packed(a[:narrow], b[:narrow], c[:narrow])
            order = np.argsort(key)
            new = np.diff(key[order], prepend=-1) != 0
            back = np.empty(narrow, np.int64)
            back[order] = np.cumsum(new) - 1
            pick = np.append(order[new], np.arange(narrow, len(a)))
            got = trie.score(a[pick], b[pick], c[pick], v) if trie else np.log10(v.probability(c[pick]))
            values = np.append(got[: int(new.sum())][back], got[int(new.sum()) :])
            return doc, values

        def merged() -> pa.RecordBatch:
            """One row for each part of the documents: their numbers, and the sums of their tokens."""
            doc, values = (np.concatenate(x) for x in zip(*held_sums, strict=True))
            order = np.argsort(doc, kind="stable")
            begin = np.flatnonzero(np.diff(doc[order], prepend=-1))
            doc, values = doc[order][begin], np.add.reduceat(values[order], begin).astype(np.float32)
            cut = np.append(np.flatnonzero(np.diff(doc >> 33, prepend=-1)), len(doc)).astype(np.int32)
            number = (doc & (1 << 33) - 1).astype(np.uint32)
            binary = lambda y: pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut * np.int32(4)), pa.py_buffer(y)])
            return filled(len(cut) - 1, kind=pa.array(np.full(len(cut) - 1, SUMS, np.int8)), base=pa.array(doc[cut[:-1]]), keys=binary(number), aux=binary(values))

        held_sums, n_held = [], 0
        for x in _sliced(batches):
            kinds = np.asarray(x.column(1))
            if len(done := np.flatnonzero(kinds == DOCUMENT)):
                yield x.take(pa.array(done))
            part = x.take(pa.array(np.flatnonzero(kinds != DOCUMENT)))
            for number, kind, keys, aux, base in zip(*(part.column(k).to_pylist() for k in (0, 1, 3, 4, 2)), strict=True):
                if number != now or size > 1 << 19:
                    if size:
                        held_sums.append(sums())
                        n_held += size
                    waiting, size = [], 0
                    if n_held > 1 << 22:
                        yield merged()
                        held_sums, n_held = [], 0
                if number != now:
                    now, shard, trie = number, _Shard(v), None
                if kind == TRIE:
                    trie = Trie(keys)
                elif kind < TOKENS:
                    shard.add(kind, keys, aux)
                else:
                    if shard is not None:
                        raw, shard = shard.built(), None
                        trie = Trie(raw) if raw else trie
                    waiting.append((kind, keys, aux, base, zstandard.frame_content_size(aux) // 2))
                    size += waiting[-1][4]
        if size:
            held_sums.append(sums())
        if held_sums:
            yield merged()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a part's documents come first, then their facts."""
        now, total = None, np.zeros(0)
        for x in _sliced(batches):
            done = []
            for i, (part, kind) in enumerate(zip((np.asarray(x.column(2)) >> 33).tolist(), x.column(1).to_pylist(), strict=True)):
                if part != now:
                    now, total = part, np.zeros(0)
                if kind == SUMS:
                    at, values = np.frombuffer(x.column(3)[i].as_py(), np.uint32), np.frombuffer(x.column(4)[i].as_py(), np.float32)
                    if len(total) <= at[-1]:
                        total = np.append(total, np.zeros(max(int(at[-1]) + 1 - len(total), len(total))))
                    total[at] += values
                else:
                    done.append((i, total[int(x.column(2)[i].as_py()) & (1 << 33) - 1]))
            if done:
                docs = x.take(pa.array([i for i, _ in done]))
                score = pa.array([v for _, v in done])
                yield pa.RecordBatch.from_arrays([docs.column(2), *(score if n == "score" else docs.column(names.index(n)) for n in facts.names)], ["row", *facts.names])

    more = model.rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in facts.fields))
    rows = docs.mapInArrow(emit, schema).unionByName(more).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(look, schema)
    parts = rows.withColumn("part", F.shiftright("base", 33)).repartition("part").sortWithinPartitions("part", "kind").drop("part")
    whole = written(parts.mapInArrow(finish, T.StructType([T.StructField("row", T.LongType()), *facts.fields])), "scored")
    each = whole.select("row", F.explode("rare").alias("key"))
    found = each.join(model.counts, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(2.0 * F.col("n") + 1)).alias("add"))
    v = held.value
    zero = F.log10(F.lit(0.5 / (v.tokens + 0.5 * (v.types + 1))))
    out = whole.drop("rare").join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("add", F.lit(0.0)) + F.col("n_tokens") * zero).alias("base_score"),
        "score",
    )


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]
