"""Benchmark decontamination with suffix arrays of the training text.

Each slice of training documents is a shard.  A shard's suffix array holds, in
word order, every suffix that begins with a pair of words which stands in the
benchmark (no other suffix can match).  Every different window of the benchmark
is looked up in it by binary search; the range found gives the places of all
verbatim occurrences.  The suffixes at these places are then ordered to their full
length, and every suffix of the items is searched among them for the longest
matches.  Memory grows with the places and the windows, not with their pairs.

The benchmark is the query set: it goes to the executors in blocks of bounded
size, and each shard is searched with one block after another.  The documents
are neither shuffled nor gathered.

Defined results: a null or empty text has no words and no hits; an item with a
null id, a null text or no words matches nothing; repeated rows each get their
own row; an empty benchmark leaves all counts 0.  Further columns of the input
are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.llm import textkit as K

WINDOW = 8
#: Characters of benchmark text in one block; a block has fewer than 2**21 different words.
BLOCK_CHARS = 1 << 20
SHARD_BYTES = 4 << 20
_BITS, _PER_KEY = 21, 3

MATCH = "array<struct<item_id:string,item_pos:bigint,doc_pos:bigint,n_words:bigint>>"


class Block:
    """One block of the benchmark: words as dense ids, and its windows as search keys."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = K.split_words(pa.array(texts, pa.string()), K.NON_ALNUM)
        hashes = words.hashes(lower=True)
        self.ids, self.window = ids, window
        self.vocab, dense = np.unique(hashes, return_inverse=True)
        if len(self.vocab) >= 2**_BITS - 2:
            raise ValueError("a block of the benchmark has too many different words")
        self.words = np.append(dense.astype(np.int64) + 1, np.zeros(window + _PER_KEY, np.int64))
        n, first = words.counts, words.ptr[:-1]
        self.item_end = np.repeat(words.ptr[1:], n)
        self.item_first = np.repeat(first, n)
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(dense))
        size = np.minimum(n, window)[item] if len(at) else at
        fits = at + size <= self.item_end if len(at) else at.astype(bool)
        self.at, self.item, self.size = at[fits], item[fits], size[fits]
        inner = at[at + 1 < self.item_end]
        self.pairs = np.unique(self.words[inner] << _BITS | self.words[inner + 1])
        alone = self.at[self.size == 1]
        self.single = np.unique(self.words[alone])
        low, high = self._keys(0), self._keys(2**_BITS - 1)
        order = np.lexsort(low[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in low], axis=0)
        #: Equal windows are one kind: it is looked up once, however many items hold it.
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        first = order[new]
        self.low, self.high, self.run, self.first = [k[first] for k in low], [k[first] for k in high], self.size[first], first
        kinds, self.items = np.divmod(np.unique(self.kind * max(len(n), 1) + self.item), max(len(n), 1))
        self.items_ptr = np.searchsorted(kinds, np.arange(len(first) + 1))

    def _keys(self, filler: int) -> list[np.ndarray]:
        cols = [np.where(k < self.size, self.words[np.minimum(self.at + k, len(self.words) - 1)], filler) for k in range((self.window // _PER_KEY + 1) * _PER_KEY)]
        return pack(cols)


def pack(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Three word ids to a 63-bit key, the first word foremost."""
    return [cols[i] << 2 * _BITS | cols[i + 1] << _BITS | cols[i + 2] for i in range(0, len(cols), _PER_KEY)]


def lower_bound(keys: list[np.ndarray], query: list[np.ndarray]) -> np.ndarray:
    """For each query, how many entries of the sorted keys are smaller: binary search over all key columns at once."""
    lo, hi = np.zeros(len(query[0]), np.int64), np.full(len(query[0]), len(keys[0]), np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, q in zip(keys, query, strict=True):
            a, b = k[mid], q[open_]
            less |= same & (a < b)
            same &= a == b
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of n, one run after another."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def search(words: K.Words, hashes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """All places in the shard's words where a kind of window stands, and the kinds.

    Kinds of one length exclude each other, so there are at most `window` for each place.
    """
    none = np.zeros(0, np.int64)
    if not len(block.vocab) or not len(hashes):
        return none, none
    found = np.minimum(np.searchsorted(block.vocab, hashes), len(block.vocab) - 1)
    ids = np.where(block.vocab[found] == hashes, found + 1, 0)
    follows = np.append(ids[1:], 0)
    ends = words.ptr[1:][words.counts > 0] - 1
    follows[ends] = 0
    code = ids << _BITS | follows
    can = np.zeros(len(ids), bool)
    if len(block.pairs):
        at = np.minimum(np.searchsorted(block.pairs, code), len(block.pairs) - 1)
        can = (block.pairs[at] == code) & (ids > 0) & (follows > 0)
    if len(block.single):
        can |= np.isin(ids, block.single)
    places = np.flatnonzero(can)
    if not len(places):
        return none, none
    end = np.repeat(words.ptr[1:], words.counts)[places]
    last = len(ids) - 1
    depth = (block.window // _PER_KEY + 1) * _PER_KEY
    keys = pack([np.where(places + k < end, ids[np.minimum(places + k, last)], 0) for k in range(depth)])
    order = np.lexsort(keys[::-1])
    array, keys = places[order], [k[order] for k in keys]
    lo, hi = lower_bound(keys, block.low), lower_bound(keys, block.high)
    n = hi - lo
    return array[spread(lo, n)], np.repeat(np.arange(len(n)), n)


def _slots(at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of ascending positions in a line that has one empty place before each run of neighbours in a text."""
    new = np.ones(len(at), np.int64)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    return np.arange(len(at)) + np.cumsum(new)


def longest(places: np.ndarray, kind: np.ndarray, text: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """places, at, n_words: for each place of a full window, the longest run of words from there that an item holds, and where.

    A run of n + window - 1 words is a run of n windows.  Names of runs of 1, 2,
    4 ... windows, doubled until none is common to both sides, order the shard's
    suffixes; every suffix of the items is looked up among them by binary search,
    and a place's longest match is with one of its two neighbours among those.
    """
    held = np.zeros(len(block.run), bool)
    held[kind] = True
    own = np.flatnonzero(held[block.kind] & (block.size == block.window))
    by = np.argsort(places)
    places, kind = places[by], kind[by]
    doc, item = _slots(places, text[places]), _slots(block.at[own], block.item[own])
    item += doc[-1] + 1
    line = np.zeros(item[-1] + 2, np.int64)
    line[doc], line[item] = kind + 1, block.kind[own] + 1
    ends = np.flatnonzero(line == 0)
    room = ends[np.searchsorted(ends, np.arange(len(line)))] - np.arange(len(line))
    names, step, common = [line], 1, True
    while common:
        after = np.zeros(len(line), np.int64)
        after[: max(len(line) - step, 0)] = names[-1][step:]
        names.append(np.unique(names[-1] << 32 | after, return_inverse=True)[1].astype(np.int64))
        step *= 2
        d, i = doc[room[doc] >= step], item[room[item] >= step]
        common = bool(np.isin(names[-1][d], names[-1][i]).any())
    rank = names[-1]
    array = doc[np.argsort(rank[doc], kind="stable")]
    item_order = np.argsort(rank[item], kind="stable")
    found = np.searchsorted(rank[array], rank[item[item_order]])
    upper = np.searchsorted(found, np.arange(len(array)), "right")
    n, where = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
    for near in (upper - 1, upper):
        near = item_order[np.clip(near, 0, len(item) - 1)]
        same = np.zeros(len(array), np.int64)
        for k in range(len(names) - 1, -1, -1):
            a, b = np.minimum(array + same, len(line) - 1), np.minimum(item[near] + same, len(line) - 1)
            same += (names[k][a] == names[k][b]).astype(np.int64) << k
        same = np.minimum(np.minimum(same, room[array]), room[item[near]])
        better = same > n
        n[better], where[better] = same[better], near[better]
    back = np.searchsorted(doc, array)
    size, at = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    size[back], at[back] = n + block.window - 1, own[where]
    return places, at, size


def _shard(batch_ids: pa.Array, texts: pa.Array, blocks, with_matches: bool) -> dict[str, pa.Array]:
    words = K.split_words(texts, K.NON_ALNUM)
    hashes = words.hashes(lower=True)
    n_texts = len(texts)
    hit = np.zeros(len(hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_texts)]
    longest_of = np.zeros(n_texts, np.int64)
    matches: list[list[dict]] = [[] for _ in range(n_texts)]
    of = words.text_of()
    for block in blocks:
        places, kind = search(words, hashes, block)
        if not len(places):
            continue
        np.add.at(hit, places, 1)
        np.add.at(hit, places + block.run[kind], -1)
        d, k = np.divmod(np.unique(of[places] * len(block.run) + kind), len(block.run))
        for text, kinds in zip(np.unique(d), np.split(k, np.flatnonzero(np.diff(d)) + 1), strict=True):
            of_kinds = spread(block.items_ptr[kinds], block.items_ptr[kinds + 1] - block.items_ptr[kinds])
            items[text].update(block.ids[i] for i in np.unique(block.items[of_kinds]))
        full = block.run[kind] == block.window
        p, at, n = places[~full], block.first[kind[~full]], block.run[kind[~full]]
        if full.any():
            p2, at2, n2 = longest(places[full], kind[full], of, block)
            new = np.ones(len(p2), bool)  # not the rest of the match that begins one word earlier
            new[1:] = (p2[1:] != p2[:-1] + 1) | (of[p2[1:]] != of[p2[:-1]]) | (n2[1:] + 1 != n2[:-1])
            p, at, n = (np.append(x, y[new]) for x, y in ((p, p2), (at, at2), (n, n2)))
        np.maximum.at(longest_of, of[p], n)
        if with_matches:
            for x, w, size in zip(p, at, n, strict=True):
                b = block.at[w]
                matches[of[x]].append({"item_id": block.ids[block.item[w]], "item_pos": int(b - block.item_first[b]), "doc_pos": int(x - words.ptr[of[x]]), "n_words": int(size)})
    covered = (np.cumsum(hit[:-1]) > 0).astype(np.int64)
    out = {
        "doc_id": batch_ids,
        "n_words": pa.array(words.counts.astype(np.int64)),
        "n_hit": pa.array(K.sums(covered, words.ptr)),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
        "longest_match": pa.array(longest_of),
    }
    if with_matches:
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("n_words", pa.int64())]))
        out["matches"] = pa.array([sorted(x, key=lambda m: (m["doc_pos"], m["item_id"], m["item_pos"])) for x in matches], kind)
    return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark, block by block; only one block is held on the driver at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    chars = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(chars) // block_chars))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = part.toArrow().to_pydict()
        yield Block(got["i"], got["t"], window)


def find(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, with_matches: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, longest_match[, matches].

    A word is hit if it stands in an occurrence of a run of `window` words of an
    item (of the whole item, if that is shorter).  `matches` lists, for each place of
    the document where one begins, the longest verbatim match and one place in the
    benchmark that holds it, in words; of equally long ones any.
    """
    sc = documents.sparkSession.sparkContext
    held = [sc.broadcast(b) for b in blocks_of(benchmark, item_col, item_text_col, window)]
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = f"n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, longest_match bigint{', matches ' + MATCH if with_matches else ''}"
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(1), SHARD_BYTES):
                yield pa.RecordBatch.from_pydict(_shard(batch.column(0)[a:b], batch.column(1)[a:b], (x.value for x in held), with_matches))

    return docs.mapInArrow(K.releasing(run), schema)


def remove(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, without those with a verbatim match of `min_words` words or more.

    Items of fewer words than that remove nothing; a match of exactly so many removes.
    Null and empty texts are kept.  The verdict is computed beside each row, so neither
    null nor repeated ids matter.
    """
    sc = documents.sparkSession.sparkContext
    held = [sc.broadcast(b) for b in blocks_of(benchmark, "item_id", "text", window)]
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for a, b in K.slices(texts, SHARD_BYTES):
                n = _shard(pa.nulls(b - a), texts[a:b], (x.value for x in held), False)["longest_match"]
                yield batch.slice(a, b - a).filter(pa.compute.less(n, min_words))

    return documents.mapInArrow(K.releasing(run), documents.schema)
