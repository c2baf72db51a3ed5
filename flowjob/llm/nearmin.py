"""Near-duplicate documents by a chosen-path set similarity join over minhashes.

Texts with equal shingle sets form a class; one text stands for it.  A class has
`SKETCH` minwise tokens of 32 bits.  Large groups of near copies are settled first, each
around a pivot.  The number of tokens in which two classes differ is a distance, so what
differs from a class in `SKETCH - AGREE` tokens at most, as candidates do, differs from
the pivot in so many more at most: a class that agrees with the pivot in `AGREE` tokens
(the core) has all its candidates among those that agree with it in `2 * AGREE - SKETCH`
(the ball).  Core classes are confirmed against the pivot, a ball's components are compared
with each other, and then its core is done.  Groups are found by two tokens in common,
in `TURNS` turns by two others each: unrelated classes that share the two tokens can hide
a group in one turn, but not in all.  The pivots of all turns are settled together, as each
settling reads texts.  Where it would take more rows than the trees do, and beyond the
`PIVOTS` largest groups of each turn, classes stay for the trees.

In each of `trees` independent trees all other classes begin at the root, and a node of more than `limit` classes branches: its path selects
a coordinate, and at times a second one (1 / 0.8 on average, so that what a pair of
similarity 0.8 has in common neither grows nor dies out), and each of its classes goes
on to the children that its own tokens there name.  A node of `limit` classes or fewer
is compared exhaustively, on a byte of each token first.  A node of `block` classes or fewer
goes to one task, which does all of its further levels in memory.  A larger one branches by
DataFrame functions alone, a level being one count and one join, so a hot node's rows are split.

Nodes that are still larger than `block` after two levels hold groups of near copies, most often.
All their classes are compared with one pivot; candidates are confirmed on the full sets,
recomputed from the texts, and confirmed links give components.  Nodes whose classes
are in one component by then are done, so a large group of copies is never paired
within itself; the others go on branching.  What has more than `limit` classes after `depth`
levels, in a task or not, is treated alike once more, and then compared exhaustively, in pairs of blocks that no task
exceeds: the classes outside the node's largest component with all others, first on
the sketches, which leaves the classes with any candidate, and those on the full
sets, until they are linked.  A pair of similarity 0.8 meets in a tree with probability
0.52 at least (``meeting``), so with 21 trees all but 2 in 10**7 such pairs meet
(``trees_for``), most of them far surer, as they need two levels or three.

Defined results: a text without words (also null or empty) has no shingles, is
linked with nothing and is its own component; rows with equal texts, or with equal
sets, are in one component; a null id takes part in its text's class but is no
component's id, unless the component has no other; an empty table gives an empty
result; further columns are ignored, or kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.llm import textkit as K
from flowjob.llm.components import components
from flowjob.llm.tables import discard, free_name, written

SHINGLE, PERCENT = 2, 80
TREES, SKETCH, LIMIT, DEPTH, BLOCK = 21, 64, 32, 5, 2048
#: Shingles of all classes in a block, at most, unless it has fewer than 64 classes.
BLOCK_SHINGLES = 8_000_000
#: A pair of similarity 0.8 agrees on 51 of 64 sketch bytes, with a deviation of 3.2.
AGREE = 36
#: Groups that are settled in a turn before the trees, at most, the classes of each of which one becomes the pivot, and turns.
PIVOTS, SAMPLE, TURNS = 4096, 16, 4
#: Rows for each core class that a group's blocks may take, at most; in the trees it has 1.25 for each tree and level.
DEAR = 8
#: Bits of the bitmap that spares texts a shuffle: 2 MB at most.
MARKS = 1 << 24
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def meeting(similarity: float = 0.8, percent: int = PERCENT, depth: int = DEPTH) -> float:
    """The probability that a pair of this similarity is still in one node after so many levels of a tree."""
    second, q = 100 / percent - 1, 1.0
    for _ in range(depth):
        q = (1 - second) * similarity * q + second * (1 - (1 - similarity * q) ** 2)
    return q


def trees_for(recall: float, similarity: float = 0.8) -> int:
    """Trees that find a pair of this similarity with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(similarity)))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its word shingles (of its whole sequence, if shorter)."""
    words = K.split_words(texts)
    h = words.hashes(lower=True)
    n = len(h)
    key = np.full(max(n - size + 1, 0), size, np.uint64)
    for k in range(size):
        key = K.pair(key, h[k : k + len(key)])
    ptr = words.ptr.tolist()
    for d in range(len(ptr) - 1):
        a, b = ptr[d], ptr[d + 1]
        if b - a >= size:
            yield np.unique(key[a : b - size + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = K.pair(one, h[k : k + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, tkey, text.  doc_id, tkey, n, cls, tokens (SKETCH of four bytes), sketch (a byte of each); the last three null without shingles."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["tkey"], T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(2)):
                sets = list(shingle_sets(batch.column(2)[a:b], size))
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                at = np.cumsum(n[some]) - n[some]
                values = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
                least = np.zeros((len(some), SKETCH), np.uint64)
                if len(some):
                    for k in range(SKETCH):
                        least[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _MULTIPLY[k], at)
                    one = np.add.reduceat(K.mix(values), at)
                    two = np.bitwise_xor.reduceat(K.mix(values + np.uint64(0x5851F42D4C957F2D)), at)
                    name = np.stack([K.mix(one + n[some].astype(np.uint64)), two], 1).astype(">u8")
                    token = (K.mix(least) >> np.uint64(32)).astype("<u4")
                    sketch = (token & np.uint32(255)).astype(np.uint8)
                cls, tok, sk = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                for j, i in enumerate(some.tolist()):
                    cls[i], tok[i], sk[i] = name[j].tobytes(), token[j].tobytes(), sketch[j].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n), pa.array(cls, pa.binary()), pa.array(tok, pa.binary()), pa.array(sk, pa.binary())], schema.names)

    return docs.mapInArrow(K.releasing(run), schema)


def _marked(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The docs (tkey) whose bit is set in a broadcast bitmap of reps (k): all that a join by these keeps and few others, so that its shuffle takes no other texts."""
    own, asked = F.pmod("tkey", F.lit(MARKS)), F.pmod("k", F.lit(MARKS))
    marks = reps.groupBy(F.bitmap_bucket_number(asked).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(asked)).alias("marks"))
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substr("marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(marks), F.bitmap_bucket_number(own) == F.col("bucket")).where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "marks")


_PAIRS = "a binary, b binary"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH)


def _fit(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def _pairs(first: list, second: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(first, second, strict=True)], pa.binary()), pa.array([max(x) for x in zip(first, second, strict=True)], pa.binary())], ["a", "b"])


def _alike(sketch: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places i < j of candidates among all pairs."""
    i, j = np.nonzero(((sketch[:, None, :] == sketch[None, :, :]).sum(2) >= AGREE) & _fit(n[:, None], n[None, :], percent))
    return i[i < j], j[i < j]


def _compare_nodes(rows: DataFrame, percent: int) -> DataFrame:
    """rows: node, cls, n, sketch of small nodes.  Candidate pairs within each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(held: list) -> tuple[list, list]:
            sk = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), SKETCH)
            i, j = _alike(sk, np.array([r[1] for r in held]), percent)
            return [held[x][0] for x in i.tolist()], [held[x][0] for x in j.tolist()]

        node, held = None, []
        for batch in batches:
            out: tuple[list, list] = [], []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if len(held) > 1:
                        for o, got in zip(out, compared(held), strict=True):
                            o.extend(got)
                    node, held = key, []
                held.append(row)
            yield _pairs(*out)
        if len(held) > 1:
            yield _pairs(*compared(held))

    return rows.select("node", "cls", "n", "sketch").repartition("node").sortWithinPartitions("node", "cls").mapInArrow(K.releasing(run), _PAIRS)


def _sizes(rows: DataFrame) -> DataFrame:
    """rows: node, n, label.  Of each node the largest label with its count, the number of rows and the largest set."""
    counts = rows.groupBy("node", "label").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return counts.groupBy("node").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.max("n").alias("longest"))


def _blocks(count: Column, block: int) -> Column:
    """The blocks that so many rows of a node are dealt to."""
    most = F.greatest(F.least(F.lit(block), F.floor(F.lit(BLOCK_SHINGLES) / F.col("longest"))), F.lit(min(64, block)))
    return F.greatest(F.ceil(count / most), F.lit(1)).cast("int")


def _deal(rows: DataFrame, block: int) -> DataFrame:
    """rows (node, cls, n, sketch, label) with i, j: the pairs of blocks that each goes to.

    A node's largest label is dealt to some blocks, the rest to others; each block
    of the rest meets every block, so no task has more than two blocks.  What nodes
    are joined with is written first: then both sides of the join are plain
    exchanges, and a hot node's rows can be split.
    """
    r = rows.join(written(_sizes(rows), "blocks"), "node").withColumn("main", F.col("label") == F.col("top.label"))
    r = r.withColumn("nm", _blocks(F.col("top.c"), block)).withColumn("nr", _blocks(F.col("m") - F.col("top.c"), block))
    own = F.pmod(F.xxhash64("cls", "node"), F.when(F.col("main"), F.col("nm")).otherwise(F.col("nr"))).cast("int")
    # the rest's block k meets main block b under key (-1 - b, k), and rest block l >= k under key (k, l)
    rest = F.concat(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda b: F.struct((-1 - b).alias("i"), F.col("own").alias("j"))), F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))))
    main = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda k: F.struct((-1 - F.col("own")).alias("i"), k.alias("j")))
    dealt = r.withColumn("own", own).select("node", "cls", "n", "sketch", "label", F.explode(F.when(F.col("main"), main).otherwise(rest)).alias("k"))
    return dealt.select("node", "k.i", "k.j", "cls", "n", "sketch", "label")


class _Block:
    """The rows of a pair of blocks, and which of them may be linked."""

    def __init__(self, held: list[pa.RecordBatch], percent: int):
        t = pa.Table.from_batches(held).combine_chunks()
        self.table, self.percent = t, percent
        self.cls, self.n = t["cls"].to_pylist(), np.asarray(t["n"])
        self.sketch = _matrix(t["sketch"])
        label = t["label"].to_pylist()
        names = {x: i for i, x in enumerate(dict.fromkeys(label))}
        self.label = np.array([names[x] for x in label])

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The later rows of other labels that i may be similar to, and how many sketch bytes agree."""
        agree = (self.sketch[i + 1 :] == self.sketch[i]).sum(1)
        ok = (agree >= AGREE) & _fit(self.n[i + 1 :], self.n[i], self.percent) & (self.label[i + 1 :] != self.label[i])
        at = np.flatnonzero(ok)
        return at + i + 1, agree[at]


def _by_block(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """done(the batches of a node, i, j) for each of them; the rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        key = np.stack([np.asarray(x.column(k)).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), x.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if held and any(held[0].column(k)[0] != x.column(k)[a] for k in range(3)):
                    yield done(held)
                    held = []
                held.append(x.slice(a, b - a))
    if held:
        yield done(held)


def _promising(dealt: DataFrame, percent: int) -> DataFrame:
    """The dealt rows with a candidate among the rows they meet; no more than came in, and no texts are needed yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = _Block(held, percent)
            keep = np.zeros(len(block.cls), bool)
            for i in range(len(keep)):
                at, _ = block.candidates(i)
                keep[at] = True
                keep[i] |= len(at) > 0
            return block.table.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else held[0].slice(0, 0)

        yield from _by_block(batches, some)

    return dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "cls").mapInArrow(K.releasing(run), dealt.schema)


def _compare_blocks(promising: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different labels within each pair of blocks."""
    full = promising.join(texts, "cls").select("node", "i", "j", "cls", "n", "sketch", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block, sets, parent = _Block(held, percent), {}, {}
            column, n, label = block.table["text"].combine_chunks(), block.n, block.label

            def find(x):
                while x in parent:
                    x = parent[x]
                return x

            def shingles(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = next(iter(shingle_sets(column.slice(i, 1), size)))
                return sets[i]

            out: tuple[list, list] = [], []
            for i in range(len(n)):
                at, agree = block.candidates(i)
                own = find(label[i])
                at = [j for j in at[np.argsort(-agree, kind="stable")].tolist() if find(label[j]) != own]
                for k in range(0, len(at), 256):  # together, as most of them may be checked in vain
                    some = [j for j in at[k : k + 256] if find(label[j]) != find(label[i])]
                    if not some:
                        continue
                    mine, sets_of = shingles(i), [shingles(j) for j in some]
                    other = np.concatenate(sets_of)
                    hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
                    same = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, sets_of[:-1])]))
                    for j in np.array(some)[100 * same >= percent * (n[i] + n[some] - same)].tolist():
                        a, b = find(label[i]), find(label[j])
                        if a != b:
                            parent[a] = b
                            out[0].append(block.cls[i])
                            out[1].append(block.cls[j])
            return _pairs(*out)

        yield from _by_block(batches, linked)

    return full.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "cls").mapInArrow(K.releasing(run), _PAIRS)


def _compare_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of each row with its node's pivot; the pivot is one row, so a hot node's rows can be split."""
    pivots = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("cls", "node").alias("h"), "cls", "n", "sketch", "label")).alias("p"))
    both = rows.join(written(pivots, "pivots"), "node").where("cls <> p.cls and label <> p.label").select("cls", "n", "sketch", F.col("p.cls").alias("c2"), F.col("p.n").alias("n2"), F.col("p.sketch").alias("s2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = ((_matrix(x.column(2)) == _matrix(x.column(5))).sum(1) >= AGREE) & _fit(np.asarray(x.column(1)), np.asarray(x.column(4)), percent)
            got = x.filter(pa.array(ok))
            yield _pairs(got.column(0).to_pylist(), got.column(3).to_pylist())

    return both.mapInArrow(K.releasing(run), _PAIRS)


def _tokens(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(len(column), SKETCH)


def _pivots(known: DataFrame, limit: int, turn: int) -> list[tuple[bytes, int, bytes]]:
    """cls, n, tokens of a class amid each large group, the largest groups first.

    More than `limit` classes with two tokens in common, others in each turn, are a group;
    of `SAMPLE` of them the one most like the others is taken, unless it is like a pivot
    already.  What comes to the driver is bounded by `PIVOTS`.
    """
    keyed = known.select(F.xxhash64(F.substr("tokens", F.lit(8 * turn + 1), F.lit(8))).alias("k"), "cls", "n", "tokens")
    largest = keyed.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > limit).orderBy(F.desc("c"), "k").limit(PIVOTS)
    some = keyed.join(F.broadcast(largest), "k").where(F.pmod(F.xxhash64("cls"), F.ceil(F.col("c") / SAMPLE)) == 0)
    groups = some.groupBy("k").agg(F.max("c").alias("c"), F.sort_array(F.collect_list(F.struct("cls", "n", "tokens"))).alias("g")).toArrow().to_pylist()
    amid = []
    for group in sorted(groups, key=lambda r: (-r["c"], r["k"])):
        tokens = _tokens([x["tokens"] for x in group["g"]])
        best = group["g"][int((tokens[:, None] == tokens[None]).sum((1, 2)).argmax())]
        amid.append((best["cls"], best["n"], best["tokens"]))
    return _unlike(amid)


def _unlike(pivots: list[tuple[bytes, int, bytes]]) -> list[tuple[bytes, int, bytes]]:
    """The pivots that are like none of those taken before them."""
    out, taken = [], np.zeros((len(pivots), SKETCH), np.uint32)
    for pivot, tokens in zip(pivots, _tokens([p[2] for p in pivots]), strict=True):
        if not ((taken[: len(out)] == tokens).sum(1) >= AGREE).any():
            taken[len(out)] = tokens
            out.append(pivot)
    return out


class _Balls:
    """Pivots, found by the tokens that a class has in common with them."""

    def __init__(self, pivots: list[tuple[bytes, int, bytes]], percent: int):
        self.n, self.percent = np.array([p[1] for p in pivots]), percent
        tokens = _tokens([p[2] for p in pivots]).T
        self.order = np.argsort(tokens, 1, kind="stable")
        self.tokens = np.take_along_axis(tokens, self.order, 1)

    def find(self, n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class and the pivot of each place in a ball, and whether it is in the core; a core class and its candidates may differ in size by `percent` each."""
        meets = []
        for order, held, asked in zip(self.order, self.tokens, np.ascontiguousarray(tokens.T), strict=True):
            first, last = np.searchsorted(held, asked), np.searchsorted(held, asked, "right")
            some = np.flatnonzero(last > first)
            many = (last - first)[some]
            at = np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            meets.append(np.repeat(some, many) * len(self.n) + order[at])
        key, agree = np.unique(np.concatenate(meets), return_counts=True)
        row, pivot = np.divmod(key, len(self.n))
        least, most = np.minimum(n[row], self.n[pivot]), np.maximum(n[row], self.n[pivot])
        core = (agree >= AGREE) & (100 * least >= self.percent * most)
        ball = (agree >= 2 * AGREE - SKETCH) & (10_000 * least >= self.percent**2 * most)
        return row[ball], pivot[ball], core[ball]


def _balls(known: DataFrame, limit: int, percent: int) -> DataFrame | None:
    """node, cls, n, sketch, p, core: for each pivot p (its number is the node) with a core of more than `limit` classes and not many more around it, its ball.  Of pivots that are alike, found in different turns, that with the largest core is taken."""
    pivots = list(dict.fromkeys(p for turn in range(TURNS) for p in _pivots(known, limit, turn)))
    if not pivots:
        return None

    def found(batch: pa.RecordBatch, balls: _Balls) -> Iterator[tuple]:
        """batch: n, tokens, ..."""
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            yield part, *balls.find(np.asarray(part.column(0)), _tokens(part.column(1).to_pylist()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, sizes = _Balls(pivots, percent), np.zeros((2, len(pivots)), np.int64)
        for batch in batches:
            for _, _, pivot, core in found(batch, balls):
                sizes += [np.bincount(pivot, minlength=len(pivots)), np.bincount(pivot[core], minlength=len(pivots))]
        at = np.flatnonzero(sizes[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[0][at]), pa.array(sizes[1][at])], ["node", "ball", "core"])

    counted = known.select("n", "tokens").mapInArrow(K.releasing(count), "node bigint, ball bigint, core bigint").groupBy("node").agg(F.sum("ball").alias("ball"), F.sum("core").alias("core"))
    chosen = _unlike([pivots[r["node"]] for r in counted.where((F.col("core") > limit) & (F.col("ball") <= 4 * F.col("core"))).orderBy(F.desc("core"), "node").collect()])
    if not chosen:
        return None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = _Balls(chosen, percent)
        names = pa.array([p[0] for p in chosen], pa.binary())
        for batch in batches:
            for part, row, pivot, core in found(batch, balls):
                got = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(pivot), got.column(2), got.column(0), got.column(3), names.take(pa.array(pivot)), pa.array(core)], ["node", "cls", "n", "sketch", "p", "core"])

    return written(known.select("n", "tokens", "cls", "sketch").mapInArrow(K.releasing(deal), "node bigint, cls binary, n bigint, sketch binary, p binary, core boolean"), "balls")


def _children(node: Column, tokens: Column, percent: int) -> Column:
    """array<bigint>: the children of its node that a class goes on to; the node alone selects their coordinates."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(SKETCH)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(SKETCH - 1)), F.lit(SKETCH)).cast("int")
    child = lambda k: F.xxhash64(node, k, F.substr(tokens, 4 * k + 1, F.lit(4)))
    twice = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(percent)) < 100 - percent
    return F.when(twice, F.array(child(first), child(second))).otherwise(F.array(child(first)))


def _descend(ids: np.ndarray, at: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The children, and whose they are, of the classes at[i] in nodes ids[i]; as ``_children``, by another hash."""
    roll = [K.mix(ids + np.uint64(k)) for k in (1, 2, 3)]
    first = roll[0] % np.uint64(SKETCH)
    second = (first + np.uint64(1) + roll[1] % np.uint64(SKETCH - 1)) % np.uint64(SKETCH)
    twice = roll[2] % np.uint64(percent) < 100 - percent
    ids, at, k = np.concatenate([ids, ids[twice]]), np.concatenate([at, at[twice]]), np.concatenate([first, second[twice]])
    return K.pair(K.pair(ids, k), tokens[at, k.astype(np.int64)]), at


def _branch(rows: DataFrame, limit: int, depth: int, percent: int) -> DataFrame:
    """rows: node, level, m, cls, n, tokens, children, of nodes that a task can hold.

    All their levels from the next one on.  node, a, b: candidate pairs a, b of nodes of
    `limit` classes or fewer, the node null; and each class a of a node that is larger
    after the last level, b null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def branched(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cls, n, tokens = t["cls"].to_pylist(), np.asarray(t["n"]), _tokens(t["tokens"].to_pylist())
            sketch, children = (tokens & np.uint32(255)).astype(np.uint8), t["children"].to_pylist()
            at = np.repeat(np.arange(len(cls)), [len(x) for x in children])
            ids = np.array([y for x in children for y in x], np.int64).view(np.uint64)
            pairs = [np.zeros(0, np.int64)]
            for level in range(t["level"][0].as_py() + 1, depth):
                if not len(ids):
                    break
                order = np.lexsort((at, ids))
                ids, at = ids[order], at[order]
                cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
                size = np.diff(cuts)
                for a, b in zip(cuts[:-1][(size > 1) & (size <= limit)].tolist(), cuts[1:][(size > 1) & (size <= limit)].tolist(), strict=True):
                    i, j = _alike(sketch[at[a:b]], n[at[a:b]], percent)
                    pairs.append(at[a:b][i] * len(cls) + at[a:b][j])
                large = np.repeat(size > limit, size)
                ids, at = ids[large], at[large]
                if level < depth - 1:
                    ids, at = _descend(ids, at, tokens, percent)
            i, j = np.divmod(np.unique(np.concatenate(pairs)), len(cls))
            found = _pairs([cls[x] for x in i.tolist()], [cls[x] for x in j.tolist()])
            node = pa.array([None] * len(i) + ids.view(np.int64).tolist(), pa.int64())
            a, b = (pa.concat_arrays([found.column(k), pa.array(rest, pa.binary())]) for k, rest in ((0, [cls[x] for x in at.tolist()]), (1, [None] * len(at))))
            return pa.RecordBatch.from_arrays([node, a, b], ["node", "a", "b"])

        yield from _by_block(batches, branched)

    rows = rows.select("node", "level", "m", "cls", "n", "tokens", "children")
    return rows.repartition("node").sortWithinPartitions("node", "cls").mapInArrow(K.releasing(run), f"node bigint, {_PAIRS}")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar; texts: cls, text."""
    left = pairs.join(texts.withColumnRenamed("text", "tb"), pairs["b"] == texts["cls"]).select("a", "b", "tb")
    both = left.join(texts.withColumnRenamed("text", "ta"), left["a"] == texts["cls"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            done = 0
            for a, b in K.slices(x.column(3)):
                for i, other in enumerate(shingle_sets(x.column(3)[a:b], size), a):
                    name = x.column(0)[i].as_py()
                    if name != last:
                        last, known = name, next(iter(shingle_sets(x.column(2)[i : i + 1], size)))
                    same = len(np.intersect1d(known, other, assume_unique=True))
                    keep[i] = 100 * same >= percent * (len(known) + len(other) - same)
                done = b
            assert done == x.num_rows
            yield x.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(K.releasing(run), _PAIRS)


def classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, limit: int = LIMIT, depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, tkey, n, cls for each document, and cls, component_id, rep for each class.

    tkey is the text's xxhash64; rep (doc_id, tkey) is the document that stands for the class's component.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tkey"), F.col(text_col).cast("string").alias("text"))
    sig = written(_signatures(docs, shingle), "signatures")
    who = F.struct("doc_id", "tkey")
    rep = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), who)), F.min(who))  # a row with an id, where there is one
    known = written(sig.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), rep.alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("tokens").alias("tokens")), "classes")

    def wanted(names: DataFrame) -> DataFrame:
        """cls, text for the classes named."""
        reps = written(names.distinct().join(known, "cls").select("cls", F.col("rep.doc_id").alias("i"), F.col("rep.tkey").alias("k")), "wanted")
        got = _marked(docs, reps).join(reps, (docs["tkey"] == reps["k"]) & docs["doc_id"].eqNullSafe(reps["i"])).select("cls", "text")
        return written(got.dropDuplicates(["cls"]), "texts")

    def met(rows: DataFrame) -> DataFrame:
        """The rows of nodes with two classes or more, with m, their number; node and class alone meet."""
        return written(rows.join(rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), "node"), "nodes")

    def described(rows: DataFrame) -> DataFrame:
        return rows.join(known.select("cls", "n", "sketch"), "cls").select("node", "cls", "n", "sketch", F.col("cls").alias("label"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct(), "candidates")
        return written(_confirm(pairs, wanted(pairs.select(F.explode(F.array("a", "b")).alias("cls"))), shingle, percent), "links")

    def mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
        """The rows of nodes whose classes are in several components by now, with these as labels."""
        rows = rows.drop("label").join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("node", "cls", "n", "sketch", F.coalesce("root", "cls").alias("label"))
        several = rows.groupBy("node").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("node")
        return written(rows.join(written(several, "several"), "node"), "mixed")

    def blocks(rows: DataFrame) -> DataFrame:
        """Links between the components of each node, all compared with each other."""
        near = written(_promising(_deal(rows, block), percent), "promising")
        return _compare_blocks(near, wanted(near.select("cls")), shingle, percent)

    small, middle, levels, links, first = [], [], [], [], known
    balls = _balls(known, limit, percent)
    if balls is not None:
        links.append(confirmed(balls.where("core and cls <> p").select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b"))))
        around = mixed(balls, components(links[0]))
        cores = balls.where("core").groupBy("node").agg(F.count("*").alias("cores"))
        dear = _sizes(around).join(cores, "node").where((F.col("m") - F.col("top.c")) * _blocks(F.col("m"), block) > DEAR * F.col("cores")).select("node")
        dear = written(dear, "dear")  # nodes that the trees take apart with fewer rows
        links.append(written(blocks(around.join(dear, "node", "left_anti")), "links"))
        settled = written(balls.join(dear, "node", "left_anti").where("core").select("cls").distinct(), "settled")
        first = written(known.select("cls", "tokens").join(settled, "cls", "left_anti"), "unsettled")
    each = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    rows = first.select("cls", "tokens", each).select("cls", F.explode(_children(F.xxhash64("tree"), F.col("tokens"), percent)).alias("node"))
    for level in range(depth):
        levels.append(met(rows))
        if level:
            discard(rows)
        small.append(levels[-1].where(F.col("m") <= limit).select("cls", "node"))
        most = limit if level == depth - 1 else max(limit, block)  # what one task can hold branches there
        held = levels[-1].where((F.col("m") > limit) & (F.col("m") <= most)).join(known.select("cls", "n", "tokens"), "cls")
        middle.append(held.select("node", F.lit(level).alias("level"), "m", "cls", "n", "tokens", _children(F.col("node"), F.col("tokens"), percent).alias("children")))
        large = levels[-1].where(F.col("m") > most).select("cls", "node")
        if large.isEmpty():
            break
        if level == 1:  # unrelated classes are apart by now: what stays together is most often one group of copies
            heads = written(described(large), "large")
            links.append(confirmed(_compare_pivots(heads, percent)))
            large = mixed(heads, components(reduce(DataFrame.unionByName, links))).select("cls", "node")
        if level < depth - 1:
            rows = written(large.join(known.select("cls", "tokens"), "cls").select("cls", F.explode(_children(F.col("node"), F.col("tokens"), percent)).alias("node")), "children")  # read twice
    branched = written(_branch(reduce(DataFrame.unionByName, middle), limit, depth, percent), "branched")
    large = written(described(large.unionByName(branched.where("node IS NOT NULL").select(F.col("a").alias("cls"), "node"))), "large")
    apart = _compare_nodes(described(reduce(DataFrame.unionByName, small)), percent).unionByName(branched.where("node IS NULL").select("a", "b"))
    links.append(confirmed(apart.unionByName(_compare_pivots(large, percent))))
    discard(*levels)
    joined = components(reduce(DataFrame.unionByName, links))
    if not large.isEmpty():
        rows = mixed(large, joined)
        if not rows.isEmpty():
            links.append(blocks(rows))
            joined = components(reduce(DataFrame.unionByName, links))
    full = known.join(joined, known["cls"] == joined["node"], "left").select("cls", "least", "rep", F.coalesce("root", "cls").alias("root"))
    best = full.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.when(F.col("rep.doc_id").isNotNull(), F.col("rep"))).alias("r1"), F.min("rep").alias("r2"))
    least = best.select("root", "component_id", F.coalesce("r1", "r2").alias("rep"))
    return sig.select("doc_id", "tkey", "n", "cls"), written(full.select("cls", "root").join(least, "root").select("cls", "component_id", "rep"), "components")


def label(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id is component_id)."""
    rows, found = classes(documents, **options)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(found, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, all columns kept: that with the least id, of its texts the one with the least hash, of equal rows any.

    Texts without words are all kept.
    """
    rows, found = classes(documents, id_col=id_col, text_col=text_col, **options)
    best = found.select("rep.doc_id", "rep.tkey").distinct()
    tkey, word = free_name(documents, "text_key"), free_name(documents, "has_words")
    docs = documents.withColumn(tkey, F.xxhash64(F.col(text_col).cast("string"))).withColumn(word, F.coalesce(F.col(text_col).cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    chosen = docs.where(word).join(best, (docs[tkey] == best["tkey"]) & docs[id_col].eqNullSafe(best["doc_id"]), "left_semi").dropDuplicates([id_col, tkey])
    return chosen.select(*documents.columns).unionByName(docs.where(~F.col(word)).select(*documents.columns))
