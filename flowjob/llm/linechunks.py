"""Line dedup by content-defined chunks of lines.

Lines without words are left out of account.  A hash rolls over each two lines in a
row; it puts a boundary between them where it is the smaller one of two neighbours
(either side), so boundaries depend on three or four lines around them and shift with
the text.  A line of LONG_WORDS words or more has a boundary on both sides.  What
stands between boundaries is a chunk: a long line, or two shorter ones; a single
shorter line takes in the line behind it (at the end of a text, that before it).

Chunks that stand elsewhere in the corpus, earlier in the order of (doc_id, hash of
the text, place in it), are removed once their bytes have been compared, and with them
up to NEAR lines before and behind that equal (by 64-bit hash) those around the first
place.  A shared passage of five shorter lines, or with one long line, holds a whole
chunk, and no more than NEAR of its lines on either side lie outside such chunks; so it
goes from end to end.  A line is only removed where the same line stands earlier, so
the first one of each always stays.

Chunks meet their equals by one shuffle on a 64-bit hash.  Hashes with more
than a thousandth of all chunks (a thousand at most, so their list is a bounded
broadcast) are dealt to `salts` tasks each; only what those tasks leave as first,
one chunk a task, meets again.  Documents are joined with their own list of
removed chunks.

Defined results: a null text stays null and has no lines; an empty text stays; lines
without words go with the line before them, and with all others where no other line is
left; a text's only line is never removed if it is short; null ids come first in the
order; rows that repeat both id and text count as one document and come out alike; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowjob.llm import textkit as K
from flowjob.llm.tables import free_name, written

#: Fewer words make a line short: it is no chunk by itself.
LONG_WORDS = 10
#: Lines before and behind a chunk that go with it.
NEAR = 2
SALTS = 64


def chunks(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of a slice of texts: "starts", "ends" and "text" of each line, "some", the lines with words, "hash" of these; of each chunk "first" and "last", places in "some", "owner", its text, and "no", its number there."""
    starts, ends, text = K.lines(data, offsets)
    words = K.spans(data, offsets, ~K.SPACES)[0]
    n = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    some = np.flatnonzero(n)
    h, long, of = K.span_hashes(data, starts[some], ends[some]), n[some] >= LONG_WORDS, text[some]
    m = max(len(some) - 1, 0)  # gaps between lines
    same = of[1:] == of[:-1]
    open_ = same & ~long[1:] & ~long[:-1]
    roll = K.pair(h[:-1], h[1:]) if m else np.zeros(0, np.uint64)
    least = np.zeros(m, bool)
    both = open_[1:] & open_[:-1]
    least[1:] = both & (roll[1:] <= roll[:-1])
    least[:-1] |= both & (roll[:-1] < roll[1:])
    cut = np.flatnonzero(~open_ | least)
    first, last = np.append(0, cut + 1)[: len(some) and None], np.append(cut, m)[: len(some) and None]
    alone = (first == last) & ~long[first]
    behind = alone & (last < m) & np.append(same, False)[last]
    before = alone & ~behind & (first > 0) & np.append(False, same)[first]
    first, last = np.where(before, first - 1, first), np.where(behind, last + 1, last)
    keep = ~alone | behind | before
    first, last = first[keep], last[keep]
    owner = of[first]
    return {"starts": starts, "ends": ends, "text": text, "some": some, "hash": h, "first": first, "last": last, "owner": owner, "no": np.arange(len(owner)) - np.searchsorted(owner, owner)}


def neighbours(c: dict[str, np.ndarray]) -> np.ndarray:
    """For each chunk the hashes of NEAR lines before it, nearest first, and of NEAR lines behind it; 0 beyond the text."""
    out = np.zeros((len(c["first"]), 2 * NEAR), np.uint64)
    of = c["text"][c["some"]]
    for k in range(NEAR):
        for column, at in ((k, c["first"] - 1 - k), (NEAR + k, c["last"] + 1 + k)):
            there = (at >= 0) & (at < len(of))
            there[there] = of[at[there]] == c["owner"][there]
            out[there, column] = c["hash"][at[there]]
    return out


def _chunk_rows(docs: DataFrame, with_bytes: bool) -> DataFrame:
    """docs: doc_id, key, text.  One row for each chunk; bytes are its lines, near the neighbours' hashes."""
    kinds = [docs.schema["doc_id"], docs.schema["key"], T.StructField("no", T.LongType()), T.StructField("chunk", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(2)):
                data, offsets = K.buffers(batch.column(2)[a:b])
                c = chunks(data, offsets)
                hashes = c["hash"][c["first"]]
                for k in range(1, 3):  # a chunk has three lines at most
                    more = c["first"] + k <= c["last"]
                    hashes[more] = K.pair(hashes[more], c["hash"][c["first"][more] + k])
                at = pa.array(c["owner"] + a)
                out = [batch.column(0).take(at), batch.column(1).take(at), pa.array(c["no"]), pa.array(hashes.view(np.int64))]
                if with_bytes:
                    raw, starts, ends = data.tobytes(), c["starts"][c["some"]].tolist(), c["ends"][c["some"]].tolist()
                    lines = (b"\n".join(raw[starts[k] : ends[k]] for k in range(i, j + 1)) for i, j in zip(c["first"].tolist(), c["last"].tolist(), strict=True))
                    near = neighbours(c).tobytes()
                    out += [pa.array(list(lines), pa.binary()), pa.array([near[i : i + 16 * NEAR] for i in range(0, len(near), 16 * NEAR)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "key", "no", "chunk", "bytes", "near"][: len(out)])

    return docs.mapInArrow(K.releasing(run), T.StructType([*kinds, *[T.StructField(n, T.BinaryType()) for n in ("bytes", "near")][: 2 * with_bytes]]))


def alike(one: bytes, other: bytes) -> int:
    """How many lines before two chunks with these neighbours are equal, times NEAR + 1, and how many behind them."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    same = ((x == y) & (x > 0)).tolist()
    before, behind = ((side + [False]).index(False) for side in (same[:NEAR], same[NEAR:]))
    return before * (NEAR + 1) + behind


def _settle(rows: DataFrame, pass_on: bool) -> DataFrame:
    """rows: doc_id, key, no, chunk, bytes, near, salt in the order of (chunk, salt, ...).  The repeated ones, with what goes along; with pass_on also the first ones of salted chunks, with their bytes."""
    carried = ("doc_id", "key", "no", "chunk", "bytes", "near")
    schema = T.StructType([*(rows.schema[n] for n in carried), T.StructField("along", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, {}  # bytes: the first place, its neighbours; rows that repeat the place are that place again
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(3)), np.asarray(batch.column(6)).astype(np.int64)])
            again = np.zeros(batch.num_rows, bool)
            again[1:] = (keys[:, 1:] == keys[:, :-1]).all(0)
            runs = again.copy()
            runs[:-1] |= again[1:]
            runs[:1] = runs[-1:] = True
            emit, along = [], []
            salted = keys[1] >= 0
            if pass_on:
                runs |= salted
            for i in np.flatnonzero(runs).tolist():
                key = (int(keys[0, i]), int(keys[1, i]))
                if key != current:
                    current, seen = key, {}
                value, near, place = batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), tuple(batch.column(k)[i].as_py() for k in range(3))
                if value in seen:
                    if seen[value][0] != place:
                        emit.append(i)
                        along.append(alike(near, seen[value][1]))
                else:
                    seen[value] = place, near
                    if pass_on and salted[i]:
                        emit.append(i)
                        along.append(None)
            at, along = pa.array(emit, pa.int64()), pa.array(along, pa.int64())
            got = [batch.column(k).take(at) for k in range(6)]
            for k in (4, 5):
                got[k] = pa.compute.if_else(along.is_null(), got[k], pa.scalar(None, got[k].type))
            yield pa.RecordBatch.from_arrays([*got, along], schema.names)

    return rows.mapInArrow(K.releasing(run), schema)


def repeated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, key (xxhash64 of the text), no, along (see ``alike``): the chunks to remove."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    counts = written(_chunk_rows(docs, False).groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1"), "chunks")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") > max(1000, total // 1000)).select("chunk").collect()]
    salt = F.when(F.col("chunk").isin(hot), F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts))).otherwise(-1) if hot else F.lit(-1)
    rows = _chunk_rows(docs, True).withColumn("salt", salt.cast("int"))
    once = written(_settle(rows.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "doc_id", "key", "no"), True), "settled")
    out = once.where("along is not null").select("doc_id", "key", "no", "along")
    if hot:
        left = once.where("along is null").select("doc_id", "key", "no", "chunk", "bytes", "near", F.lit(0).alias("salt"))
        out = out.unionByName(_settle(left.repartition("chunk").sortWithinPartitions("chunk", "doc_id", "key", "no"), False).select("doc_id", "key", "no", "along"))
    return out.distinct()


def dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", report: str | None = None) -> DataFrame:
    """The documents, all columns kept, without the lines of repeated chunks in their texts.

    report: name of a further column with a struct of n_lines, n_chunks,
    n_removed_chunks and n_removed_lines (0 for a null text).
    """
    if report is not None and report in documents.columns:
        raise ValueError(f"there is a column {report} already")
    key, gone = free_name(documents, "chunk_key"), free_name(documents, "chunks_gone")
    drop = repeated(documents, id_col=id_col, text_col=text_col).groupBy("doc_id", "key").agg(F.collect_list(F.col("no") * F.lit((NEAR + 1) ** 2) + F.col("along")).alias(gone))
    docs = documents.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    joined = docs.join(drop.hint("merge"), (docs[key] == drop["key"]) & docs[id_col].eqNullSafe(drop["doc_id"]), "left").select(*(docs[c] for c in documents.columns), drop[gone])
    at = documents.columns.index(text_col)
    counts = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
    extra = [T.StructField(report, T.StructType([T.StructField(n, T.LongType()) for n in counts]))] if report else []
    schema = T.StructType([*documents.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts, lists = part.column(at), part.column(part.num_columns - 1)
                data, offsets = K.buffers(texts)
                c = chunks(data, offsets)
                ptr, own = (np.searchsorted(c[k], np.arange(len(texts) + 1)) for k in ("text", "owner"))
                hit, removed, taken = np.zeros(len(c["some"]), bool), np.zeros(len(c["text"]), bool), np.zeros(len(texts), np.int64)
                blank = np.ones(len(c["text"]), bool)
                blank[c["some"]] = False
                change = np.flatnonzero(np.asarray(lists.is_valid()))
                for d in change.tolist():
                    no, along = np.divmod(np.array(lists[d].as_py(), np.int64), (NEAR + 1) ** 2)
                    for k, x in zip((own[d] + no).tolist(), along.tolist(), strict=True):
                        hit[c["first"][k] - x // (NEAR + 1) : c["last"][k] + x % (NEAR + 1) + 1] = True
                    taken[d] = len(np.unique(no))
                removed[c["some"]] = hit
                if len(change):
                    new = texts.to_pylist()
                    raw = data.tobytes()
                    for d in change.tolist():
                        here, none = removed[ptr[d] : ptr[d + 1]], blank[ptr[d] : ptr[d + 1]]
                        before = np.maximum.accumulate(np.where(none, -1, np.arange(len(none))))
                        here[:] = (before >= 0) & here[before] | (here | none).all()
                        new[d] = b"\n".join(raw[c["starts"][k] : c["ends"][k]] for k in range(ptr[d], ptr[d + 1]) if not removed[k]).decode("utf-8", "replace")
                    texts = pa.array(new, texts.type)
                cols = [*part.columns[:-1]]
                cols[at] = texts
                if report:
                    there = np.asarray(part.column(at).is_valid()).astype(np.int64)
                    figures = [np.diff(ptr), np.diff(own), taken, K.sums(removed.astype(np.int64), ptr)]
                    cols.append(pa.StructArray.from_arrays([pa.array((f * there).astype(np.int64)) for f in figures], list(counts)))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return joined.mapInArrow(K.releasing(run), schema)
