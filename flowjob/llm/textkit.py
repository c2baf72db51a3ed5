"""Vectorised word kernels over Arrow string columns.

Texts are read straight from Arrow's byte buffers: words are found by byte
class, hashed with one pass of numpy over the bytes, and never become Python
objects.  Every kernel works on slices of bounded size, so memory does not grow
with the batch; a single text is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that separate words of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that separate words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False

SLICE_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What remains of eight bytes when so many of them belong to a span.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def release() -> None:
    """Gives memory that was freed back to the system, where its C library can (glibc); others keep it for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; a worker outlives its tasks, and at the end of each it keeps nothing that was freed."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    s = np.sort(x)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(np.asarray(a, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(b, np.uint64))


@dataclass
class Words:
    """The words of a slice of texts; word i of text d: ``ptr[d] <= i < ptr[d + 1]``."""

    data: np.ndarray  # bytes of all texts, one after another
    offsets: np.ndarray  # where each text begins in data, and the end
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of(self) -> np.ndarray:
        """For each word, its text's number."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place (one more than there are bytes) the eight bytes that begin there, zeros beyond the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (none empty) in pieces of eight bytes: where each begins, its number in its span, the mask of its bytes; and the first piece of each span."""
    n = (ends - starts + 7) >> 3
    first = np.cumsum(n) - n
    k = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * k
    return at, k, _MASKS[np.minimum(np.repeat(ends, n) - at, 8)], first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes (empty spans: 0).

    Each piece of eight bytes is mixed, then mixed again with its place, so no
    arrangement of equal pieces cancels out.
    """
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(ends > starts)
    if len(some):
        at, k, mask, first = _pieces(starts[some], ends[some])
        values = mix(eights(_LOWER[data] if lower else data)[at] & mask)
        later = np.flatnonzero(k)
        values[later] = mix(values[later] + k[later].astype(np.uint64) * _ODD)
        out[some] = mix(np.add.reduceat(values, first) + (ends - starts)[some].astype(np.uint64) * _ODD)
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a[i] and b[i] hold the same bytes."""
    out = (ends - starts)[a] == (ends - starts)[b]
    some = np.flatnonzero(out & (ends > starts)[a])
    if len(some):
        x, _, mask, first = _pieces(starts[a[some]], ends[a[some]])
        y = _pieces(starts[b[some]], ends[b[some]])[0]
        eight = eights(data)
        out[some] = np.bitwise_or.reduceat((eight[x] ^ eight[y]) & mask, first) == 0
    return out


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span the place of the first span with the same bytes: by hash, and settled by the bytes themselves."""
    _, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    out = at[back]
    wrong = np.flatnonzero(~same_bytes(data, starts, ends, np.arange(len(out)), out))
    if len(wrong):  # different bytes with one hash
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(out, out[wrong])).tolist():
            out[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), i)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Row ranges (from, to) of at most so many bytes of text, or one row."""
    _, offsets = buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def split_words(column: pa.Array, separators: np.ndarray = SPACES) -> Words:
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets, ~separators)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of the class, within texts."""
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = mask[cut]
    cut = offsets[(offsets > 0) & (offsets <= len(data))] - 1
    last[cut] = mask[cut]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the break) of the lines that \\n separates, and their texts' numbers; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = offsets[1:][text]
    inner = np.flatnonzero(text[1:] == text[:-1])
    ends[inner] = starts[inner + 1] - 1
    return starts, ends, text


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte, with one more entry at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i + 1]]."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    if not len(values):
        return np.zeros(len(ptr) - 1, kind)
    if kind is np.float64:  # segment by segment, so that one text's sum never depends on its neighbours
        out = np.zeros(len(ptr) - 1)
        some = ptr[1:] > ptr[:-1]
        if some.any():
            out[some] = np.add.reduceat(values, ptr[:-1][some])
        return out
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[ptr[1:]] - run[ptr[:-1]]
