"""Elias-Fano sequences in numpy: monotone integers in about 2 + log2(universe / n) bits each.

Upper bits stand in unary in a bit vector (a one for each element, a zero for each
next value of the upper part), lower bits packed.  The places of zeros and of ones,
listed when a sequence is first asked, answer where an upper value's elements begin
and which element stands at a place.  ``Ranges`` are lists
of growing numbers, one after another: a sequence of pointers says where each list
begins, and each number is stored on top of the list before it, so that all of them
are one monotone sequence however small the numbers of a list are.  All arrays are
views of one buffer, which may be mapped memory; queries are vectorised.
"""

from __future__ import annotations

import json
import mmap
import os
from dataclasses import dataclass
from functools import cached_property

import numpy as np

_U = np.uint64


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width integers, one after another, in words of 64 bits (with one spare word)."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        v = values.astype(_U)
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[begin]] = np.bitwise_or.reduceat(v << shift, begin)
        over = np.flatnonzero(shift + _U(width) > 64)
        out[word[over] + 1] |= v[over] >> (_U(64) - shift[over])  # one value at most goes over the end of a word
    return out


def unpack_bits(packed: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), _U)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(_U)
    out = packed[word] >> shift
    over = np.flatnonzero(shift + _U(width) > 64)
    out[over] |= packed[word[over] + 1] << (_U(64) - shift[over])
    return out & _U((1 << width) - 1)


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: growing or equal, each below the universe."""
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(_U)
        upper = (values >> _U(low_bits)).astype(np.int64)
        size = n + (universe >> low_bits) + 2
        bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        bits[upper + np.arange(n)] = 1
        return cls(n, low_bits, pack_bits(values & _U((1 << low_bits) - 1), low_bits), np.packbits(bits, bitorder="little").view(_U))

    @cached_property
    def zeros(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)

    @cached_property
    def ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))

    def below(self, upper: np.ndarray) -> np.ndarray:
        """How many elements have a smaller upper part."""
        return np.where(upper > 0, self.zeros[np.maximum(upper - 1, 0)] - upper + 1, 0)  # the zero follows the last of them

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Each value's place in the sequence, or between the places lo and hi of it (its successor's, where it is missing, as -1 - place)."""
        values = np.asarray(values, np.int64)
        upper = values >> self.low_bits
        low = (values & ((1 << self.low_bits) - 1)).astype(_U)
        beyond = upper >= len(self.zeros)  # above the universe
        upper = np.where(beyond, 0, upper)
        at = np.where(beyond, self.n, self.below(upper))
        stop = np.where(beyond, self.n, self.below(upper + 1))
        if lo is not None:
            at, stop = np.clip(at, lo, hi), np.clip(stop, lo, hi)
        end = stop.copy()
        open_ = np.flatnonzero(end - at > 1)
        while len(open_):  # halve what is left of each bucket
            middle = (at[open_] + end[open_]) >> 1
            less = unpack_bits(self.low, self.low_bits, middle - 1) < low[open_]
            at[open_] = np.where(less, middle, at[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[end[open_] - at[open_] > 1]
        some = np.flatnonzero(at < end)  # one element is left
        found = unpack_bits(self.low, self.low_bits, at[some])
        at[some] += found < low[some]
        hit = np.zeros(len(values), bool)
        hit[some] = found == low[some]
        return np.where(hit, at, -1 - at)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        return ((self.ones[i] - i) << self.low_bits) | unpack_bits(self.low, self.low_bits, i).astype(np.int64)

    def parts(self) -> tuple[dict[str, np.ndarray], list[int]]:
        return {k: getattr(self, k) for k in ("low", "high")}, [self.n, self.low_bits]


class Ranges:
    """Lists of strictly growing numbers behind monotone pointers."""

    def __init__(self, pointers: EliasFano, numbers: EliasFano):
        self.pointers, self.numbers = pointers, numbers

    @classmethod
    def build(cls, sizes: np.ndarray, numbers: np.ndarray) -> Ranges:
        ptr = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ptr[1:])
        some = np.flatnonzero(sizes)
        top = np.zeros(len(sizes), np.int64)  # what a list adds to the numbers of those behind it
        top[some] = numbers[ptr[some + 1] - 1] + 1
        base = np.cumsum(top) - top
        return cls(EliasFano.build(ptr, int(ptr[-1]) + 1), EliasFano.build(numbers + np.repeat(base, sizes), int(top.sum()) + 1))

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pointers.get(i), self.pointers.get(i + 1)

    def find(self, i: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The place of each number in list i among all lists' numbers; -1: it isn't there.  Quickest where equal i stand together."""
        new = np.flatnonzero(np.diff(i, prepend=-1))
        lo, hi = self.bounds(i[new])
        base = np.zeros(len(new), np.int64)
        some = np.flatnonzero(lo > 0)
        base[some] = self.numbers.get(lo[some] - 1) + 1
        lo, hi, base = (np.repeat(x, np.diff(np.append(new, len(i)))) for x in (lo, hi, base))
        return np.maximum(self.numbers.find(numbers + base, lo, hi), -1)


def to_bytes(levels: dict[str, EliasFano | Ranges], arrays: dict[str, np.ndarray], meta: dict) -> bytes:
    """All of them in one buffer, each array at a multiple of 64 bytes behind a JSON header."""
    arrays, sizes = dict(arrays), {}
    for name, level in levels.items():
        for k, e in ({"p": level.pointers, "n": level.numbers} if isinstance(level, Ranges) else {"": level}).items():
            parts, sizes[f"{name}.{k}"] = e.parts()
            arrays |= {f"{name}.{k}.{x}": a for x, a in parts.items()}
    at, where = 0, {}
    for name, a in arrays.items():
        where[name] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": where, "sizes": sizes, "meta": meta}).encode()
    head = len(head).to_bytes(8, "little") + head
    return b"".join([head, b"\0" * (-len(head) % 64), *(x for a in arrays.values() for x in (a.tobytes(), b"\0" * (-a.nbytes % 64)))])


def mapped(raw: bytes) -> mmap.mmap:
    """The buffer as mapped memory that no folder holds."""
    fd = os.memfd_create("levels")
    try:
        with os.fdopen(fd, "wb", closefd=False) as f:
            f.write(raw)
        return mmap.mmap(fd, 0, prot=mmap.PROT_READ)
    finally:
        os.close(fd)


def from_buffer(buffer) -> tuple[dict[str, EliasFano | Ranges], dict[str, np.ndarray], dict]:
    """What ``to_bytes`` was given, as views of the buffer."""
    raw = np.frombuffer(buffer, np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    start = -(-(8 + size) // 64) * 64
    arrays = {k: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in head["arrays"].items()}
    levels: dict = {}
    for key, (n, low_bits) in head["sizes"].items():
        name, part = key.rsplit(".", 1)
        e = EliasFano(n, low_bits, **{x: arrays.pop(f"{key}.{x}") for x in ("low", "high")})
        levels.setdefault(name, {})[part] = e
    return {k: v[""] if "" in v else Ranges(v["p"], v["n"]) for k, v in levels.items()}, arrays, head["meta"]
