"""Scalar helpers as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Tokens between single spaces, empty ones dropped; tabs and breaks stay inside tokens."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def without(text: Column, patterns: Sequence[str]) -> Column:
    """Every match of any of the patterns becomes one space; blank patterns are skipped."""
    some = [p for p in patterns if p.strip()]
    return F.regexp_replace(text, "|".join(f"({p})" for p in some), " ") if some else text


def pair_text(key: Column, value: Column) -> Column:
    return F.concat(F.lit("["), key.cast("string"), F.lit(", "), value.cast("string"), F.lit("]"))


def list_text(items: Column) -> Column:
    return F.concat(F.lit("{ "), F.array_join(items.cast("array<string>"), ", "), F.lit(" }"))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def wrap32(value: Column) -> Column:
    """A bigint taken modulo 2**32 into the range of a signed 32-bit integer."""
    return F.pmod(value.cast("bigint") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)


def times(value: Column, factor: int, wrap: bool = False) -> Column:
    out = value.cast("bigint") * F.lit(factor)
    return wrap32(out) if wrap else out


def parse_int(text: Column) -> Column:
    """An integer; other text fails the job."""
    return text.cast("int")


def is_subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def key_of(line: Column, length: int = 10) -> Column:
    """The leading bytes of a record; binary values compare as unsigned bytes."""
    return F.substring(line.cast("binary"), 1, length)


def expand_range(text: str) -> list[str]:
    """node[1-3,7]x -> node1x, node2x, node3x, node7x; leading zeros keep their width."""
    m = re.match(r"([^\[]*)\[([^\]]*)\](.*)", text)
    if not m:
        return [text]
    out = []
    for part in m[2].split(","):
        a, _, b = part.partition("-")
        out += [f"{m[1]}{i:0{len(a)}d}{rest}" for i in range(int(a), int(b or a) + 1) for rest in expand_range(m[3])]
    return out


def sequence_hash(items: Column) -> Column:
    """A number that depends on a list's bigint items (absolute values below 2**40) and their order; 0 for an empty list."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: F.pmod(acc * 31 + x, F.lit(2**31 - 1)))


def shuffled(items: Column, seed: int) -> Column:
    """The list in an order drawn from the seed."""
    return F.shuffle(items, seed)


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes; a prefix comes first; null if either is."""
    x, y = a.cast("binary"), b.cast("binary")
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)
