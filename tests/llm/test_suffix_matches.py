"""Longest verbatim matches against trying every pair of places, and very repetitive texts."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from flowjob.llm import decontaminate as D


def every_pair(text: str, bench: list[tuple[str, str]], window: int) -> tuple[int, int, int]:
    words, hit, items, best = text.split(), set(), set(), 0
    for item, other in bench:
        there = other.split()
        size = min(window, len(there))
        for p in range(len(words) - size + 1 if size else 0):
            for q in range(len(there) - size + 1):
                if words[p : p + size] == there[q : q + size]:
                    n = size
                    while p + n < len(words) and q + n < len(there) and words[p + n] == there[q + n]:
                        n += 1
                    items.add(item)
                    hit.update(range(p, p + size))
                    best = max(best, n)
    return len(hit), len(items), best


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(40):
        letters = "abcd"[: rng.randint(1, 4)]
        made = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        window = rng.choice([1, 2, 3, 8])
        bench = [(str(k), made(rng.randint(0, 25))) for k in range(rng.randint(0, 5))]
        texts = [made(rng.randint(0, 40)) for _ in range(5)]
        blocks = [D.Block([i for i, _ in bench], [b for _, b in bench], window)] if rng.random() < 0.5 else [D.Block([i], [b], window) for i, b in bench]
        got = D._shard(pa.array(range(5)), pa.array(texts, pa.string()), blocks, True)
        want = [every_pair(t, bench, window) for t in texts]
        assert list(zip(*(got[c].to_pylist() for c in ("n_hit", "n_items", "longest_match")), strict=True)) == want
        for text, found, (_, _, best) in zip(texts, got["matches"].to_pylist(), want, strict=True):
            assert max((m["n_words"] for m in found), default=0) == best
            for m in found:
                there = dict(bench)[m["item_id"]].split()
                assert text.split()[m["doc_pos"] : m["doc_pos"] + m["n_words"]] == there[m["item_pos"] : m["item_pos"] + m["n_words"]]


def test_repetition_needs_no_pairs():
    tracemalloc.start()
    same = "w " * 20_000
    got = D._shard(pa.array([1]), pa.array([same]), [D.Block(["x"], [same], 8)], True)
    assert (got["n_hit"][0].as_py(), got["longest_match"][0].as_py(), len(got["matches"][0])) == (20_000, 20_000, 1)
    prompt = "answer the next question with one of these ten words "
    block = D.Block([str(i) for i in range(2000)], [f"{prompt}item{i}" for i in range(2000)], 8)
    got = D._shard(pa.array(range(500)), pa.array([f"so {prompt}now"] * 500), [block], False)
    assert set(got["n_items"].to_pylist()) == {2000} and set(got["longest_match"].to_pylist()) == {10}
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
