"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import re

import brute
import pytest

EXTRA = "key n m node cls tkey label quality chunk_key chunks_gone text_key has_words bin shard piece text_ score u g rare row".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards mix jugs of old liquid and thirty quiet owls watch from the tower"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", PROSE, PROSE, PROSE.upper(), PROSE + " tonight", LONG, LONG + " end", "a b\nc d\n" * 20, "\n\n\n", "é" * 50 + " ü", "x" * 200_000, "mail a@b.co +1 (202) 555-0123 4111 1111 1111 1111 1.2.3.4 1.2.3.256"]


def rows():
    out = [(i, t, "en", f"s{i % 2}", len(t or ""), *["x"] * len(EXTRA)) for i, t in enumerate(TEXTS)]
    out += [out[4], out[0], out[8]]
    out += [(None, PROSE, None, None, None, *[None] * len(EXTRA)), (None, None, None, None, None, *[None] * len(EXTRA)), (None, LONG, None, None, None, *[None] * len(EXTRA))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("7", "fox jumps over a lazy dog while seven wizards"), ("8", "watch from the"), ("9", None), (None, PROSE), ("10", ""), ("11", " ".join(LONG.split()[100:140]))], "item_id string, text string")


def key(r):
    return tuple((v is None, str(v)) for v in r)


def test_quality(docs, none):
    from flowjob.llm import quality

    got = quality.measure(docs).collect()
    want = [(r[0], *brute.quality(r[1])) for r in rows()]
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and all(not brute.quality(r["text"])[5] for r in kept.collect())
    assert quality.measure(none).count() == quality.keep(none).count() == 0


def test_decontamination(docs, none, items):
    from flowjob.llm import decontaminate

    texts = [r[1] for r in rows()]
    bench = [tuple(r) for r in items.collect()]
    want = [(r[0], *h) for r, h in zip(rows(), brute.benchmark_hits(texts, bench), strict=True)]
    got = decontaminate.find(docs, items, with_matches=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    best = next(m for r in got if r["doc_id"] == 8 for m in r["matches"] if m["item_id"] == "11")
    assert (best["item_pos"], best["doc_pos"], best["n_words"]) == (0, 100, 40)
    small = [decontaminate.Block([i], [t or ""], 8) for i, t in bench if i]
    import pyarrow as pa

    split = decontaminate._shard(pa.array([0] * len(texts)), pa.array(texts, pa.string()), small, False)
    assert sorted(zip(split["n_hit"].to_pylist(), split["n_items"].to_pylist())) == sorted(w[2:4] for w in want)
    left = decontaminate.remove(docs, items)
    assert left.columns == docs.columns and not any(t and ("fox jumps" in t or t.startswith("w0 ")) for t in (r["text"] for r in left.collect()))
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.remove(docs, items.where("false")).count() == docs.count()
    assert {r["n_hit"] for r in decontaminate.find(docs, items.where("false")).collect()} == {0}


def test_toxicity(spark, docs, none):
    from flowjob.llm import toxicity

    labels = spark.createDataFrame([(4, 1), (7, 1), (8, 0), (9, 0), (13, None), (None, 1), (99, 1), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, "p")
    assert got.columns == [*docs.columns, "p"] and got.where("p between 0 and 1").count() == docs.count()
    empty = toxicity.train(docs, labels.where("false"))
    assert {r["p"] for r in toxicity.score(docs, empty, "p").collect()} == {0.5}
    assert toxicity.score(none, model, "p").count() == 0 and len(toxicity.train(none, labels)[0]) == 0
    with pytest.raises(ValueError):
        toxicity.score(docs, model, "source")


def test_language_model(docs, none):
    from flowjob.llm import lm

    plain = [(r[0], r[1]) for r in rows()]
    tokens = [[*brute.WORD.findall((t or "").translate(brute.LOWER)), None] for _, t in plain]
    total = sum(map(len, tokens))
    for options in ({}, {"base_words": 3, "shard_tokens": 20_000}):  # all words broadcast or not, one shard or several
        got = lm.score(docs, lm.train(docs, **options)).collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got if r["doc_id"] is not None) == sorted((i, len(t), len(t)) for (i, _), t in zip(plain, tokens, strict=True) if i is not None)
        assert {r["train_tokens"] for r in got} == {total} and all(r["base_score"] < 0 and r["score"] < 0 for r in got)
    assert lm.score(none, lm.train(docs)).count() == 0
    nothing = lm.score(docs, lm.train(none)).collect()
    assert {r["n_known"] for r in nothing} == {0} and {r["train_tokens"] for r in nothing} == {0}


def test_language_model_against_a_plain_one(spark):
    """Every shard layout gives the probabilities of a model of dictionaries; all of a context add up to one."""
    import random

    import numpy as np

    from flowjob.llm import lm
    from flowjob.llm import textkit as K

    rng = random.Random(2)
    texts = [" ".join(rng.choice("aaaaabbbccdefghij") for _ in range(rng.randrange(30))) for _ in range(20)]
    other = [" ".join(rng.choice("aabcxyz j") for _ in range(20)) for _ in range(20)] + ["a" * 90 + " b a", ""]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(texts + other)), "doc_id bigint, text string")
    for base_words, shard_tokens in ((1000, 10**6), (4, 10**6), (1000, 60), (4, 37)):
        model = lm.train(train, base_words=base_words, shard_tokens=shard_tokens)
        v = model.words.value
        frequent = [w for w in "abcdefghij" if v.index.find(K.split_words(lm.pa.array([w])).hashes(True))[0] >= 0]
        plain = brute.PlainModel(texts, frequent, lm.DISCOUNT)
        got = {r["doc_id"]: r["score"] for r in lm.score(asked, model).collect()}
        for i, t in enumerate(texts + other):
            assert abs(got[i] - plain.score(t)) < 1e-4, (base_words, shard_tokens, i)  # few enough different values for exact codes
        tries = {r["shard"]: lm.Trie(bytes(r["keys"])) for r in model.keep_tries().rows.collect()}
        assert {r["doc_id"]: round(r["score"], 3) for r in lm.score(asked, model).collect()} == {i: round(x, 3) for i, x in got.items()}
        assert len(tries) > (shard_tokens < 100)
        code = {w: int(v.codes(K.split_words(lm.pa.array([w])).hashes(True))[1][0]) for w in "abcdefghijx"}
        known = [lm.END, *(code[w] for w in "abcdefghij")]
        for a, b in ((lm.PAD, lm.BEGIN), (lm.BEGIN, code["a"]), (code["a"], code["b"]), (code["j"], code["d"]), (code["x"], code["a"]), (code["a"], code["x"])):
            ends = np.array([*known, code["x"]])
            shard = int(v.shard_of(np.array([a]), np.array([b]))[0])
            full = (np.full(len(ends), a), np.full(len(ends), b), ends)
            logs = tries[shard].score(*full, v) if shard in tries else np.log10(v.probability(ends))
            assert abs((10**logs).sum() - 1) < 1e-6


def test_codebook():
    import numpy as np

    from flowjob.llm import lm

    rng = np.random.default_rng(4)
    for values in (np.zeros(0), rng.integers(0, 200, 5000) / 7, np.append(rng.normal(size=20_000), np.full(10_000, -1.0))):
        codes, book = lm.codebook(values)
        assert codes.dtype == np.uint8 and len(book) == 256
        error = np.abs(book[codes] - values)
        assert not len(values) or (error.max() < 1e-12 if len(np.unique(values)) < 257 else np.median(error) < 0.005)


def test_near_duplicates(docs, none):
    from flowjob.llm import nearmin

    got = nearmin.label(docs).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows())
    assert [by[i]["component_id"] for i in range(len(TEXTS))] == [0, 1, 2, 3, 4, 4, 4, 4, 8, 8, 10, 11, 12, 13, 14]
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None and r["n_shingles"]) == [4, 8]
    left = nearmin.keep(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [0, 0, 1, 2, 3, 4, 8, 10, 11, 12, 13, 14]
    assert nearmin.label(none).count() == nearmin.keep(none).count() == 0


def test_near_duplicates_in_large_nodes(spark):
    """Small limits, so that nodes branch, pivots are used and blocks are compared; against all pairs."""
    import random

    from flowjob.llm import nearmin

    rng = random.Random(5)
    words = [f"v{i}" for i in range(40)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    texts = []
    for _ in range(260):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    plain = list(enumerate(texts))
    docs = spark.createDataFrame(plain, "doc_id bigint, text string")
    want = brute.components(plain)
    for options in ({"limit": 4, "block": 16}, {"limit": 4, "depth": 2, "block": 16}):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nearmin.label(docs, **options).collect())
        assert [g[1:] for g in got] == want


def test_branching(spark, monkeypatch):
    """At the default parameters nodes of more than 32 classes branch, level by level, and no link is lost."""
    import random

    from flowjob.llm import nearmin

    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    texts = []
    for i in range(150):
        t = [w for k in range(30) for w in (rng.choice(common), f"u{i}-{k}" if k % 3 else rng.choice(common))]
        texts += [" ".join(t), " ".join([*t[:50], "changed", *t[51:]])]
    levels = []
    real = nearmin._children
    monkeypatch.setattr(nearmin, "_children", lambda *a: levels.append(1) or real(*a))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nearmin.label(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert [g[1:] for g in got] == brute.components(list(enumerate(texts)))
    assert len(levels) >= 2 and nearmin.trees_for(0.999999) <= nearmin.TREES


def test_a_large_group_of_near_copies_is_settled_before_the_trees(spark, monkeypatch):
    """Its classes make few rows of nodes and few candidates, and links of classes around it with each other and with it are all found."""
    import random

    from flowjob.llm import nearmin

    rng = random.Random(11)
    base, texts = [f"b{i}" for i in range(200)], []

    def changed(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = f"x{rng.randrange(10**6)}"
        return words

    texts = [changed(base, rng.randrange(1, 12)) for _ in range(300)]
    texts += [t for _ in range(20) for far in [changed(base, rng.randrange(12, 60))] for t in (far, changed(far, 4))]
    texts += [changed([f"u{i}-{k}" for k in range(80)], 3) for i in range(40)]
    plain = list(enumerate(map(" ".join, texts)))
    made: dict[str, int] = {}
    real = nearmin.written

    def written(df, name="table"):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(nearmin, "written", written)
    docs = spark.createDataFrame(plain, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nearmin.label(docs).collect())
    assert [g[1:] for g in got] == brute.components(plain)
    assert made["nodes"] < 10 * len(plain) and made["candidates"] < 3 * len(plain), made
    assert not made["dear"]
    dear = nearmin.label(docs, block=1)  # blocks so small that the trees take the group
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in dear.collect()) == got and made["dear"] == 1


def test_a_large_group_hidden_among_unrelated_texts_is_settled(spark, monkeypatch):
    """Near copies that share two tokens with far more texts that are no copies."""
    import random

    import pyarrow as pa

    from flowjob.llm import nearmin

    rng = random.Random(12)
    alone = pa.array([f"q{i} q{i}" for i in range(20_000)])  # one shingle each
    least = [[((s ^ nearmin._XOR[k]) * nearmin._MULTIPLY[k])[0] for k in range(2)] for s in nearmin.shingle_sets(alone, 2)]
    common = [alone[min(range(len(least)), key=lambda i: least[i][k])].as_py() for k in range(2)]  # the two tokens of nearly all texts with them
    base, texts = [f"b{i}" for i in range(200)], []
    for _ in range(160):
        t = list(base)
        for k in rng.sample(range(200), rng.randrange(1, 12)):
            t[k] = f"x{rng.randrange(10**6)}"
        texts.append([*common, *t])
    texts += [[*common, *(f"u{i}-{k}" for k in range(12))] for i in range(6000)]
    plain = list(enumerate(map(" ".join, texts)))
    made: dict[str, int] = {}
    real = nearmin.written

    def written(df, name="table"):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(nearmin, "written", written)
    docs = spark.createDataFrame(plain, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nearmin.label(docs).collect())
    assert [g[1:] for g in got[:160]] == brute.components(plain[:160]) and all(g[0] == g[2] for g in got[160:])
    assert made.get("settled", 0) >= 150, made


def test_nodes_that_a_task_can_hold_branch_there(spark, monkeypatch):
    """Their further levels make no rows of tables, and texts are shuffled for none but candidates, a few times in all."""
    import random

    from flowjob.llm import nearmin

    rng = random.Random(13)
    common = [f"c{i}" for i in range(8)]
    texts = []
    for i in range(120):
        t = [w for k in range(20) for w in (rng.choice(common), f"u{i}-{k}" if k % 3 else rng.choice(common))]
        texts += [" ".join(t), " ".join([*t[:30], "changed", *t[31:]])] if i % 2 else [" ".join(t)]
    plain = list(enumerate(texts))
    made: dict[str, list[int]] = {}
    real = nearmin.written

    def written(df, name="table"):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(nearmin, "written", written)
    docs = spark.createDataFrame(plain, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nearmin.label(docs, limit=8).collect())
    assert [g[1:] for g in got] == brute.components(plain)
    assert "children" not in made and sum(made["branched"]) and len(made["texts"]) <= 4, made
    some, reps = docs.selectExpr("doc_id", "xxhash64(text) AS tkey"), docs.where("doc_id % 9 = 0").selectExpr("xxhash64(text) AS k")
    left = {r["doc_id"] for r in nearmin._marked(some, reps).collect()}
    assert left >= {i for i, _ in plain if i % 9 == 0} and len(left) < 30


def test_line_dedup(docs, none, spark):
    from flowjob.llm import linechunks

    got = linechunks.dedup(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert linechunks.dedup(none).count() == 0
    block = "\n".join(f"line number {i} of a shared passage" for i in range(40))
    own = [f"own {k} " + PROSE for k in range(6)]
    plain = [(k, f"{own[k]}\n{block}\n{own[k]} again") for k in range(6)]
    frame = spark.createDataFrame(plain, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in linechunks.dedup(frame, report="r").collect()}
    assert out[0]["text"] == plain[0][1]
    for k in range(1, 6):
        assert out[k]["r"]["n_removed_lines"] >= 25 and own[k] in out[k]["text"] and own[k] + " again" in out[k]["text"]
    with pytest.raises(ValueError):
        linechunks.dedup(docs, report="key")


def test_line_dedup_hot_chunks(spark):
    """A chunk that most documents have is salted, and one copy stays all the same."""
    from flowjob.llm import linechunks

    block = "\n".join(f"notice {i}" for i in range(24))
    frame = spark.createDataFrame([(i, f"first {i}\n{block}\nlast {i}") for i in range(1500)], "doc_id bigint, text string")
    text = "\n".join(r["text"] for r in linechunks.dedup(frame).collect()).split("\n")
    count = {i: text.count(f"notice {i}") for i in range(24)}
    assert min(count.values()) == 1 and all(f"first {i}" in set(text) for i in (0, 7, 1499))


def test_line_dedup_of_repeated_rows(spark):
    """Rows that repeat id and text, null ids too, keep their text; a later document with it loses it; salted chunks as well."""
    from flowjob.llm import linechunks

    block = "\n".join(f"line number {i} of a text that stands twice" for i in range(30))
    for ids in ([1, 1, 2], [None, None, 2]):
        got = linechunks.dedup(spark.createDataFrame([(i, block) for i in ids], "doc_id bigint, text string")).collect()
        assert [r["text"] for r in got if r["doc_id"] != 2] == [block, block]
        assert len(next(r["text"] for r in got if r["doc_id"] == 2)) < len(block) // 2
    many = spark.createDataFrame([(i // 2, block) for i in range(2400)], "doc_id bigint, text string")
    assert [r["text"] for r in linechunks.dedup(many).where("doc_id = 0").collect()] == [block, block]


def test_line_dedup_of_short_passages(spark):
    """Passages of any number of lines, between lines of their own, with blank lines or without, go from end to end."""
    import random

    from flowjob.llm import linechunks

    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    for gap in ("\n", "\n\n", "\n \n\n"):
        passages = [[line(n) for n in sizes] for sizes in ([60], [10], [30, 30], [40, 2], [2, 40], [3, 2, 40, 1, 3], [3] * 5, [9] * 6, [3, 1, 4] * 4, [20] * 5, [5] * 20) for _ in range(5)]
        plain = [(k, gap.join([line(12), line(3), *p, line(3), line(12)])) for k, p in enumerate(passages * 2)]
        out = {r["doc_id"]: r["text"] for r in linechunks.dedup(spark.createDataFrame(plain, "doc_id bigint, text string")).collect()}
        for k, p in enumerate(passages):
            own = plain[k + len(passages)][1].split(gap)
            assert out[k] == plain[k][1] and out[k + len(passages)] == gap.join([*own[:2], *own[-2:]])
    plain = [(1, "\n" + PROSE + "\n\n" + PROSE + "\n"), (2, PROSE + "\n"), (3, "one\ntwo"), (4, "one"), (5, "\r\none\n\n\ntwo"), (6, "\n\n")]
    got = linechunks.dedup(spark.createDataFrame(plain, "doc_id bigint, text string"), report="r").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["\n" + PROSE + "\n", "", "one\ntwo", "one", "", "\n\n"]
    assert [tuple(r["r"]) for r in got] == [(5, 2, 1, 2), (2, 1, 1, 2), (2, 1, 0, 0), (1, 0, 0, 0), (5, 1, 1, 5), (3, 0, 0, 0)]


def test_line_dedup_against_a_plain_one(spark):
    """Chunks by the same rule in plain Python, their bytes compared in one dictionary."""
    import random

    from flowjob.llm import linechunks

    rng = random.Random(12)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 14]))) for _ in range(60)]
    plain = []
    for i in range(150):
        text = [rng.choice(lines) if rng.random() < 0.5 else f"{i} {rng.random()} " + rng.choice(lines) for _ in range(rng.randrange(14))]
        at = rng.randrange(50)
        plain.append((i, "\n".join(text[:5] + lines[at : at + rng.randrange(9)] + text[5:])))
    got = {r["doc_id"]: r["text"] for r in linechunks.dedup(spark.createDataFrame(plain, "doc_id bigint, text string")).collect()}
    assert got == brute.line_dedup(plain)
    assert sum(len(t) for _, t in plain) > sum(map(len, got.values()))


def test_personal_data(docs, none):
    from flowjob.llm import pii

    got = pii.digest(pii.spans(docs)).collect()
    want = [(r[0], *brute.personal(r[1])) for r in rows()]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert pii.spans(none).count() == 0


def test_personal_data_oddities(spark):
    from flowjob.llm import pii

    texts = ["a@b.c_d@x.y..@z.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.99999999999", "4111-1111-1111-1111-1 4111111111111111", "+12 34 () 5678901 +1+2+345678901", "ü a@b.c \U0001f600 +49 30 1234567", "a@" + "b." * 20_000 + "c", "1 " * 50_000, "a" * 100_000 + "@", "IBAN: DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "call 202-555-0123", "202-555-0123", "SSN 123-45-6789"]
    got = pii.digest(pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [brute.personal(t) for t in texts]
    assert [r["spans"] for r in got[8:]] == ["iban:6:33", "tel:5:17", "", "ssn:4:15"]


def test_account_numbers_and_context_on_both_sides(spark):
    from flowjob.llm import pii

    de, gb, free = "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "ZZ33 1234 5678 9012 345"
    cases = {
        f"IBAN {de} Bitte zahlen": [de],
        f"IBAN {de.replace(' ', '')} BIC COBADEFFXXX": [de.replace(" ", "")],
        f"{de} {gb} NO9386011117947 A": [de, gb, "NO9386011117947"],
        f"{free} UND DANN {de} A1": [free, de],
        "AB12 CDEF GHIJ KLMN " + de: [de],
        f"{de}X {de[:-1]}1 DE89 3704": [],
        "123-45-6789 is the SSN": ["123-45-6789"],
        "202-555-0123 (mobile)": ["202-555-0123"],
        "202-555-0123" + " " * 39 + "tel": ["202-555-0123"],
        "202-555-0123" + " " * 40 + "tel": [],
        "202-555-0123" + " " * 36 + "telegram": [],
    }
    got = pii.digest(pii.spans(spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string"))).orderBy("doc_id").collect()
    for r, (text, want) in zip(got, cases.items(), strict=True):
        places = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith(("iban", "ssn", "tel"))]
        assert [text[a:b] for a, b in places] == want, text


def test_html():
    from flowjob.llm.html import main_text

    cases = {
        None: "",
        "": "",
        "plain  text\n here": "plain text here",
        "<body><nav><a href=x>m</a></nav><article><h1>T</h1><p>A &amp; b<br>c<p>D</article><footer>f</footer>": "T\nA & b c\nD",
        f"<div class='post'><p>{PROSE}.</p><p>And another.</p></div><div class=sidebar>x y</div><div id=comments><p>first!</p></div>": f"{PROSE}.\nAnd another.",
        f"<article><p>{PROSE}</p><div class='ad'>buy</div><form><input><button>go</button></form><aside>s</aside><p>b</p><script>var x='</p>'</script><ul><li>{PROSE}<li>j</ul></article>": f"{PROSE}\nb\n{PROSE}\nj",
        "<p>unclosed <b>bold": "unclosed bold",
        "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>": "deep",
        "<article><p>" + "word " * 100_000 + "</p></article>": ("word " * 100_000).strip(),
    }
    for page, text in cases.items():
        assert main_text(page) == text, page and page[:80]


def page(main, around="<div>{}</div>"):
    links = "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(8))
    return f"<html><head><title>t</title></head><body><div><ul>{links}</ul></div><div>Buy one, get one free.</div>{around.format(main)}<div><ul>{links}</ul></div><div>Imprint and contact.</div></body></html>"


def test_html_by_density(monkeypatch):
    """No article or nav elements, wrappers whose names mislead, short paragraphs, titles in wrappers: density decides, and only density."""
    from flowjob.llm import html

    body = f"<h1>A title</h1><p>{PROSE}. {PROSE}.</p><p>Short.</p><p>{PROSE}, {PROSE}.</p>"
    text = f"A title\n{PROSE}. {PROSE}.\nShort.\n{PROSE}, {PROSE}."
    for around in ("<div>{}</div>", "<article>{}</article>", "<div id='page' class='has-sidebar'><div class='content-with-sidebar'>{}</div></div>", "<section class='social-science'>{}</section>", "<main><div class='ad'>{}</div></main>"):
        assert html.main_text(page(body, around)) == text, around
    titled = body.replace("<h1>A title</h1>", "<div class='entry-header'><h1>A title</h1></div>")
    assert html.main_text(page(titled)) == text
    parts = f"<section><h2>One</h2><p>{PROSE}.</p><p>{PROSE}!</p></section><section><h2>Two</h2><p>{PROSE}?</p></section>"
    assert html.main_text(page(parts)) == f"One\n{PROSE}.\n{PROSE}!\nTwo\n{PROSE}?"
    inner = body.replace("<p>Short.</p>", "<div><a href=x>share</a> <a href=y>mail</a></div><p>Short.</p><div>Advert</div>")
    assert html.main_text(page(inner)) == text
    lines = f"<div>{PROSE}.</div><div>Short.</div><div>{PROSE}!</div>"
    assert html.main_text(page(lines)) == f"{PROSE}.\nShort.\n{PROSE}!"
    for without in (lambda *a: 0.0, lambda *a: 1.0):
        monkeypatch.setattr(html, "density", without)
        assert "Buy one" in html.main_text(page(body)) or html.main_text(page(body)) != text


def test_html_tables(spark):
    from flowjob.llm import html

    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (None, None, None, None), (1, "u", "<p>a</p>", "x")], "page_id bigint, url string, html string, text string")
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(pages).collect()), key=key) == [(1, "a", 1), (1, "a", 1), (None, "", 0)]
    assert html.extract(pages.where("false")).count() == 0


def test_urls(spark):
    from flowjob.llm import urls

    given = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/7?q#f", "http://example.com/en/71", "http://notexample.com/en/7", "x://net/de/", "x://a.net/de/8", "x://example.net/de/80", "x://b.example.net#y", "ftp://h", "a://b://c/d", "x://org/es", "x://q.org/es/"] * 2
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given)], "page_id bigint, url string, host string")
    got = urls.judge(pages).orderBy("page_id").collect()
    for r, u in zip(got, given, strict=True):
        host, path, rule, verdict = brute.url_rule(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if verdict else ["allow", "block"])
    assert got[0]["verdict"] == "allow" and urls.judge(pages.where("false")).count() == 0
    only = pages.where("page_id = 10")
    assert [r["verdict"] for r in urls.judge(only).collect()] == ["allow"]


def test_packing(docs, none, spark):
    from flowjob.llm import packing

    got = packing.pack(docs, with_text=True).collect()
    assert sum(r["n_words"] for r in got) == sum(len(brute.WORD.findall(t[1] or "")) for t in rows())
    assert all((r["bin"] is None) == (r["n_words"] == 0) for r in got)
    long = sorted((r for r in got if r["doc_id"] == 9), key=lambda r: r["piece"])
    assert "".join(r["text"] for r in long) == LONG + " end"
    assert packing.pack(none).count() == 0


def test_best_fit_is_the_tightest_compatible_bin():
    """The successor search against a scan of all bins."""
    import random

    from flowjob.llm.packing import pack_shard

    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(1, 120)
        lengths, sources, clusters = [rng.randrange(1, 101) for _ in range(n)], [rng.choice("aabcd") for _ in range(n)], [rng.randrange(8) for _ in range(n)]
        got, bins = pack_shard(lengths, sources, clusters, 100), []
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= lengths[i] and sources[i] not in b[1] and clusters[i] not in b[2]]
            if fits:
                k = min(fits)[1]
            else:
                bins.append([100, set(), set()])
                k = len(bins) - 1
            bins[k][0] -= lengths[i]
            bins[k][1].add(sources[i])
            bins[k][2].add(clusters[i])
            assert got[i] == k


def test_elias_fano():
    import numpy as np

    from flowjob.llm.eliasfano import EliasFano

    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 1000), (1000, 1001), (20_000, 10**10), (5, 2**62)):
        v = np.unique(np.concatenate([rng.integers(0, universe, n), universe // 2 + rng.integers(0, max(universe // 2, 1), n // 4) % 5000])) if n else np.zeros(0, np.int64)
        v = v[v < universe]
        e = EliasFano.build(v, universe)
        q = np.concatenate([v, rng.integers(0, universe, 500), [universe, universe + 5]])
        at = np.searchsorted(v, q)
        assert (e.find(q) == np.where(np.isin(q, v), at, -1 - at)).all() and (not len(v) or (e.get(np.arange(len(v))) == v).all())


def test_lists_behind_monotone_pointers():
    import numpy as np

    from flowjob.llm.eliasfano import Ranges, from_buffer, mapped, to_bytes

    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 6, 2000)
    lists = [np.sort(rng.choice(50, n, False)) for n in sizes]
    levels, arrays, meta = from_buffer(mapped(to_bytes({"r": Ranges.build(sizes, np.concatenate(lists))}, {"x": np.arange(3)}, {"a": 1})))
    begin = np.append(0, np.cumsum(sizes))
    i, q = rng.integers(0, 2000, 5000), rng.integers(0, 60, 5000)
    want = [next((begin[a] + k for k, y in enumerate(lists[a].tolist()) if y == b), -1) for a, b in zip(i.tolist(), q.tolist(), strict=True)]
    assert levels["r"].find(i, q).tolist() == want and arrays["x"].tolist() == [0, 1, 2] and meta == {"a": 1}


def test_hashes_of_arranged_words():
    """Words whose polynomials agree modulo 2**64 hash apart; numbers settle hashes by bytes."""
    import numpy as np
    import pyarrow as pa

    from flowjob.llm import quality
    from flowjob.llm import textkit as K

    a, swap = "a", str.maketrans("ab", "ba")
    for n in range(12):
        a += a.translate(swap)
        if n >= 8:
            words = K.split_words(pa.array([f"{a} {a.translate(swap)}"]))
            assert len(set(words.hashes().tolist())) == 2
            assert quality.duplicate_lines(K.split_words(pa.array([f"{a}\n{a.translate(swap)}\n{a}"]))).tolist() == [1]
    words = K.split_words(pa.array(["b a b ccccccccc a ccccccccd ccccccccc"]))
    assert K.numbers(words.data, words.starts, words.ends).tolist() == [0, 1, 0, 3, 1, 5, 3]
    right = K.span_hashes
    try:
        K.span_hashes = lambda data, starts, ends, lower=False: np.zeros(len(starts), np.uint64)
        assert K.numbers(words.data, words.starts, words.ends).tolist() == [0, 1, 0, 3, 1, 5, 3]
    finally:
        K.span_hashes = right


def test_kneser_ney_against_a_plain_one():
    import numpy as np
    import pyarrow as pa

    from flowjob.llm import quality as Q
    from flowjob.llm import textkit as K

    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("aaabbcd e.é1"), 200)) for _ in range(12)] + ["A  b\n\tc", "", "ö"]
    grams, ptr = Q.stream(*K.buffers(pa.array(texts)))
    want = [brute.symbol_grams(t) for t in texts]
    assert [grams[a:b].tolist() for a, b in zip(ptr, ptr[1:], strict=False)] == want
    uniq, n = np.unique(grams, return_counts=True)
    model = Q.KneserNey(uniq, n)
    plain = brute.kneser_ney(dict(zip(uniq.tolist(), n.tolist(), strict=True)))
    asked = np.concatenate([uniq, rng.integers(0, 1 << 20, 500).astype(np.uint32)])
    assert np.abs(10 ** model.score(asked) - [plain(int(g)) for g in asked]).max() < 1e-6
    for context in (uniq[::40] >> np.uint32(5)).tolist() + [777]:
        assert abs((10 ** model.score(np.arange(32, dtype=np.uint32) | np.uint32(context << 5))).sum() - 1) < 1e-5


def test_perplexity_bands(spark):
    """Outliers without symbols go on both sides, each in its language; other documents stay."""
    import random

    from flowjob.llm import quality

    rng = random.Random(9)
    some = {"en": "the and of house tree river light walk under stone paper green".split(), "de": "der und von haus baum fluss licht gehen unter stein papier".split()}

    def prose(lang):
        return " ".join(rng.choice(some[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randrange(400, 600)))

    plain = [(i, prose(lang), lang) for i, lang in enumerate(["en"] * 150 + ["de"] * 150)]
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz ") for _ in range(600)) for _ in range(5)]
    dull = [" ".join("tete" * rng.randrange(1, 9) for _ in range(90)) + " " + " ".join(f"et{'te' * k}" for k in range(40)) for _ in range(3)]
    plain += [(1000 + i, t, "en") for i, t in enumerate(noise)] + [(2000 + i, t, "de") for i, t in enumerate(dull)] + [(3000, prose("en"), "xx"), (3001, prose("de"), None)]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(plain, "doc_id int, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(300) if not got[i]["base_failed"])
    assert not any(got[1000 + i]["kept"] for i in range(5)) and not any(got[1000 + i]["base_failed"] or got[1000 + i]["n_symbols"] for i in range(5))
    low, high = min(got[i]["log10_per_char"] for i in range(300)), max(got[i]["log10_per_char"] for i in range(300))
    assert all(got[1000 + i]["log10_per_char"] < low for i in range(5))
    above = [got[2000 + i] for i in range(3) if not got[2000 + i]["base_failed"]]
    assert above and all(r["log10_per_char"] > high and not r["kept"] for r in above)
    assert got[3000]["kept"] and got[3001]["kept"]


def test_every_language_has_its_own_model(spark, monkeypatch):
    """However many languages there are: those of few documents are dealt by language, with the same results."""
    import random

    from flowjob.llm import quality

    rng = random.Random(10)
    some = {k: ["".join(rng.choice(f"{chr(97 + k)}{chr(98 + k)}{chr(99 + k)}aeou") for _ in range(rng.randrange(2, 9))) for _ in range(60)] for k in range(6)}
    plain = [(i, " ".join(rng.choice(some[i % 6]) for _ in range(rng.randrange(30, 200))), None if i % 6 == 5 else f"l{i % 6}", "x") for i in range(240)]
    plain += [(i, " ".join("".join(rng.choice("zqxjkvw ") for _ in range(9)) for _ in range(30)), f"l{i % 5}", None) for i in range(240, 250)]
    plain += [(300, "too short", "empty", "y"), (301, None, "empty", None), (302, None, None, None)]
    docs = spark.createDataFrame(plain, "doc_id int, text string, lang string, gram string")
    got = {}
    for most in (64, 6, 1):  # all languages are frequent, most, none
        monkeypatch.setattr(quality, "MOST_LANGUAGES", most)
        kept = quality.keep(docs)
        assert kept.columns == docs.columns
        got[most] = sorted(map(tuple, quality.measure(docs).collect())), sorted(r["doc_id"] for r in kept.collect())
        assert got[most][1] == [r[0] for r in got[most][0] if r[7]]
    monkeypatch.setattr(quality, "MOST_LANGUAGES", len(plain))
    assert quality.languages(docs)[1] is None
    want = sorted(map(tuple, quality.measure(docs).collect()))
    assert [g[0] == want for g in got.values()] == [True] * 3


def test_stages_of_the_pipeline_exchange_small_batches(spark, tmp_path):
    import pyarrow as pa
    from corpus_pipeline import STAGES
    from flowjob.llm.tables import BATCH_BYTES

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})

    spark.createDataFrame([("1", PROSE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in STAGES:
        session = spark.newSession()
        long = "repeat(concat('w', id, ' x '), if(id = 7, 2 * 1024 * 1024, 6000))"
        docs = session.range(0, 500, 1, 1).selectExpr("id doc_id", f"if(id = 9, null, {long}) text", "'en' lang", "'s' source", "0L n_chars")
        out = stage(session, docs, str(tmp_path))
        sizes = docs.mapInArrow(seen, "rows bigint, bytes bigint").collect()
        assert sum(r["rows"] for r in sizes) == 500, name
        assert all(r["rows"] == 1 or r["bytes"] < 3 * BATCH_BYTES for r in sizes), name
        if name == "decontamination":  # nothing is lost between batches, nor a row larger than they are
            assert out.selectExpr("count(*)", "sum(doc_id)", "max(length(text)) > 8388608").first()[:] == (500, 124750, True)


def test_a_worker_keeps_nothing_that_was_freed():
    import ctypes
    from pathlib import Path

    import numpy as np
    from flowjob.llm import textkit as K

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("the C library has no malloc_trim")
    held = []

    def run(batches):
        for batch in batches:
            arrays = [np.ones(4000) for _ in range(4000)]
            held.append(np.ones(4000))  # lies above them, so that they stay with the process
            del arrays
            yield batch

    size = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6
    before = size()
    assert list(run([1])) == [1]
    kept = size() - before
    assert list(K.releasing(run)([2])) == [2]
    assert kept > 100 and size() - before < 20


def test_components(spark):
    from flowjob.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    top = Path(__file__).resolve().parents[2] / "flowjob"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and re.search(r"flowjob\.llm|from \.+llm", p.read_text())]
