"""The queries over a whole small table, against plain Python and their SQL."""

import os

import brute
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def run(spark):
    import __spark_entry__ as entry

    held = {}

    def get(name):
        if name not in held:
            full = next(n for n in entry.queries() if n.startswith(name))
            held[name] = entry.queries()[full](spark, SF).toPandas()
        return held[name]

    return get


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").toPandas()


def picked(frame, *columns, by="doc_id"):
    return [tuple(r) for r in frame.sort_values(by)[list(columns)].values.tolist()]


def test_quality(run, docs):
    got = run("op1_")
    assert picked(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == [brute.quality(t) for t in docs.text]
    assert not (got.kept & got.base_failed).any()


def test_decontamination(run, docs, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = run("op2_")
    assert picked(got, "n_words", "n_hit", "n_items", "items_sha256") == list(brute.benchmark_hits(docs.text, items))
    assert (got.contaminated == (got.n_items >= 2)).all()


def test_toxicity(run, docs, spark):
    got = run("op3_").merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: brute.fold(i, 3) == 1)).all()
    known = got[~got.held_out]
    assert known[known.toxic == 1].score.mean() > known[known.toxic == 0].score.mean() + 0.3


def test_language_model(run, docs):
    got = run("op4_").sort_values("doc_id")
    want = list(brute.base_scores(list(zip(docs.doc_id, docs.text, strict=True))))
    assert picked(got, "held_out", "n_tokens", "n_known", "train_tokens") == [w[:4] for w in want]
    assert max(abs(a - w[4]) for a, w in zip(got.base_score, want, strict=True)) < 1e-6
    assert got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_near_duplicates(run, docs):
    want = brute.components(list(zip(docs.doc_id, docs.text, strict=True)))
    got = run("op5_")
    assert picked(got, "n_shingles", "component_id") == want
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_main_text(run, spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").toPandas()
    got = run("op6_").sort_values("page_id")
    assert got.n_chars.tolist() == [len(t) for t in got.text]
    for page, text in zip(pages.html, got.text, strict=True):
        article = page.split("<article>")[1].split("</article>")[0]
        words = [w for w in brute.re.sub("<[^>]*>", " ", article).split()]
        import html

        assert text.split() == [w for x in words for w in html.unescape(x).split()]


def test_urls(run, spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").toPandas()
    for got, url in zip(run("op7_").sort_values("page_id").itertuples(), pages.url, strict=True):
        host, path, rule, verdict = brute.url_rule(url)
        assert (got.host, got.path) == (host, path) and got.rule == rule or rule is None and got.rule is None
        assert got.verdict == verdict or verdict is None and got.verdict in ("allow", "block")


def test_personal_data(run, docs):
    got = run("op9_")
    assert picked(got, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == [brute.personal(t) for t in docs.text]


def test_line_dedup(run, docs):
    """What goes stood elsewhere; what stays stays in order; each removed chunk's first place is kept."""
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    got = run("op8_")
    assert sorted(got.doc_id) == sorted(texts)
    kept = "\n\x00\n".join(got.text)
    for r in got.itertuples():
        before, after = texts[r.doc_id].split("\n"), r.text.split("\n") if r.text else []
        rest = iter(before)
        assert all(any(x == y for y in rest) for x in after)
        assert r.n_lines == len(before) and (r.n_removed_lines == len(before) - len(after) or r.text == "")
        assert all(x in kept for x in before)


def check_packing(rows, texts, sources, capacity):
    bins, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        if r["bin"] is not None and r["bin"] == r["bin"]:
            bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for i, text in texts.items():
        own = sorted(pieces[i], key=lambda r: r["piece"])
        words = brute.WORD.findall(text or "")
        assert sum(r["n_words"] for r in own) == len(words)
        if "text" in own[0]:
            assert "".join(r["text"] for r in own) == (text or "")
    for held in bins.values():
        assert sum(r["n_words"] for r in held) <= capacity
        if len(held) > 1:
            names = [sources[r["doc_id"]] for r in held if sources[r["doc_id"]] is not None]
            assert len(names) == len(set(names))
            words = [" ".join(brute.WORD.findall(texts[r["doc_id"]])).translate(brute.LOWER) for r in held]
            assert len(words) == len(set(words))


def test_packing(run, docs):
    texts, sources = dict(zip(docs.doc_id, docs.text, strict=True)), dict(zip(docs.doc_id, docs.source, strict=True))
    check_packing(run("op10_").astype(object).to_dict("records"), texts, sources, 2048)


def test_pipeline_stages(spark, docs):
    """Each stage against plain Python on what the one before it kept."""
    import corpus_pipeline as cp

    from flowjob.llm import quality

    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    verdict = {r["doc_id"]: r["kept"] for r in quality.measure(now).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        out = stage(spark, now, SF)
        rows = [r.asDict() for r in out.collect()]
        if name == "best_fit_packing":
            check_packing(rows, {i: r["text"] for i, r in before.items()}, {i: r["source"] for i, r in before.items()}, 2048)
            break
        assert out.columns == columns
        after = {r["doc_id"]: r for r in rows}
        if name == "quality_rules":
            assert set(after) == {i for i, ok in verdict.items() if ok}
        elif name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "near_dedup":
            ids = sorted(before)
            found = brute.components([(i, before[i]["text"]) for i in ids], size=5)
            assert set(after) == {i for i, (n, c) in zip(ids, found, strict=True) if i == c or not n}
        else:
            ids = sorted(before)
            hits = brute.benchmark_hits([before[i]["text"] for i in ids], [(i, t) for i, t in items if len(brute.ALNUM.findall(t)) >= 8])
            assert set(after) == {i for i, h in zip(ids, hits, strict=True) if not h[2]}
        now = spark.createDataFrame(rows, now.schema)


def test_sql(run, spark):
    import duckdb

    from flowjob.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    for name, sql in ORACLE_SQL.items():
        got, want = run(name), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = sorted(got.columns)
        rows = [sorted(([plain(v) for v in r] for r in x[key].astype(object).values.tolist()), key=str) for x in (got, want)]
        assert rows[0] == rows[1], name
