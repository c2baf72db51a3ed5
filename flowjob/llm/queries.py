"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowjob.llm.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import quality

    return quality.measure(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import decontaminate

    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"), "longest_match")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import toxicity

    def fold():
        return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold() != 1)
    found = toxicity.score(docs, toxicity.train(docs, labels), "score")
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import lm

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, lm.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import nearmin

    return nearmin.label(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


def op7_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import pii

    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import linechunks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linechunks.dedup(docs, report="r").select("doc_id", "r.*", "text")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowjob.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_benchmark_decontamination, op3_toxicity, op4_lm_scoring, op5_minhash_near_dedup, op6_html_extraction, op7_url_language_model, op8_line_dedup, op9_personal_data, op10_best_fit_packing)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"

_DECONTAMINATION = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS k, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iz AS (SELECT item, k, w, least(len(w), 8) AS s FROM iw WHERE len(w) > 0),
win AS (SELECT item, k, s, j, array_to_string(w[j : j + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS j FROM iz)),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
dg AS (SELECT r, s, i, array_to_string(w[i : i + s - 1], ' ') AS g FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM dw, (SELECT DISTINCT s FROM win) WHERE len(w) >= s)),
hits AS (SELECT r, i, j, s, k, item FROM dg JOIN win USING (s, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + s)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
runs AS (SELECT r, count(*) + min(s) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, k, i - j ORDER BY i) AS island FROM hits) GROUP BY r, k, i - j, island),
longest AS (SELECT r, max(n) AS n FROM runs GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(found.n, 0) >= 2 AS contaminated, coalesce(longest.n, 0) AS longest_match
FROM dw LEFT JOIN hit USING (r) LEFT JOIN found USING (r) LEFT JOIN longest USING (r)"""

_NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS g FROM d),
c AS (SELECT row_number() OVER () AS c, g, len(g) AS n, min(doc_id) AS m FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT c, n, unnest(g) AS t FROM c),
e AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT c, c AS k FROM c UNION SELECT reach.c, link.b FROM reach JOIN link ON reach.k = link.a),
best AS (SELECT reach.c, min(c.m) AS least FROM reach JOIN c ON reach.k = c.c GROUP BY reach.c),
named AS (SELECT c.g, best.least FROM c JOIN best USING (c))
SELECT doc_id, len(s.g) AS n_shingles, CASE WHEN len(s.g) = 0 THEN doc_id ELSE least END AS component_id, doc_id IS NOT DISTINCT FROM (CASE WHEN len(s.g) = 0 THEN doc_id ELSE least END) AS kept
FROM s LEFT JOIN named ON s.g = named.g"""


def _url_sql() -> str:
    from flowjob.llm import urls

    rules = sorted(urls.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {w} THEN '{v}'" for w, _, v in fits) + " END"
    n, mu = urls.ORDER, urls.MU
    cols, p = "", {c: f"(1.0::DOUBLE / {urls.ALPHABET})" for c in "ar"}
    for k in range(1, n + 1):
        gram, ctx = f"substr(g, {n - k + 1}, {k})", f"substr(g, {n - k + 1}, {k - 1})"
        cols += f", sum(a4) OVER (PARTITION BY {gram}) AS a_{k}, sum(r4) OVER (PARTITION BY {gram}) AS r_{k}, sum(a4) OVER (PARTITION BY {ctx}) AS na_{k}, sum(r4) OVER (PARTITION BY {ctx}) AS nr_{k}"
        p = {c: f"(({c}_{k} + {mu}::DOUBLE * {p[c]}) / (n{c}_{k} + {mu}::DOUBLE))" for c in "ar"}
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
h AS (SELECT page_id, {_LOWER.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, {rule} AS rule, {verdict} AS decided, host || path AS u FROM h),
urls AS (SELECT u, min(decided) AS verdict FROM d GROUP BY u),
grams AS (SELECT u, verdict, substr(repeat(chr(2), {n - 1}) || u || chr(3), i, {n}) AS g FROM (SELECT *, unnest(range(1, length(u) + 2)) AS i FROM urls WHERE u <> '')),
counts AS (SELECT g, count(*) FILTER (verdict = 'allow') AS a4, count(*) FILTER (verdict = 'block') AS r4 FROM grams GROUP BY g),
wide AS (SELECT g{cols} FROM counts),
lrs AS (SELECT g, CAST(round((ln({p['a']}) - ln({p['r']})) * 1e6) AS BIGINT) AS lr FROM wide),
scored AS (SELECT u, verdict, CAST(sum(lr) AS DOUBLE) / count(*) / 1e6 AS score FROM grams JOIN lrs USING (g) GROUP BY u, verdict),
m AS (SELECT avg(score) FILTER (verdict = 'allow') AS ma, avg(score) FILTER (verdict = 'block') AS mr, stddev_pop(score) FILTER (verdict = 'allow') AS sa, stddev_pop(score) FILTER (verdict = 'block') AS sr FROM scored),
t AS (SELECT round(CASE WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr) ELSE (ma + mr) / 2 END, 9) AS least FROM m),
j AS (SELECT u, score, CASE WHEN score >= least THEN 'allow' WHEN score < least THEN 'block' END AS judged FROM scored, t WHERE verdict IS NULL)
SELECT page_id, host, path, rule, coalesce(decided, judged, 'allow') AS verdict, score FROM d LEFT JOIN j USING (u)"""


#: Language models, trained weights, packing order, content-defined chunks and extracted text have no SQL; nor have the
#: spans of personal data, whose patterns look behind.  tests/llm compare these with plain Python.
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": _DECONTAMINATION,
    "op5_minhash_near_dedup": _NEAR_DEDUP,
    "op7_url_language_model": _url_sql(),
}
