"""URL filter: rules first, then the ratio of two character language models.  DataFrame functions only.

Rules name a host and a path prefix; a rule fits its host and all subdomains of it,
and the longest one that fits decides.  For URLs that no rule decides, variable-
order Markov models of the characters of host and path, one of accepted and one of
rejected URLs (those that rules decide), are compared: each character's probability
is smoothed from order 3 down to order 0,

    p_k(x | context) = (count(context, x) + MU * p_(k-1)(x | shorter context)) / (count(context) + MU),

and the sum of the log ratios, divided by the length, is held against a threshold
between the means of accepted and rejected URLs, each weighted by the other's
deviation.  Ratios are rounded to millionths, so that sums don't depend on their
order.

Models are tables, joined, never gathered; URLs count once, however many rows they
have.  Defined results: a null url or one without ``://`` has an empty host and
path, no rule and the verdict `allow`; without accepted or without rejected URLs
all undecided ones are allowed; repeated rows and null ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowjob.llm.tables import written

ORDER = 4
MU = 2.0
ALPHABET = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The deciding rule as host and path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, *more: str) -> DataFrame:
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col("u"), F.lit("\x03"))
    each = F.transform(F.sequence(F.lit(1), F.length("u") + 1), lambda i: F.substr(F.col("padded"), i, F.lit(ORDER)))
    return urls.where("u <> ''").withColumn("padded", padded).select(*more, F.explode(each).alias("g"))


def ratios(urls: DataFrame) -> DataFrame:
    """urls: u (distinct), verdict.  g, lr: each n-gram of any URL with its log ratio in millionths."""
    zero = F.lit(0).cast("bigint")
    own = _grams(urls, "verdict").groupBy("g").agg(*(F.sum(F.when(F.col("verdict") == v, 1).otherwise(zero)).alias(c) for v, c in (("allow", "a4"), ("block", "r4"))))
    table = written(own, "url-grams")
    total = table.agg(F.sum("a4"), F.sum("r4")).first()
    p = {"a": F.lit(1.0 / ALPHABET), "r": F.lit(1.0 / ALPHABET)}
    out = table
    for k in range(1, ORDER + 1):
        gram, context = F.substr(F.col("g"), F.lit(ORDER - k + 1), F.lit(k)), F.substr(F.col("g"), F.lit(ORDER - k + 1), F.lit(k - 1))
        if k < ORDER:
            low = table.groupBy(gram.alias(f"g{k}")).agg(F.sum("a4").alias(f"a{k}"), F.sum("r4").alias(f"r{k}"))
            out = out.withColumn(f"g{k}", gram).join(low, f"g{k}")
        if k > 1:
            ctx = table.groupBy(context.alias(f"c{k}")).agg(F.sum("a4").alias(f"na{k}"), F.sum("r4").alias(f"nr{k}"))
            out = out.withColumn(f"c{k}", context).join(ctx, f"c{k}")
        for c, n in (("a", total[0]), ("r", total[1])):
            size = F.col(f"n{c}{k}") if k > 1 else F.lit(float(n or 0))
            p[c] = (F.col(f"{c}{k}") + F.lit(MU) * p[c]) / (size + F.lit(MU))
    return out.select("g", F.round((F.log(p["a"]) - F.log(p["r"])) * 1e6).cast("bigint").alias("lr"))


def judge(pages: DataFrame, *, url_col: str = "url", id_col: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the method's figure, null where a rule decides)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("decided"), F.concat("host", "path").alias("u"))
    urls = written(rows.groupBy("u").agg(F.min("decided").alias("verdict")), "urls")
    scored = _grams(urls, "u").join(ratios(urls), "g").groupBy("u").agg((F.sum("lr") / F.count("*") / 1e6).alias("score"))
    scored = written(scored.join(urls, "u"), "url-scores")
    seen = {r["verdict"]: r for r in scored.where("verdict is not null").groupBy("verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    limit = F.lit(None).cast("double")
    if len(seen) == 2:
        a, b = seen["allow"], seen["block"]
        w = a["s"] + b["s"]
        limit = F.lit(round((a["m"] * b["s"] + b["m"] * a["s"]) / w if w else (a["m"] + b["m"]) / 2, 9))
    judged = scored.where("verdict is null").select("u", "score", F.when(F.col("score") >= limit, "allow").when(F.col("score") < limit, "block").alias("judged"))
    return rows.join(judged, "u", "left").select("page_id", "host", "path", "rule", F.coalesce("decided", "judged", F.lit("allow")).alias("verdict"), "score")
