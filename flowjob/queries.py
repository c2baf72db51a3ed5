"""Queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowjob.functions import scalars as S
from flowjob.operators import aggregate, joins, mining, ordering, sortbench, wordcount
from flowjob.plans.pipeline import Pipeline
from flowjob.session import scratch
from flowjob.sources import readers, sinks
from flowjob.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- words and lines

_WORDS = "SELECT unnest(string_split(text, ' ')) AS word FROM documents"


@query(f"SELECT word, count(*) AS cnt FROM ({_WORDS}) WHERE word <> '' GROUP BY word")
def word_count(spark, d):
    return wordcount.word_counts(t(spark, d, "documents"))


@query(ORACLE_SQL["word_count"])
def word_count_mapreduce(spark, d):
    p = Pipeline(spark)
    pairs = p.map(t(spark, d, "documents"), F.explode(S.words(F.col("text"))).alias("word"), F.lit(1).cast("bigint").alias("one"))
    return p.spill_sort_combine(pairs, ["word"], F.sum("one").alias("cnt"))


@query("SELECT lower(word) AS word, count(*) AS cnt FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count_ci(spark, d):
    return wordcount.word_counts(t(spark, d, "documents"), fold_case=True)


@query("SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(regexp_replace(text, '([0-9]+)|(the)', ' ', 'g'), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count_ignore(spark, d):
    return wordcount.word_counts(t(spark, d, "documents"), ignore=["[0-9]+", "", "the"])


@query(f"SELECT word, count(*) AS cnt FROM ({_WORDS}) WHERE word <> '' GROUP BY word ORDER BY cnt DESC, word LIMIT 100")
def word_freq_desc(spark, d):
    return wordcount.most_frequent(wordcount.word_counts(t(spark, d, "documents")), 100)


@query("SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM documents")
def line_count(spark, d):
    return wordcount.line_count(t(spark, d, "documents"))


# ---------------------------------------------------------------- aggregation


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def group_sum(spark, d):
    return aggregate.group_aggregate(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT o_custkey, max(o_totalprice) AS max_price FROM orders GROUP BY ALL")
def group_fold_max(spark, d):
    return aggregate.group_aggregate(t(spark, d, "orders"), ["o_custkey"], F.max("o_totalprice").alias("max_price"))


@query("SELECT o_custkey, min(o_totalprice) AS min_price FROM orders GROUP BY ALL")
def group_fold_min(spark, d):
    return aggregate.group_aggregate(t(spark, d, "orders"), ["o_custkey"], F.min("o_totalprice").alias("min_price"))


@query("SELECT l_returnflag AS key, bit_xor(l_orderkey * 8 + l_linenumber) AS value FROM lineitem GROUP BY ALL")
def group_fold_udaf(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("v"))
    return aggregate.group_fold(rows, "k", "v", lambda a, b: a ^ b)


@query("SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY ALL")
def reduce_groups(spark, d):
    def fn(key, rows):
        n, lo, hi = 0, None, None
        for _, date in rows:
            n += 1
            if date is not None:
                lo = date if lo is None or date < lo else lo
                hi = date if hi is None or date > hi else hi
        yield key[0], n, lo, hi

    rows = t(spark, d, "orders").select("o_custkey", "o_orderdate")
    kind = rows.schema["o_orderdate"].dataType.simpleString()
    return aggregate.reduce_rows(rows, ["o_custkey"], fn, f"o_custkey bigint, n bigint, first_date {kind}, last_date {kind}")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def reduce_multi_output(spark, d):
    def place(row):  # nulls last, NaN first
        _, line, price = row
        number = price is not None and price == price
        return price is None, price == price, -price if number else 0.0, line is None, line

    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return aggregate.reduce_rows(rows, ["l_orderkey"], lambda key, rows: heapq.nsmallest(2, rows, key=place), rows.schema)


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def combine_distinct(spark, d):
    return aggregate.distinct_rows(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


# ---------------------------------------------------------------- joins


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def inner_join(spark, d):
    return joins.inner_join(t(spark, d, "customer"), t(spark, d, "orders"), [("c_custkey", "o_custkey")], ["c_custkey", "c_name", "o_orderkey", "o_totalprice"])


@query("SELECT a.l_partkey, CAST(sum(a.l_linenumber * b.l_linenumber) AS BIGINT) AS s, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey GROUP BY ALL")
def inner_join_many_to_many(spark, d):
    a = t(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").cast("bigint").alias("x"))
    b = a.select(F.col("l_partkey").alias("k"), F.col("x").alias("y"))
    return joins.inner_join(a, b, [("l_partkey", "k")]).groupBy("l_partkey").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.count("*").alias("n"))


@query("SELECT n_name, s_name, c_name FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey % 100")
def inner_join_custom_key(spark, d):
    n, s, c = (t(spark, d, x) for x in ("nation", "supplier", "customer"))
    ns = joins.inner_join(n, s, [("n_nationkey", "s_nationkey")], ["n_name", "s_name", "s_nationkey", "s_suppkey"])
    return joins.inner_join(ns, c, (c["c_nationkey"] == ns["s_nationkey"]) & (c["c_custkey"] % 100 == ns["s_suppkey"] % 100), ["n_name", "s_name", "c_name"])


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def cogroup_join(spark, d):
    def fn(key, left, right):
        n, total = 0, 0.0
        if left and key[0] is not None:  # nulls match nothing
            for _, there, price in right:
                n += there
                total += 0.0 if price is None else price
        if left:
            yield key[0], n * len(left), round(total * len(left), 2)

    c = t(spark, d, "customer").select("c_custkey")
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").isNotNull().cast("int"), "o_totalprice")
    return joins.cogroup_rows(c, o, ["c_custkey"], ["o_custkey"], fn, "c_custkey bigint, n_orders bigint, total double")


@query("SELECT p_brand, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def lookup_join(spark, d):
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.lookup_join(t(spark, d, "lineitem").select("l_partkey", "l_quantity"), parts, "l_partkey").groupBy("p_brand").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, n_name AS name FROM nation")
def combine_three(spark, d):
    def fn(key, batches):
        n, name = [0, 0, 0], None
        for b in batches:
            for i, part in b.groupby("input"):
                n[i] += len(part)
                if i == 0:
                    name = part["row0"].iloc[0]["n_name"]
        yield pd.DataFrame({"k": [key[0]], "customers": [n[1]], "suppliers": [n[2]], "name": [name]})

    n, c, s = t(spark, d, "nation"), t(spark, d, "customer"), t(spark, d, "supplier")
    inputs = [n.select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name"), c.select(F.col("c_nationkey").cast("bigint").alias("k"), "c_custkey"), s.select(F.col("s_nationkey").cast("bigint").alias("k"), "s_suppkey")]
    return joins.combine(inputs, ["k"], fn, "k bigint, customers bigint, suppliers bigint, name string")


_CLICKS = "SELECT user_id, ts, {} FROM events WHERE event_type {} (SELECT min(event_type) FROM events)"


@query(f"SELECT l.user_id, l.ts, l.event_id, (SELECT max(struct_pack(ts := r.ts, value := r.value)).value FROM ({_CLICKS.format('value', '=')}) r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS value FROM ({_CLICKS.format('event_id', '<>')}) l")
def asof_events(spark, d):
    e = t(spark, d, "events")
    first = e.agg(F.min("event_type").alias("first"))  # one row
    e = e.join(F.broadcast(first))
    return joins.asof_join(e.where("event_type <> first").select("user_id", "ts", "event_id"), e.where("event_type = first").select("user_id", "ts", "value"), ["user_id"], "ts", ["value"])


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_acctbal >= n_nationkey * 100 AND c_acctbal < n_nationkey * 150 + 10")
def range_join_balances(spark, d):
    ranges = t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 100).alias("lo"), (F.col("n_nationkey") * 150 + 10).alias("hi"))
    return joins.range_join(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ranges, "c_acctbal", "lo", "hi", 250).select("c_custkey", "n_nationkey")


def _outer(how: str):
    def fn(spark, d):
        c, o = t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey")
        return joins.join(c, o, [("c_custkey", "o_custkey")], how)

    return fn


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI")):
    QUERIES[f"join_{_how}"] = _outer(_how)
    _cols = "c_custkey, c_name" if _how in ("left_semi", "left_anti") else "c_custkey, c_name, o_custkey, o_orderkey"
    ORACLE_SQL[f"join_{_how}"] = f"SELECT {_cols} FROM customer {_sql} JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey"


# ---------------------------------------------------------------- order and partitions


@query("SELECT CAST(0 AS BIGINT) AS out_of_order, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def sort_partitions(spark, d):
    rows = ordering.sort_partitions(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", partitions=8, by=["o_custkey"])

    def check(batches):
        last, bad, n, total = None, 0, 0, 0
        for b in batches:
            for k, c in zip(b["o_orderkey"].tolist(), b["o_custkey"].tolist(), strict=True):
                bad += last is not None and (c, k) < last
                last, n, total = (c, k), n + 1, total + k
        yield pd.DataFrame({"bad": [bad], "n": [n], "total": [total]})

    return rows.mapInPandas(check, "bad bigint, n bigint, total bigint").agg(F.sum("bad").alias("out_of_order"), F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def sort_total(spark, d):
    return ordering.number_rows(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", path=scratch(spark, "sorted"), name="rank")


@query(ORACLE_SQL["sort_total"])
def total_rank(spark, d):
    return ordering.total_rank(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT p_partkey, p_size, p_brand, row_number() OVER (ORDER BY p_size DESC, p_brand, p_partkey DESC) AS row FROM part")
def sort_desc_custom(spark, d):
    return ordering.number_rows(t(spark, d, "part").select("p_partkey", "p_size", "p_brand"), F.desc("p_size"), F.asc("p_brand"), F.desc("p_partkey"), path=scratch(spark, "sorted"))


@query("SELECT o_custkey, count(*) AS n, CAST(1 AS BIGINT) AS n_partitions FROM orders GROUP BY ALL")
def hash_partition(spark, d):
    rows = ordering.partition(t(spark, d, "orders").select("o_custkey"), 8, "o_custkey").select("o_custkey", F.spark_partition_id().alias("p"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("p").alias("n_partitions"))


@query("SELECT true AS ordered, count(*) AS n FROM orders")
def range_partition(spark, d):
    """Ranges of keys don't overlap."""
    rows = ordering.partition(t(spark, d, "orders").select("o_orderkey"), 8, "o_orderkey", "range").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"))
    rows = rows.withColumn("before", F.lag("hi").over(Window.orderBy("p")))  # a row for each partition
    return rows.agg(F.bool_and(F.coalesce(F.col("before") < F.col("lo"), F.lit(True))).alias("ordered"), F.sum("n").alias("n"))


@query("SELECT CAST(3 AS BIGINT) AS n_partitions, count(*) AS n FROM orders")
def merge_partitions(spark, d):
    rows = ordering.merge_partitions(ordering.partition(t(spark, d, "orders").select("o_orderkey"), 12, method="round_robin"), 3)
    return rows.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p").alias("n_partitions"), F.count("*").alias("n"))


_TURNS = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, {n} AS name, CAST({i} AS INT) AS input, row_number() OVER (ORDER BY {k}) AS turn FROM {x}" for i, (x, k, n) in enumerate((("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"))))


@query(f"SELECT *, row_number() OVER (ORDER BY turn, input) AS row FROM ({_TURNS})")
def interleave_inputs(spark, d):
    inputs = [t(spark, d, x).select(F.col(k).cast("bigint").alias("k"), F.col(n).alias("name")) for x, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"))]
    return ordering.interleave(inputs, ["k"], [scratch(spark, "turns") for _ in range(3)])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("SELECT CAST(o_orderkey % 4 AS INT) AS part, count(*) AS n FROM orders GROUP BY 1")
def process_numbered_partitions(spark, d):
    def fn(number, batches):
        yield pd.DataFrame({"part": [number], "n": [sum(len(b) for b in batches)]})

    rows = ordering.partition(t(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("k")), 4, F.col("k"), "custom")
    return Pipeline(spark).process_partitions(rows, fn, "part int, n bigint")


@query("SELECT CAST(o_orderkey % 4 AS INT) AS part, count(*) AS n, min(o_orderkey % 4) AS lo, max(o_orderkey % 4) AS hi FROM orders GROUP BY 1")
def custom_partition(spark, d):
    rows = ordering.partition(t(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("k")), 4, F.col("k"), "custom")
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query("SELECT CAST(CASE WHEN o_orderkey % 10 < 9 THEN 0 ELSE (o_orderkey // 10) % 3 + 1 END AS INT) AS part, count(*) AS n FROM orders GROUP BY 1")
def skewed_partition(spark, d):
    key = F.when(F.col("o_orderkey") % 10 < 9, 0).otherwise(F.floor(F.col("o_orderkey") / 10) % 3 + 1)
    rows = ordering.partition(t(spark, d, "orders").select("o_orderkey"), 4, key, "custom")
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(spark, d):
    return ordering.top_k_per_group(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_inputs(spark, d):
    return ordering.concat(t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name")))


# ---------------------------------------------------------------- sort benchmark


@query(None)
def gensort_shape(spark, d):
    rows = sortbench.generate_records(spark, t(spark, d, "orders").count(), 8)
    return rows.select("number", F.base64("key").alias("key64"), F.length("record").alias("width"), F.crc32("record").alias("crc"))


@query("SELECT count(*) AS records, CAST(0 AS BIGINT) AS unsorted, CAST(0 AS BIGINT) AS lost FROM orders")
def gensort_files(spark, d):
    """Records are generated, written, read, sorted, written again, and validated as they were written."""
    n = t(spark, d, "orders").count()
    made = readers.printable_records(spark, sinks.write_records(sortbench.generate_records(spark, n, 8), scratch(spark, "records")))
    done = ordering.number_rows(made, "key", path=scratch(spark, "sorted"))
    checked = sortbench.validate(done, "key", "row", checksum_of="record")
    before = made.agg(F.sum(F.crc32("record").cast("decimal(38,0)")).alias("made"))
    return checked.join(before).select("records", "unsorted", (F.col("checksum") - F.col("made")).cast("bigint").alias("lost"))


_VOCABULARY = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove")


@query(f"SELECT i AS number, string_agg(([{', '.join(repr(w) for w in _VOCABULARY)}])[CAST((i * 1103515 + j * 12345) % 2147483647 * 48271 % 2147483647 % 7 AS INT) + 1], ' ' ORDER BY j) AS line FROM (SELECT range AS i FROM range(0, 5000)), (SELECT range AS j FROM range(1, 13)) GROUP BY i")
def generate_text(spark, d):
    return sortbench.generate_text(spark, 5000, 8, 12, _VOCABULARY)


_VAL = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, lag(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders"


@query(f"SELECT count(*) AS records, count(*) FILTER (o_custkey < b) AS unsorted, count(*) FILTER (o_custkey = b) AS duplicates, min(i) FILTER (o_custkey < b) AS first_unsorted, arg_min(o_custkey, i) AS first_key, arg_max(o_custkey, i) AS last_key FROM ({_VAL})")
def valsort(spark, d):
    return sortbench.validate(t(spark, d, "orders"), "o_custkey", "o_orderkey").drop("checksum")


# ---------------------------------------------------------------- rows


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 AS BIGINT) AS product, CAST(((l_partkey * 123456789 + 2147483648) % 4294967296) - 2147483648 AS BIGINT) AS wrapped FROM lineitem")
def map_multiply(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.times(F.col("l_partkey"), 7).alias("product"), S.times(F.col("l_partkey"), 123456789, wrap=True).alias("wrapped"))


@query("SELECT event_id, unnest(string_split(event_type, 'e')) AS piece FROM events WHERE value >= 10")
def map_filter_flatmap(spark, d):
    return Pipeline(spark).map(t(spark, d, "events"), "event_id", F.explode(F.split("event_type", "e")).alias("piece"), where=F.col("value") >= 10)


@query("SELECT l_orderkey, CAST(CAST(l_linenumber AS VARCHAR) AS INT) AS n FROM lineitem")
def parse_ints(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", S.parse_int(F.col("l_linenumber").cast("string")).alias("n"))


@query("SELECT range AS id, range * range AS square FROM range(0, 10000)")
def generate_range(spark, d):
    return Pipeline(spark).generate(10000, 8, (F.col("id") * F.col("id")).alias("square"))


@query("SELECT c_custkey, length(c_name) AS chars, strlen(c_name) AS bytes, concat('[', c_name, ', ', c_custkey, ']') AS pair FROM customer")
def scalar_functions(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.char_length("c_name").cast("bigint").alias("chars"), S.byte_length(F.col("c_name")).cast("bigint").alias("bytes"), S.pair_text(F.col("c_name"), F.col("c_custkey")).alias("pair"))


_SIZES = "SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1"


@query(f"SELECT k, list_reduce(list_prepend(CAST(0 AS BIGINT), l), lambda a, x: (a * 31 + x) % 2147483647) AS h, CAST(len(l) AS BIGINT) AS n, true AS same FROM ({_SIZES})")
def list_functions(spark, d):
    """Sequence hash, and a shuffle that keeps all items."""
    lists = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    rows = lists.withColumn("s", S.shuffled(F.col("l"), 7))
    return rows.select("k", S.sequence_hash(F.col("l")).alias("h"), F.size("s").cast("bigint").alias("n"), (F.array_sort("s") == F.col("l")).alias("same"))


@query("SELECT p_partkey, CASE WHEN encode(p_name) < encode(p_brand) THEN -1 WHEN p_name = p_brand THEN 0 ELSE 1 END AS sign, left(p_name, 4) AS head FROM part")
def byte_functions(spark, d):
    """Comparison by bytes and leading bytes as keys."""
    return t(spark, d, "part").select("p_partkey", S.compare_bytes(F.col("p_name"), F.col("p_brand")).alias("sign"), S.key_of(F.col("p_name"), 4).cast("string").alias("head"))


@query("SELECT l_orderkey, list_has_all([1, 2, 3, 4], list(l_linenumber)) AS subset FROM lineitem GROUP BY 1")
def subset_test(spark, d):
    lists = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("l"))
    return lists.select("l_orderkey", S.is_subset(F.col("l"), F.array(*map(F.lit, (1, 2, 3, 4)))).alias("subset"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v(n, s)")
def rows_in_memory(spark, d):
    return readers.from_rows(spark, [(1, "a"), (2, None), (3, "c")], "n int, s string")


@query("SELECT range AS n, range * 3 AS triple FROM range(0, 1000)")
def own_source(spark, d):
    """A source defined by its splits and a function that reads one."""

    def plan(options):
        step = int(options["step"])
        return [(a, min(a + step, 1000)) for a in range(0, 1000, step)]

    readers.register_source(spark, "tripled_numbers", "n bigint, triple bigint", plan, lambda split: ((n, 3 * n) for n in range(*split)))
    return spark.read.format("tripled_numbers").option("step", "300").load()


# ---------------------------------------------------------------- mining

_ITEMS = "SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS support FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 10"
_RANKED = f"SELECT item, support, row_number() OVER (ORDER BY support DESC, item) AS rank, count(*) OVER () AS n FROM ({_ITEMS})"
_GROUPED = f"SELECT item, support, rank, (rank - 1) // CAST(ceil(n / 16.0) AS BIGINT) AS group_id FROM ({_RANKED})"


@query(_ITEMS)
def frequent_items(spark, d):
    return mining.frequent_items(t(spark, d, "lineitem"), "l_orderkey", "l_partkey", 10)


@query(_GROUPED)
def rank_groups(spark, d):
    return mining.rank_items(frequent_items(spark, d), 16)


@query(f"WITH g AS ({_GROUPED}), b AS (SELECT DISTINCT l_orderkey AS basket, rank, group_id FROM lineitem JOIN g ON l_partkey = item), e AS (SELECT basket, group_id, max(rank) AS hi FROM b GROUP BY ALL) SELECT e.basket, e.group_id, string_agg(CAST(b.rank AS VARCHAR), ',' ORDER BY b.rank) AS items FROM e JOIN b ON b.basket = e.basket AND b.rank <= e.hi GROUP BY ALL")
def group_transactions(spark, d):
    rows = mining.group_transactions(t(spark, d, "lineitem"), "l_orderkey", "l_partkey", rank_groups(spark, d))
    return rows.select("basket", "group_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("WITH b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.item AS a, y.item AS b, count(*) AS support FROM b x JOIN b y ON x.o = y.o AND x.item < y.item GROUP BY ALL HAVING count(*) >= 20")
def frequent_pairs(spark, d):
    patterns, ranked = mining.frequent_patterns(_brands(spark, d), "o", "item", 20, 8, longest=2, ranks_at=scratch(spark, "ranks"))
    pairs = patterns.where(F.size("pattern") == 2).select(F.col("pattern")[0].alias("x"), F.col("pattern")[1].alias("y"), "support")
    one = ranked.select(F.col("rank").alias("x"), F.col("item").alias("i"))
    two = ranked.select(F.col("rank").alias("y"), F.col("item").alias("j"))
    return pairs.join(one, "x").join(two, "y").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "support")


def _brands(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return joins.lookup_join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey"), parts, "l_partkey").select("o", "item")


_PATTERNS = """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS r FROM b GROUP BY item HAVING count(*) >= 20),
br AS (SELECT o, r FROM b JOIN r USING (item)),
sub AS (SELECT o, [r] AS p, r AS last FROM br UNION ALL SELECT sub.o, list_append(p, br.r), br.r FROM sub JOIN br ON sub.o = br.o AND br.r > sub.last),
pat AS (SELECT p, count(*) AS s FROM sub GROUP BY p HAVING count(*) >= 20),
less AS (SELECT DISTINCT [x for x in p if x <> y] AS p, s FROM (SELECT p, s, unnest(p) AS y FROM pat)),
each AS (SELECT unnest(p) AS i, p, s FROM pat WHERE NOT EXISTS (SELECT 1 FROM less WHERE less.p = pat.p AND less.s = pat.s)),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, len(p) DESC, p) AS rank FROM each),
names AS (SELECT i, rank, s, string_agg(n.item, ',' ORDER BY n.r) AS pattern FROM (SELECT i, rank, s, unnest(p) AS x FROM best WHERE rank <= 10) JOIN r n ON n.r = x GROUP BY ALL)
SELECT r.item, rank, s AS support, pattern FROM names JOIN r ON r.r = i"""


@query(_PATTERNS)
def topk_patterns(spark, d):
    return mining.top_patterns(_brands(spark, d), "o", "item", 20, 10, 8, ranks_at=scratch(spark, "ranks")).withColumn("pattern", F.array_join("pattern", ","))


# ---------------------------------------------------------------- files


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def roundtrip_record_file(spark, d):
    rows = t(spark, d, "nation")
    return readers.read(spark, sinks.write(rows, scratch(spark, "records")), schema=rows.schema)


@query("SELECT concat('[', n_name, ', ', n_nationkey, ']') AS value FROM nation")
def roundtrip_text(spark, d):
    path = scratch(spark, "text")
    return readers.read(spark, sinks.write_pairs(t(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value")), path), "text")


def _round_trip(format: str):
    def fn(spark, d):
        rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
        return readers.read(spark, sinks.write(rows, scratch(spark, format), format, compression="gzip" if format != "orc" else "zlib"), format, rows.schema)

    return fn


for _format in ("csv", "json", "orc"):
    QUERIES[f"roundtrip_{_format}"] = _round_trip(_format)
    ORACLE_SQL[f"roundtrip_{_format}"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query("SELECT r_regionkey, r_name FROM region")
def overwrite_output(spark, d):
    """The second write takes the place of the first."""
    path = scratch(spark, "overwritten")
    sinks.write(t(spark, d, "nation").select("n_nationkey"), path)
    rows = t(spark, d, "region").select("r_regionkey", "r_name")
    return readers.read(spark, sinks.write(rows, path, mode="overwrite"), schema=rows.schema)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def split_by_partition_write(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return spark.read.schema(rows.schema).parquet(sinks.write(rows, scratch(spark, "split"), by=["o_orderpriority"]))


@query("SELECT true AS there, count(*) AS n FROM region")
def barrier(spark, d):
    p, path, seen = Pipeline(spark), scratch(spark, "barrier"), []
    p.write(t(spark, d, "region"), path)
    p.after(lambda: seen.append(spark.read.parquet(path).count()))
    p.run()
    return spark.range(1).select(F.lit(seen[0] > 0).alias("there"), F.lit(seen[0]).cast("bigint").alias("n"))


# ---------------------------------------------------------------- further relational operations


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, d):
    o = t(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sums(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    return t(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY ALL")
def pivot_counts(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", F.coalesce("F", F.lit(0)).cast("bigint").alias("f"), F.coalesce("O", F.lit(0)).cast("bigint").alias("o"))


@query("SELECT true AS near, count(DISTINCT o_custkey) AS n FROM orders")
def approximate_distinct(spark, d):
    """The sketch's estimate is within 10 % of the count.

    Both are taken of the keys, each once: beside count_distinct in one aggregation,
    Spark holds a sketch of 3 KB for each key.
    """
    keys = aggregate.distinct_rows(t(spark, d, "orders"), "o_custkey")
    both = keys.agg(F.approx_count_distinct("o_custkey", 0.02).alias("e"), F.count("o_custkey").alias("n"))
    return both.select((F.abs(F.col("e") - F.col("n")) <= F.col("n") * 0.1).alias("near"), "n")


@query("SELECT o_orderkey, o_custkey, lag(o_totalprice) OVER w AS before, row_number() OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_lag(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", F.lag("o_totalprice").over(w).alias("before"), F.row_number().over(w).cast("bigint").alias("nth"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    return ev.tumbling(t(spark, d, "events"))
