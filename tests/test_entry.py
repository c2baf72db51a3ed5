import numbers
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    """Rows in an order of their own; a number is a number, whether a column with nulls holds it as a float or not."""
    df = df.reindex(sorted(df.columns), axis=1)

    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_core_queries_match_their_sql(spark):
    import duckdb

    from flowjob.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    wrong = []
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        if sorted(got.columns) != sorted(want.columns) or len(got) != len(want) or rows_of(got.astype(object).where(got.notna(), None)) != rows_of(want.astype(object).where(want.notna(), None)):
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_windows(spark, tmp_path):
    from flowjob.streaming import events

    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 23:00:00", "a", 2.0), (3, "2024-01-03 00:00:00", "b", 5.0), (4, "2024-01-09 00:00:00", "b", 1.0)], "event_id int, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.stream_tumbling(spark, str(tmp_path / "in"), rows.schema)
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    closed = {tuple(r) for r in spark.table("closed").collect()}
    everything = {tuple(r) for r in events.tumbling(rows).collect()}
    assert len(closed) == 2 and closed < everything
