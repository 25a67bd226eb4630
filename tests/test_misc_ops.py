"""Row budget, top-n, schema helpers, structural similarity, time helpers."""

import datetime as dt

from pyspark.sql import functions as F

from telemark.functions import text as TX
from telemark.functions import timefn as T
from telemark.operators.latest import row_budget, top_n
from telemark.sources.tables import constant_row, first_columns, get_schema


def test_row_budget(spark):
    rows = [(t, i) for t, n in ((1, 3), (2, 5), (3, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "t int, i int")
    got = sorted((r.t, r.i) for r in row_budget(df, "t", [F.col("i")], 6).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_top_n_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (3, "a")], "x int, y string")
    assert [tuple(r) for r in top_n(df, 2, [F.desc("x"), F.asc("y")]).collect()] == [(3, "a"), (3, "b")]
    assert [tuple(r) for r in get_schema(df).collect()] == [("x", "int"), ("y", "string")]
    assert first_columns(df, 1).columns == ["x"]
    assert constant_row(spark, x="hello").collect()[0].x == "hello"


def test_structural_similarity(spark):
    df = spark.createDataFrame([("AppRequests | where Success == false | summarize count() by Name",
                                 "AppRequests | where A | where B | summarize sum(X), count() by Name"),
                                ("T | take 1", "U | take 1")], "a string, b string")
    r = df.select(TX.structural_similarity("a", "b").alias("s"), TX.query_features("b").alias("f")).collect()
    assert abs(r[0].s - (0.4 * 1 + 0.3 * 0.5 + 0.3 * 0.5)) < 1e-12
    assert r[0].f.tables == ["AppRequests"] and r[0].f.n_where == 2 and r[0].f.group_by == ["name"]
    assert abs(r[1].s - 0.6) < 1e-12


def test_time_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 10, 7, 31),)], "ts timestamp_ntz")
    r = df.select(T.bin_time("ts", "15m").alias("b"), T.start_of_day("ts").alias("d"),
                  T.end_of_day("ts").alias("e"), T.datetime_diff("minute", F.col("ts"), T.ago("1h", "2024-01-02 10:00:00")).alias("m"),
                  T.start_of_week("ts").alias("w"), T.to_datetime(F.lit("nope")).alias("bad")).collect()[0]
    assert r.b == dt.datetime(2024, 1, 2, 10, 0) and r.d == dt.datetime(2024, 1, 2)
    assert r.e == dt.datetime(2024, 1, 2, 23, 59, 59, 999999) and r.m == 67
    assert r.w == dt.datetime(2023, 12, 31) and r.bad is None


def test_partitioning_helpers(spark):
    from telemark.operators.joins import broadcast_if_small, spread

    one = spark.range(100).coalesce(1)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(6)
    assert spread(many, 4).rdd.getNumPartitions() == 6            # already spread: unchanged
    small = spark.range(10)
    plan = broadcast_if_small(small).join(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    big = broadcast_if_small(spark.range(10), max_bytes=0, max_rows=5)   # over both bounds: no hint
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()
