"""Log line queries reach both outcomes; calendar ends, look-backs, id-or-name by hand."""

import datetime as dt

from pyspark.sql import functions as F

from telemark.functions import timefn as T
from telemark.operators import labels as LB
from telemark.plans import loglines as Q
from telemark.plans.enrichment import search_logs

SF01 = "/root/testdata/sf0.01"


def test_each_feature_has_both_outcomes(spark):
    rows = Q.log_features(spark, SF01).collect()
    for c in ("is_structured", "has_stack_trace", "is_error"):
        assert {r[c] for r in rows} == {True, False}, c
    assert {r.json_status for r in rows} == {"", "200", "500"}
    assert any(r.latency_ms is None for r in rows) and any(r.latency_ms is not None for r in rows)
    assert {r.workload_name.split("-")[0] for r in rows} == {"name", "app", "service", "pod"}


def test_latency_and_status_reads(spark):
    lines = [(1, "latency=401ms"), (2, "latency: 400ms"), (3, '{"message":"x latency=900ms","status":500}'), (4, '{"message":"x","status":"200"}'), (5, None), (6, "")]
    df = spark.createDataFrame(lines, "i int, m string")
    assert sorted(r.i for r in Q.high_latency_logs(df, "m", 400).collect()) == [1, 3]
    assert [r.i for r in Q.structured_status(df, "m", 500).collect()] == [3]
    n = Q.log_features(spark, SF01).count()
    assert 0 < Q.high_latency_logs_query(spark, SF01).count() < n and 0 < Q.structured_status_query(spark, SF01).count() < n


def test_calendar_ends(spark):
    days = [dt.datetime(2024, 2, 29, 13), dt.datetime(2024, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 3, 3), None]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    got = [tuple(r) for r in df.select(T.end_of_week("t"), T.end_of_month("t")).collect()]
    end = dict(hour=23, minute=59, second=59, microsecond=999999)
    assert got == [(dt.datetime(2024, 3, 2, **end), dt.datetime(2024, 2, 29, **end)), (dt.datetime(2025, 1, 4, **end), dt.datetime(2024, 12, 31, **end)),
                   (dt.datetime(2024, 3, 9, **end), dt.datetime(2024, 3, 31, **end)), (None, None)]


def test_lookbacks(spark):
    texts = ["T | where x > ago(7d)", "T | where x > ago(7.5d)", "T | where x > ago(169h)", "T", None, "T | where x > ago(1h) and y > ago(30d)"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    assert [r.over_limit for r in LB.audit_time_bounds(df, "q").collect()] == [False, True, True, False, False, True]
    assert {r.over_limit for r in Q.lookback_audit(spark, SF01).select("over_limit").distinct().collect()} == {True, False}


def test_id_or_name(spark):
    df = spark.createDataFrame([(7, "a"), (8, "7"), (9, "b"), (None, "a"), (10, None)], "id bigint, name string")
    assert sorted(str(r.id) for r in search_logs(df, "name", id_or_name=("id", "name", ["7", "a", "x1"])).collect()) == ["7", "8", "None"]
    by_text = df.withColumn("id", F.col("id").cast("string"))
    assert [r.id for r in search_logs(by_text, "name", id_or_name=("id", "name", ["9"])).collect()] == ["9"]
    assert Q.id_or_name(spark, SF01).count() == 3
