"""Log queries over lines with JSON bodies, latencies and labels (SURVEY D-2..D-7,
D-10, R-31, T-19, TM-6, C-11).

The given tables have no such texts, so the lines are column expressions of
``events``: the body is JSON or plain by user, its latency and status come from
``value``, the labels and the pod from the user.  The SQL builds them with
literals of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.functions import aggs, enrich as D, timefn as T
from telemark.operators import labels as LB
from telemark.plans.enrichment import search_logs
from telemark.plans.registry import register
from telemark.sources.tables import Tables


def high_latency_logs(df: DataFrame, message: str, threshold_ms: int, ts=None, as_of=None, span=None) -> DataFrame:
    """D-10 lines of the span whose latency (D-4) is over a threshold."""
    out = T.time_scope(df, ts, as_of, span) if ts is not None else df
    return out.withColumn("latency_ms", D.latency_ms(message)).filter(F.col("latency_ms") > threshold_ms)


def structured_status(df: DataFrame, message: str, status, ts=None, as_of=None, span=None) -> DataFrame:
    """D-10 lines of the span with a JSON body of this status (D-7)."""
    out = T.time_scope(df, ts, as_of, span) if ts is not None else df
    return out.withColumn("json_status", D.json_status(message)).filter(F.col("json_status") == str(status))


def log_lines(events: DataFrame) -> DataFrame:
    """Events as log lines: event_id, ts, level, message, labels, pod."""
    kind, user = F.col("event_type"), F.col("user_id")
    ms = F.floor(F.col("value") * 10).cast("string")
    code = F.when(F.col("value") > 45, "500").otherwise("200")
    message = (F.when(user % 4 == 0, F.concat(F.lit('{"message":"'), kind, F.lit(" done latency="), ms, F.lit('ms","status":"'), code, F.lit('"}')))
                .when(user % 4 == 1, F.concat(kind, F.lit(" took latency: "), ms, F.lit("ms")))
                .when(user % 4 == 2, F.concat(F.lit('{"message":"'), kind, F.lit(' failed","stack":"frame"}')))
                .otherwise(F.concat(F.lit("Unhandled Exception: "), kind)))
    app = (user % 7).cast("string")
    labels = (F.when(user % 5 == 0, F.concat(F.lit('{"app.kubernetes.io/name":"name-'), app, F.lit('","app":"other"}')))
               .when(user % 5 == 1, F.concat(F.lit('{"app":"app-'), app, F.lit('"}')))
               .when(user % 5 == 2, F.concat(F.lit('{"app":"","service":"service-'), app, F.lit('"}')))
               .when(user % 5 == 3, F.lit("no labels")))
    return events.select("event_id", "ts", kind.alias("level"), message.alias("message"), labels.alias("labels"),
                         F.concat(F.lit("pod-"), user.cast("string")).alias("pod"))


def log_features_q(events: DataFrame) -> DataFrame:
    """D-1..D-7 over lines that reach each branch."""
    e = D.enrich_logs(log_lines(events), "message", level="level", labels="labels", pod="pod")
    return e.select("event_id", "workload_name", "plain_text", "is_structured", "has_stack_trace", "json_status", "latency_ms", "is_error")


def high_latency_logs_q(events: DataFrame, threshold_ms: int = 400) -> DataFrame:
    """D-10 latency over a threshold in the last 7 days, by workload."""
    out = high_latency_logs(log_lines(events), "message", threshold_ms, "ts", "2024-01-31", "7d")
    return out.select("event_id", D.workload_name("labels", "pod").alias("workload_name"), "latency_ms", D.plain_text("message").alias("plain_text"))


def structured_status_q(events: DataFrame, status: str = "500") -> DataFrame:
    """D-10 lines of one status in the last 7 days."""
    out = structured_status(log_lines(events), "message", status, "ts", "2024-01-31", "7d")
    return out.select("event_id", "json_status", D.plain_text("message").alias("plain_text"))


def lookback_audit_q(events: DataFrame) -> DataFrame:
    """T-19 which query texts leave time open or look back over 7 days."""
    user, n = F.col("user_id"), F.col("event_id")
    text = (F.when(user % 4 == 0, F.concat(F.lit("Logs | take "), (n % 9).cast("string")))
             .when(user % 4 == 1, F.concat(F.lit("Logs | where Start > ago("), (n % 20).cast("string"), F.lit("d) and Start < ago(1h)")))
             .when(user % 4 == 2, F.concat(F.lit("Logs | where End > AGO( "), (n % 400).cast("string"), F.lit("h )")))
             .otherwise(F.lit("Logs | where Start > datetime(2024-01-01)")))
    return LB.audit_time_bounds(events.select("event_id", text.alias("query")), "query").drop("query")


def calendar_bounds_q(events: DataFrame) -> DataFrame:
    """TM-6 events by week (from Sunday) and month, with both ends of either."""
    out = events.groupBy(T.start_of_week("ts").alias("week_start"), T.start_of_month("ts").alias("month_start")).agg(aggs.count_all().alias("n_events"))
    return out.select("week_start", T.end_of_week("week_start").alias("week_end"), "month_start", T.end_of_month("month_start").alias("month_end"), "n_events")


def id_or_name_q(customer: DataFrame) -> DataFrame:
    """R-31 rows whose id or name is one of the given values."""
    wanted = ["7", "45", "Customer#000000099", "Customer#000000045", "nobody"]
    return search_logs(customer, "c_name", id_or_name=("c_custkey", "c_name", wanted)).select("c_custkey", "c_name")


def category_counts_q(documents: DataFrame) -> DataFrame:
    """C-11 examples and their total length in each category."""
    return documents.groupBy(F.col("source").alias("category")).agg(aggs.count_all().alias("n_examples"), F.sum(F.length("text")).alias("n_chars"))


_LINES_SQL = """
WITH l AS (
SELECT event_id, ts, event_type AS level, 'pod-' || CAST(user_id AS VARCHAR) AS pod,
       CASE user_id % 4
         WHEN 0 THEN '{"message":"' || event_type || ' done latency=' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR)
                     || 'ms","status":"' || CASE WHEN value > 45 THEN '500' ELSE '200' END || '"}'
         WHEN 1 THEN event_type || ' took latency: ' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || 'ms'
         WHEN 2 THEN '{"message":"' || event_type || ' failed","stack":"frame"}'
         ELSE 'Unhandled Exception: ' || event_type END AS message,
       CASE user_id % 5 WHEN 0 THEN 'name-' WHEN 1 THEN 'app-' WHEN 2 THEN 'service-' END || CAST(user_id % 7 AS VARCHAR) AS label
FROM events),
d AS (
SELECT *, coalesce(label, pod) AS workload_name, starts_with(message, '{') AS is_structured,
       CASE WHEN starts_with(message, '{') THEN json_extract_string(message, '$.message') ELSE message END AS plain_text,
       CASE WHEN starts_with(message, '{') THEN coalesce(json_extract_string(message, '$.status'), '') ELSE '' END AS json_status,
       TRY_CAST(nullif(regexp_extract(message, 'latency[=:]\\s?([0-9]+)ms', 1), '') AS INTEGER) AS latency_ms
FROM l)
"""
_LAST_DAYS_SQL = "ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31 00:00:00'"


@register("log_features", _LINES_SQL + """
SELECT event_id, workload_name, plain_text, is_structured,
       contains(plain_text, 'Exception') OR contains(message, '"stack":') AS has_stack_trace, json_status, latency_ms,
       lower(level) IN ('critical', 'error') AS is_error
FROM d
""")
def log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_features_q(Tables(spark, sf_dir).events)


@register("high_latency_logs", _LINES_SQL + f"""
SELECT event_id, workload_name, latency_ms, plain_text FROM d WHERE latency_ms > 400 AND {_LAST_DAYS_SQL}
""")
def high_latency_logs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_latency_logs_q(Tables(spark, sf_dir).events)


@register("structured_status", _LINES_SQL + f"""
SELECT event_id, json_status, plain_text FROM d WHERE json_status = '500' AND {_LAST_DAYS_SQL}
""")
def structured_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured_status_q(Tables(spark, sf_dir).events)


@register("lookback_audit", """
WITH q AS (
SELECT event_id, user_id % 4 AS k,
       CASE user_id % 4 WHEN 1 THEN greatest((event_id % 20) * 1.0::DOUBLE, 1 / 24.0::DOUBLE) WHEN 2 THEN (event_id % 400) / 24.0::DOUBLE END AS lookback_days
FROM events)
SELECT event_id, k <> 0 AS bounded, CASE WHEN k = 0 THEN 24 END::INTEGER AS default_span_hours, lookback_days,
       coalesce(lookback_days > 7, false) AS over_limit
FROM q
""")
def lookback_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookback_audit_q(Tables(spark, sf_dir).events)


@register("calendar_bounds", """
WITH w AS (
SELECT date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER)) AS week_start, date_trunc('month', ts) AS month_start, count(*) AS n_events
FROM events GROUP BY 1, 2)
SELECT CAST(week_start AS TIMESTAMP) AS week_start, CAST(week_start AS TIMESTAMP) + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS week_end,
       CAST(month_start AS TIMESTAMP) AS month_start, CAST(month_start AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS month_end, n_events
FROM w
""")
def calendar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_bounds_q(Tables(spark, sf_dir).events)


@register("id_or_name", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (7, 45) OR c_name IN ('Customer#000000099', 'Customer#000000045', 'nobody')
""")
def id_or_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_or_name_q(Tables(spark, sf_dir).customer)


@register("category_counts", """
SELECT source AS category, count(*) AS n_examples, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1
""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_counts_q(Tables(spark, sf_dir).documents)
