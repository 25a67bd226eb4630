"""Run-log analytics queries over the driver tables.

Stand-ins: ``events`` is the call log (purpose = event_type, tokens = props.k,
latency = value, escalated = value > 45, raw status = ``QueryStatus.`` +
event_type); ``conversations`` assistant turns are the messages classified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.operators import runlog as G
from telemark.plans.registry import register
from telemark.sources.tables import Tables


def error_class_q(conversations: DataFrame) -> DataFrame:
    a = conversations.filter(F.col("role") == "assistant")
    return a.groupBy(G.error_class("text").alias("error_code")).agg(F.count(F.lit(1)).alias("n"))


def status_norm_q(events: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("QueryStatus."), F.col("event_type"))
    norm = G.normalize_status(None, raw)
    return events.groupBy(norm.alias("status"), G.ui_status(norm).alias("ui_status")).agg(F.count(F.lit(1)).alias("n"))


def _deployment():
    """Stand-in for a call's deployment: a function of the user."""
    return F.concat(F.lit("dep-"), (F.col("user_id") % 3).cast("string"))


def usage_sums_q(events: DataFrame) -> DataFrame:
    """G-5 / S-17 sums of a usage map by purpose and deployment, one row for
    each entry; the names come from the rows (here: from the value's tens)."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    name = F.concat(F.lit("u"), F.floor(F.col("value") / 10).cast("string"))
    ev = events.select(F.col("event_type").alias("purpose"), _deployment().alias("deployment"),
                       F.map_from_arrays(F.array(F.lit("total"), name), F.array(k, F.lit(1).cast("long"))).alias("usage"))
    out = G.usage_sums(ev, ["purpose", "deployment"])
    return out.select("purpose", "deployment", F.explode("usage").alias("name", "total"))


def call_metrics_q(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    ev = events.select(F.col("event_type").alias("purpose"), _deployment().alias("deployment"),
                       (F.col("event_id") % 3 + 1).alias("attempts"), (F.col("value") > 45).alias("escalated"), k.alias("tokens"),
                       F.col("value").alias("latency"))
    out = G.call_metrics(ev)
    return out.select("purpose", "deployment", "calls", "attempts", "escalations", "tokens",
                      F.round("latency_p50", 6).alias("latency_p50"), F.round("latency_p95", 6).alias("latency_p95"))


def innermost_message_q(conversations: DataFrame) -> DataFrame:
    a = conversations.filter(F.col("role") == "assistant")
    return a.select("conv_id", "turn", F.length(G.innermost_message("text")).alias("message_len"))


def informative_q(conversations: DataFrame) -> DataFrame:
    """G-4 between each user prompt and the reply that follows it."""
    u = conversations.filter(F.col("role") == "user").select("conv_id", F.col("turn"), F.col("text").alias("a"))
    r = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    j = u.join(r, ["conv_id", "turn"])
    pick = G.more_informative("a", "b")
    return j.select("conv_id", "turn", G.informative_score("a").alias("score_a"),
                    G.informative_score("b").alias("score_b"), (pick == F.col("a")).alias("picked_a"))


_ERR = "lower(text)"


def _class_sql() -> str:
    parts = []
    for code, markers in G.ERROR_CLASSES:
        cond = " OR ".join(f"contains({_ERR}, '{m}')" for m in markers)
        parts.append(f"WHEN {cond} THEN '{code}'")
    return ("CASE WHEN coalesce(text, '') = '' THEN NULL " + " ".join(parts) + f" ELSE '{G.GENERIC_ERROR}' END")


@register("error_class", f"""
SELECT {_class_sql()} AS error_code, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1
""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_class_q(Tables(spark, sf_dir).conversations)


@register("status_norm", """
SELECT upper(event_type) AS status,
       CASE WHEN upper(event_type) IN ('SUCCESS', 'SUCCEEDED') THEN 'success'
            WHEN upper(event_type) IN ('NO_DATA', 'NODATA') THEN 'no_data'
            WHEN upper(event_type) IN ('FAILED', 'FAILURE', 'UNKNOWN') THEN 'failed' ELSE 'error' END AS ui_status,
       count(*) AS n
FROM events GROUP BY 1, 2
""")
def status_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_norm_q(Tables(spark, sf_dir).events)


@register("call_metrics", """
SELECT event_type AS purpose, 'dep-' || CAST(user_id % 3 AS VARCHAR) AS deployment, count(*) AS calls, CAST(sum(event_id % 3 + 1) AS BIGINT) AS attempts,
       count(*) FILTER (WHERE value > 45) AS escalations,
       CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS tokens,
       round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.95), 6) AS latency_p95
FROM events GROUP BY 1, 2
""")
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_metrics_q(Tables(spark, sf_dir).events)


@register("usage_sums", """
WITH u AS (SELECT event_type AS purpose, 'dep-' || CAST(user_id % 3 AS VARCHAR) AS deployment, 'total' AS name,
                  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events
           UNION ALL
           SELECT event_type, 'dep-' || CAST(user_id % 3 AS VARCHAR), 'u' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), 1 FROM events)
SELECT purpose, deployment, name, CAST(sum(v) AS BIGINT) AS total FROM u GROUP BY 1, 2, 3 HAVING sum(v) IS NOT NULL
""")
def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_sums_q(Tables(spark, sf_dir).events)


@register("innermost_message", """
SELECT conv_id, turn,
       CAST(length(CASE WHEN len(regexp_extract_all(text, '"message"\\s*:\\s*"([^"]+)"', 1)) > 0
                   THEN regexp_extract_all(text, '"message"\\s*:\\s*"([^"]+)"', 1)[-1] ELSE text END) AS INTEGER) AS message_len
FROM conversations WHERE role = 'assistant'
""")
def innermost_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return innermost_message_q(Tables(spark, sf_dir).conversations)


def _score_sql(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    words = f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> ''))"
    bonus = " OR ".join(f"contains({low}, '{m}')" for m in G.INFORMATIVE_MARKERS)
    return (f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE {words} + CASE WHEN {bonus} THEN 10 ELSE 0 END "
            f"- CASE WHEN contains({low}, 'no value') THEN 5 ELSE 0 END END")


@register("informative", f"""
WITH u AS (SELECT conv_id, turn, text AS a FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, text AS b FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn, a, b FROM u JOIN r ON u.conv_id = r.conv_id AND u.turn = r.turn)
SELECT conv_id, turn, CAST({_score_sql('a')} AS INTEGER) AS score_a, CAST({_score_sql('b')} AS INTEGER) AS score_b,
       CASE WHEN coalesce(a, '') <> '' AND coalesce(b, '') <> '' AND a <> b
            THEN ({_score_sql('a')} >= {_score_sql('b')})
            ELSE coalesce(a, '') <> '' END AS picked_a
FROM j
""")
def informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return informative_q(Tables(spark, sf_dir).conversations)
