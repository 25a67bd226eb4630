"""Log enrichment and log search queries.

``documents`` stands in for the container log table (LogMessage=text,
PodName=source, namespace=lang) and ``events`` for a log with a level column
(LogLevel=event_type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.functions import aggs, enrich as D, predicates as P, timefn as T
from telemark.functions.dynamic import bag_rows, bag_unpack
from telemark.operators import joins as J
from telemark.plans.registry import register
from telemark.sources.tables import Tables


def search_logs(df: DataFrame, text: str, *, has_terms=None, contains=None, prefix=None,
                not_prefix=None, suffix=None, in_list=None, id_or_name=None, between=None, ts=None,
                as_of=None, span=None, order=None, limit=None) -> DataFrame:
    """R-31 filtered log read built from the 2.2 predicates.

    ``in_list`` is ``(column, values, ignore_case)``; ``between`` is
    ``(column, low, high)`` (both ends included); ``id_or_name`` is ``(id column,
    name column, values)`` and keeps rows whose id or name is one of the values.  Plain comparisons reach the
    parquet scan as pushed filters; the text predicates run in codegen.
    """
    out = df
    if ts is not None and as_of is not None:
        out = T.time_scope(out, ts, as_of, span)
    if in_list is not None:
        c, values, ci = in_list
        out = out.filter(P.in_ci(c, values) if ci else F.col(c).isin(list(values)))
    if id_or_name is not None:
        out = out.filter(_id_or_name(out, *id_or_name))
    if between is not None:
        c, lo, hi = between
        out = out.filter(F.col(c).between(lo, hi))
    if has_terms:
        out = out.filter(P.has_any(text, has_terms))
    if contains:
        out = out.filter(P.contains_ci(text, contains))
    if prefix:
        out = out.filter(P.startswith_ci(text, prefix))
    if not_prefix:
        out = out.filter(P.not_startswith_ci(text, not_prefix))
    if suffix:
        out = out.filter(P.endswith_ci(text, suffix))
    if order is not None:
        out = out.orderBy(*order)
    if limit is not None:
        if order is None:
            raise ValueError("take/limit needs an order for repeatable rows")
        out = out.limit(limit)
    return out


def _id_or_name(df: DataFrame, id_col: str, name_col: str, values):
    """Values that are no number cannot be a numeric id; the id column itself is
    not cast, so that the filter still reaches the scan."""
    values = [str(v) for v in values]
    ids = values
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        ids = [int(v) for v in values if v.isascii() and v.isdigit()]
    return F.col(id_col).isin(ids) | F.col(name_col).isin(values)


def error_rate_q(events: DataFrame, as_of="2024-01-31", span="7d") -> DataFrame:
    """R-9 error rate by workload and namespace over a span: D-1 flag, countif, A-19 rate."""
    ev = T.time_scope(events, "ts", as_of, span).withColumn("is_error", D.is_error("event_type"))
    name = F.concat(F.lit("ns-"), (F.col("user_id") % 7).cast("string"))
    out = ev.groupBy(F.col("user_id").alias("workload"), name.alias("namespace")).agg(
        aggs.count_all().alias("total"), aggs.countif(F.col("is_error")).alias("errors"))
    return out.withColumn("error_rate_pct", F.round(P.safe_ratio("errors", "total"), 4))


def mask_secrets_q(documents: DataFrame) -> DataFrame:
    """D-8 secret masking over whole texts, with hits per pattern."""
    masked = D.mask_secrets("text")
    return J.spread(documents).select(
        "doc_id", F.sha2(masked, 256).alias("masked_sha256"), F.length(masked).alias("masked_len"),
        *D.secret_hits("text"))


def log_enrich_q(documents: DataFrame) -> DataFrame:
    """D-2..D-7, D-9 over the log table as one projection."""
    e = D.enrich_logs(J.spread(documents), "text", pod="source")
    return e.select("doc_id", "workload_name", "is_structured", "has_stack_trace", "json_status",
                    "latency_ms", F.length(D.truncate_trace("text")).alias("trace_len"))


def noisy_workloads_q(documents: DataFrame, n: int = 20) -> DataFrame:
    """D-10 volume: log lines per workload, top n."""
    return (documents.groupBy(D.workload_name(None, "source").alias("workload_name"))
                     .agg(aggs.count_all().alias("n_lines"))
                     .orderBy(F.desc("n_lines"), "workload_name").limit(n))


def bag_unpack_props_q(events: DataFrame) -> DataFrame:
    """R-32 JSON log field extraction: ``evaluate bag_unpack(props, 'props_')``."""
    return bag_unpack(events.select("event_id", "props"), "props", ["k"], prefix="props_")


def bag_rows_q(events: DataFrame) -> DataFrame:
    """F-10 / F-11 fields of JSON objects as rows, whatever their names: here
    one number, one string named after the user, one boolean, one null."""
    user = F.concat(F.lit('"u'), (F.col("user_id") % 50).cast("string"), F.lit('":"'), F.col("event_type"), F.lit('"'))
    json = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(","), user, F.lit(',"slow":'), (F.col("value") > 45).cast("string"), F.lit(',"none":null}'))
    return bag_rows(events.select("event_id", json.alias("props")), "props")


_HAS = "(^|[^A-Za-z0-9])({})($|[^A-Za-z0-9])"


@register("error_rate", """
SELECT user_id AS workload, 'ns-' || CAST(user_id % 7 AS VARCHAR) AS namespace, count(*) AS total,
       count(*) FILTER (WHERE lower(event_type) IN ('critical', 'error')) AS errors,
       round(100.0 * count(*) FILTER (WHERE lower(event_type) IN ('critical', 'error'))
             / CASE WHEN count(*) = 0 THEN 1 ELSE count(*) END, 4) AS error_rate_pct
FROM events
WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31 00:00:00'
GROUP BY 1, 2
""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_rate_q(Tables(spark, sf_dir).events)


def _sql_mask(expr: str, upto: int) -> str:
    for p in D.SECRET_PATTERNS[:upto]:
        expr = f"regexp_replace({expr}, '{p}', '[REDACTED]', 'g')"
    return expr


_HITS_SQL = ",\n       ".join(
    f"CAST(len(regexp_extract_all({_sql_mask('text', i)}, '{p}')) AS INTEGER) AS hits_{i + 1}"
    for i, p in enumerate(D.SECRET_PATTERNS))


@register("mask_secrets", f"""
SELECT doc_id, sha256({_sql_mask('text', 4)}) AS masked_sha256,
       CAST(length({_sql_mask('text', 4)}) AS INTEGER) AS masked_len,
       {_HITS_SQL}
FROM documents
""")
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_secrets_q(Tables(spark, sf_dir).documents)


@register("log_enrich", r"""
SELECT doc_id, nullif(source, '') AS workload_name,
       coalesce(len(try(json_keys(text))) > 0, false) AS is_structured,
       (regexp_matches(CASE WHEN try(json_keys(text)) IS NOT NULL THEN coalesce(json_extract_string(text, '$.message'), '') ELSE text END,
                       '(?i)(^|[^A-Za-z0-9])(Exception|Traceback)($|[^A-Za-z0-9])')
        OR contains(lower(CASE WHEN try(json_keys(text)) IS NOT NULL THEN coalesce(json_extract_string(text, '$.message'), '') ELSE text END), ' at ')
        OR coalesce(list_contains(try(json_keys(text)), 'stack'), false)) AS has_stack_trace,
       CASE WHEN try(json_keys(text)) IS NOT NULL AND coalesce(json_extract_string(text, '$.status'), '') <> ''
            THEN json_extract_string(text, '$.status') ELSE '' END AS json_status,
       TRY_CAST(nullif(regexp_extract(CASE WHEN try(json_keys(text)) IS NOT NULL THEN coalesce(json_extract_string(text, '$.message'), '') ELSE text END,
                                      'latency[=:]\s?([0-9]+)ms', 1), '') AS INTEGER) AS latency_ms,
       CAST(length(CASE WHEN len(string_split(text, chr(10))) > 40
                   THEN array_to_string(list_slice(string_split(text, chr(10)), 1, 40), chr(10)) || chr(10) || '[TRUNCATED]'
                   ELSE text END) AS INTEGER) AS trace_len
FROM documents
""")
def log_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_enrich_q(Tables(spark, sf_dir).documents)


@register("noisy_workloads", """
SELECT nullif(source, '') AS workload_name, count(*) AS n_lines FROM documents
GROUP BY 1 ORDER BY n_lines DESC, workload_name ASC LIMIT 20
""")
def noisy_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_workloads_q(Tables(spark, sf_dir).documents)


@register("search_logs", f"""
SELECT doc_id, lang, n_chars FROM documents
WHERE lower(lang) IN ('en', 'de', 'fr') AND n_chars BETWEEN 100 AND 200000
  AND regexp_matches(text, '(?i){_HAS.format('token|License')}')
  AND NOT coalesce(starts_with(lower(text), 'the'), false)
""")
def search_logs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    out = search_logs(docs, "text", has_terms=["token", "License"], not_prefix="the",
                      in_list=("lang", ["EN", "de", "Fr"], True), between=("n_chars", 100, 200000))
    return out.select("doc_id", "lang", "n_chars")


@register("has_term", f"""
SELECT doc_id, source, contains(lower(text), 'example') AS contains_example
FROM documents WHERE regexp_matches(text, '(?i){_HAS.format('example')}')
""")
def has_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    return docs.filter(P.has("text", "example")).select(
        "doc_id", "source", P.contains_ci("text", "example").alias("contains_example"))


@register("bag_rows", """
SELECT event_id, 'id' AS key, 'number' AS kind, CAST(event_id AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'u' || CAST(user_id % 50 AS VARCHAR), 'string', event_type FROM events
UNION ALL SELECT event_id, 'slow', 'boolean', CAST(value > 45 AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'none', 'null', NULL FROM events
""")
def bag_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_rows_q(Tables(spark, sf_dir).events)


@register("bag_unpack_props", """
SELECT event_id, json_extract_string(props, '$.k') AS props_k FROM events
""")
def bag_unpack_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_unpack_props_q(Tables(spark, sf_dir).events)


@register("search_text", """
SELECT doc_id, source, n_chars FROM documents
WHERE contains(lower(text), 'licen') AND ends_with(lower(text), '.') AND NOT starts_with(lower(text), 'released')
""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-31 substring / suffix / negated prefix reads (case-insensitive)."""
    docs = Tables(spark, sf_dir).documents
    out = search_logs(docs, "text", contains="licen", suffix=".", not_prefix="released")
    return out.select("doc_id", "source", "n_chars")
