"""Log enrichment columns, each ``Column -> Column``.

They mirror the reusable log functions of the query language: error flag,
workload name, plain text, latency, structured flag, stack-trace flag, JSON
status, secret masking and stack-trace truncation.  All are JVM built-ins
(regex, JSON path, higher-order functions), so an enrichment pass is one
codegen'd projection over the log table, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemark.functions._col import col
from telemark.functions.predicates import coalesce_nonempty, has_any, in_ci

# Fixed values that must equal the reference's for equal results.
# Error levels (D-1), compared ignoring case:
ERROR_LEVELS = ("CRITICAL", "ERROR")
# Stack-trace markers (D-6), matched as terms; " at " as a plain substring:
STACK_MARKERS = ("Exception", "Traceback", " at ")
# Label keys tried in order for the workload name (D-2):
WORKLOAD_LABEL_KEYS = ("app.kubernetes.io/name", "app", "service")
# Latency pattern (D-4), group 1 is the number of milliseconds:
LATENCY_PATTERN = r"latency[=:]\s?([0-9]+)ms"
# Secret patterns (D-8), applied in this order, each match replaced by [REDACTED]:
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"Bearer\s+[A-Za-z0-9-_.]+",
    r"-----BEGIN [A-Z ]+-----[\s\S]+?-----END [A-Z ]+-----",
    r"(?i)api[_-]?key[:=]\s*[A-Za-z0-9-_]{10,}",
)
REDACTED = "[REDACTED]"
# Stack traces longer than this many lines are cut and marked (D-9):
TRACE_MAX_LINES = 40
TRACE_MARK = "[TRUNCATED]"


def is_error(level, source=None) -> Column:
    """D-1 ``LogLevel in~ ('CRITICAL','ERROR') or LogSource == 'stderr'``."""
    c = F.coalesce(in_ci(level, ERROR_LEVELS), F.lit(False))
    if source is not None:
        c = c | F.coalesce(col(source) == F.lit("stderr"), F.lit(False))
    return c


def labels_map(labels) -> Column:
    """Parse a JSON label bag into ``map<string,string>`` (null when not JSON)."""
    return F.from_json(col(labels), "map<string,string>")


def workload_name(labels, pod, container=None) -> Column:
    """D-2 first non-empty of label name, app, service, pod (, container)."""
    m = labels_map(labels) if labels is not None else None
    parts = [m[k] for k in WORKLOAD_LABEL_KEYS] if m is not None else []
    parts.append(col(pod))
    if container is not None:
        parts.append(col(container))
    return coalesce_nonempty(*parts)


def is_json_object(msg) -> Column:
    """True when the text parses as a JSON object (``typeof(msg) == 'dynamic'``)."""
    return F.json_object_keys(col(msg)).isNotNull()


def plain_text(msg) -> Column:
    """D-3 the string body, or the ``message`` field of a JSON body ('' if absent)."""
    m = col(msg)
    return F.when(is_json_object(m), F.coalesce(F.get_json_object(m, "$.message"), F.lit(""))).otherwise(m)


def latency_ms(msg) -> Column:
    """D-4 ``toint(extract('latency[=:]\\s?([0-9]+)ms', 1, plain))``."""
    return F.nullif(F.regexp_extract(plain_text(msg), LATENCY_PATTERN, 1), F.lit("")).try_cast("int")


def is_structured(msg) -> Column:
    """D-5 a JSON object with at least one key."""
    return F.coalesce(F.size(F.json_object_keys(col(msg))) > 0, F.lit(False))


def has_stack_trace(msg) -> Column:
    """D-6 stack markers in the plain text, or a JSON key ``stack``."""
    keys = F.json_object_keys(col(msg))
    return has_any(plain_text(msg), STACK_MARKERS) | F.coalesce(F.array_contains(keys, "stack"), F.lit(False))


def json_status(msg) -> Column:
    """D-7 the JSON ``status`` field as text, '' when absent or not JSON."""
    m = col(msg)
    s = F.get_json_object(m, "$.status")
    return F.when(is_json_object(m) & s.isNotNull() & (s != ""), s).otherwise(F.lit(""))


def mask_secrets(text) -> Column:
    """D-8 chained replacement of every secret pattern by ``[REDACTED]``."""
    out = col(text)
    for p in SECRET_PATTERNS:
        out = F.regexp_replace(out, p, REDACTED)
    return out


def secret_hits(text) -> list[Column]:
    """Matches per pattern, counted on the text as masked by the earlier patterns."""
    out, cur = [], col(text)
    for i, p in enumerate(SECRET_PATTERNS):
        out.append(F.size(F.regexp_extract_all(cur, F.lit(p), 0)).alias(f"hits_{i + 1}"))
        cur = F.regexp_replace(cur, p, REDACTED)
    return out


def truncate_trace(text, max_lines: int = TRACE_MAX_LINES) -> Column:
    """D-9 keep the first ``max_lines`` lines and append ``[TRUNCATED]``."""
    t = col(text)
    lines = F.split(t, "\n")
    return F.when(F.size(lines) > max_lines,
                  F.concat(F.concat_ws("\n", F.slice(lines, 1, max_lines)), F.lit("\n" + TRACE_MARK))).otherwise(t)


def enrich_logs(df, message: str, level: str | None = None, source: str | None = None,
                labels: str | None = None, pod: str | None = None, container: str | None = None):
    """Apply D-1..D-7 to a log table as one projection."""
    out = df.withColumns({
        "plain_text": plain_text(message),
        "is_structured": is_structured(message),
        "has_stack_trace": has_stack_trace(message),
        "json_status": json_status(message),
        "latency_ms": latency_ms(message),
    })
    if level is not None or source is not None:
        out = out.withColumn("is_error", is_error(level if level else F.lit(None).cast("string"), source))
    if pod is not None:
        out = out.withColumn("workload_name", workload_name(labels, pod, container))
    return out
