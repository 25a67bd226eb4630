"""Text labels for prompts and query texts.

Every label is a column expression over the whole text: keyword hits are
substring tests, patterns are Java regexes, and precedence is a ``when``
chain, so labelling a corpus is one projection.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemark.functions._col import col

# Fixed values (T-9): container-domain keywords, in the reference's order.
CONTAINER_KEYWORDS = (
    "container", "containerlogv2", "pod", "namespace", "kube", "crashloop", "crashloopbackoff", "stderr",
    "latency", "stack trace", "image", "workload", "latencyms", "containerlog", "kubernetes", "k8s",
    "daemonset", "statefulset", "deployment", "pods", "namespaces", "containers", "restart", "restarts",
    "pending", "schedule", "scheduling",
)
# Fixed values (T-9): application-domain keywords.
APP_KEYWORDS = (
    "application", "applications", "app", "apps", "trace", "traces", "apptraces", "request", "requests",
    "apprequests", "dependency", "dependencies", "appdependencies", "exception", "exceptions",
    "appexceptions", "customevent", "customevents",
)
# Fixed values (T-9): table-name patterns that are strong domain signals.
CONTAINER_TABLE_PATTERN = (r"(?i)\b(containerlogv2|containerlog|kubepodinventory|kube[pP]od|insightsmetrics"
                           r"|containerinventory|kubeevents?)\b")
APP_TABLE_PATTERN = r"(?i)\b(apprequests|appexceptions|apptraces|appdependencies|apppageviews|appcustomevents)\b"

# Fixed values (T-10): time phrase pattern and unit suffixes; weeks become days.
TIME_PATTERN = r"(?i)(last|past)\s+(\d+)\s+(minute|minutes|hour|hours|day|days|week|weeks)"
COUNT_TERMS = ("count", "number", "total", "how many")
RATE_TERMS = ("rate", "per second", "throughput", "percent", "percentage", "ratio")
DURATION_TERMS = ("duration", "latency", "time taken", "response time")

# Fixed values (T-11): keyword -> context note, in order; notes are de-duplicated.
CONTEXT_NOTES = (
    ("error", "Errors classified via LogLevel CRITICAL/ERROR or stderr stream."),
    ("latency", "Latency extracted with regex latency[=:]([0-9]+)ms into LatencyMs."),
    ("slow", "Latency extracted with regex latency[=:]([0-9]+)ms into LatencyMs."),
    ("crash", "Crash loops require join with KubePodInventory restart counts."),
    ("restart", "Crash loops require join with KubePodInventory restart counts."),
    ("stack", "Stack traces detected if message contains Exception, Traceback, or ' at '."),
    ("trace", "Stack traces detected if message contains Exception, Traceback, or ' at '."),
    ("status", "If LogMessage dynamic has field 'status', filter with tostring(LogMessage.status)."),
    ("500", "Structured status filter example: where tostring(LogMessage.status)=='500'"),
    ("noisy", "Noisy container detection = count lines per container or workload."),
    ("volume", "High volume logs -> aggregate by WorkloadName then count()."),
)

# Fixed values (T-19): substrings that mark a query as time-bounded.
TIME_FILTER_MARKERS = ("timegenerated >", "timegenerated >=", "timegenerated between", "ago(", "startofday(",
                       "endofday(", "startofweek(", "endofweek(", "startofmonth(", "endofmonth(",
                       "datetime(", "now()")


def _hits(text: Column, words, whole_token: bool) -> Column:
    if whole_token:
        return reduce(lambda a, b: a | b,
                      [text.rlike(r"(^|[^a-z0-9])" + re.escape(w) + r"($|[^a-z0-9])") for w in words])
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def domain_label(c, whole_token: bool = False) -> Column:
    """T-9 domain of a question: 'containers' or 'appinsights'.

    Exclusive keyword hits decide; on a conflict a container table name or
    "pod(s) ... pending" wins for containers, else appinsights; no hit at all
    defaults to appinsights.  ``whole_token=True`` matches keywords as whole
    tokens (the reference matches substrings, so "app" hits "happen")."""
    q = F.lower(F.coalesce(col(c), F.lit("")))
    strong = q.rlike(CONTAINER_TABLE_PATTERN) | (F.contains(q, F.lit("pod")) & F.contains(q, F.lit("pending")))
    cont = _hits(q, CONTAINER_KEYWORDS, whole_token) | strong
    app = _hits(q, APP_KEYWORDS, whole_token) | q.rlike(APP_TABLE_PATTERN)
    return (F.when(cont & ~app, "containers").when(app & ~cont, "appinsights")
             .when(cont & app & strong, "containers").otherwise("appinsights"))


def time_window(c) -> Column:
    """T-10 time window of a question ('30m', '2h', '14d', '' when none)."""
    q = F.lower(F.coalesce(col(c), F.lit("")))
    qty = F.regexp_extract(q, TIME_PATTERN, 2)
    unit = F.regexp_extract(q, TIME_PATTERN, 3)
    n = qty.try_cast("bigint")
    is_week = F.startswith(unit, F.lit("week"))
    n = F.when(is_week, n * 7).otherwise(n)
    suffix = (F.when(F.startswith(unit, F.lit("minute")), "m").when(F.startswith(unit, F.lit("hour")), "h")
              .otherwise("d"))
    matched = F.concat(n.cast("string"), suffix)
    return (F.when(qty != "", matched)
             .when(F.contains(q, F.lit("last hour")) | F.contains(q, F.lit("past hour")), "1h")
             .when(F.contains(q, F.lit("last day")) | F.contains(q, F.lit("past day")) | F.contains(q, F.lit("today")), "1d")
             .when(F.contains(q, F.lit("last 30 minutes")) | F.contains(q, F.lit("past 30 minutes")), "30m")
             .otherwise(""))


def metric_intent(c) -> Column:
    """T-10 metric mode and the term that set it, as a struct."""
    q = F.lower(F.coalesce(col(c), F.lit("")))

    def first(terms):
        out = None
        for t in terms:
            cond = F.contains(q, F.lit(t))
            out = F.when(cond, F.lit(t)) if out is None else out.when(cond, F.lit(t))
        return out

    cnt, rate, dur = first(COUNT_TERMS), first(RATE_TERMS), first(DURATION_TERMS)
    mode = F.when(cnt.isNotNull(), "count").when(rate.isNotNull(), "rate").when(dur.isNotNull(), "duration") \
            .otherwise("unknown")
    hint = F.coalesce(cnt, rate, dur, F.lit(""))
    ec, er = F.contains(q, F.lit("error count")), F.contains(q, F.lit("error rate"))
    mode2 = F.when(ec, "count").when(er & (mode != "count"), "rate").otherwise(mode)
    hint2 = F.when(ec, "error count").when(er & (mode != "count"), "error rate").otherwise(hint)
    return F.struct(mode2.alias("metric_mode"), hint2.alias("raw_metric_hint"))


def context_notes(c) -> Column:
    """T-11 context notes for the keywords present, distinct, in order."""
    q = F.lower(F.coalesce(col(c), F.lit("")))
    notes = F.array(*[F.when(F.contains(q, F.lit(k)), F.lit(v)) for k, v in CONTEXT_NOTES])
    return F.array_distinct(F.filter(notes, lambda x: x.isNotNull()))


def has_time_bound(c) -> Column:
    """T-19 the query text carries its own time filter."""
    q = F.lower(F.coalesce(col(c), F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(q, F.lit(m)) for m in TIME_FILTER_MARKERS])


def default_span_hours(c, default: int = 24) -> Column:
    """T-19 / S-2 the span applied to a query without a time bound (null when bounded)."""
    return F.when(has_time_bound(c), F.lit(None).cast("int")).otherwise(F.lit(default))


def lookback_days(c) -> Column:
    """T-19 the largest ``ago(N<unit>)`` of a query text in days (null if none)."""
    q = F.lower(F.coalesce(col(c), F.lit("")))
    spans = F.regexp_extract_all(q, F.lit(r"ago\(\s*(\d+(?:\.\d+)?)\s*(d|h|m|s)\s*\)"), 0)

    def days(s):
        n = F.regexp_extract(s, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
        u = F.regexp_extract(s, r"(\d+(?:\.\d+)?)\s*(d|h|m|s)", 2)
        return n / F.when(u == "d", 1.0).when(u == "h", 24.0).when(u == "m", 1440.0).otherwise(86400.0)

    return F.array_max(F.transform(spans, days))


def audit_time_bounds(df, query: str, max_days: float = 7.0):
    """T-19 query-log audit, one row a query text: whether it bounds time itself,
    the default span it would get otherwise, its largest look-back in days and
    whether that is over ``max_days``.  A text without ``ago`` is not over it."""
    days = lookback_days(query)
    return df.withColumns({"bounded": has_time_bound(query), "default_span_hours": default_span_hours(query), "lookback_days": days,
                           "over_limit": F.coalesce(days > F.lit(float(max_days)), F.lit(False))})
