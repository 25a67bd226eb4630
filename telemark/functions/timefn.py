"""Time functions.

Every function takes an explicit ``as_of`` instead of wall-clock ``now()`` so
runs repeat.  Buckets are epoch-aligned and returned as ``timestamp_ntz`` (UTC
wall clock) for either input flavour; the session time zone is UTC.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemark.functions._col import col

# Span literals of the query language: number + unit.
_UNIT_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400}
_SPAN_RE = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|min|m|h|d)\s*$")
_WORDS = {"second": "s", "seconds": "s", "minute": "m", "minutes": "m", "hour": "h",
          "hours": "h", "day": "d", "days": "d"}


def span_seconds(span) -> float:
    """Parse ``'15m'``, ``'1h'``, ``'7d'``, ``'30 minutes'`` or a number of seconds."""
    if isinstance(span, (int, float)):
        return float(span)
    if isinstance(span, _dt.timedelta):
        return span.total_seconds()
    s = span.strip().lower()
    m = re.match(r"^(\d+(?:\.\d+)?)\s+([a-z]+)$", s)
    if m and m.group(2) in _WORDS:
        s = m.group(1) + _WORDS[m.group(2)]
    m = _SPAN_RE.match(s)
    if not m:
        raise ValueError(f"bad span {span!r}")
    return float(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def as_timestamp(as_of) -> Column:
    """Literal timestamp_ntz for ``as_of`` (a datetime or ISO string)."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return F.lit(as_of).cast("timestamp_ntz")


def _interval(seconds: float) -> Column:
    micros = int(round(seconds * 1_000_000))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(micros / 1_000_000))


def ago(span, as_of) -> Column:
    """TM-1 ``ago(span)`` relative to ``as_of``."""
    return as_timestamp(as_of) - _interval(span_seconds(span))


def shift(ts, span) -> Column:
    return col(ts) + _interval(span_seconds(span))


def bin_time(ts, span) -> Column:
    """TM-2 ``bin(ts, span)``: floor to an epoch-aligned bucket; null stays null.

    Expressed as arithmetic on epoch microseconds so it codegens and keeps null
    groups (``window()`` would drop them).
    """
    step = int(round(span_seconds(span) * 1_000_000))
    c = col(ts)
    micros = F.unix_micros(c.cast("timestamp"))
    floored = micros - F.pmod(micros, F.lit(step))
    return F.timestamp_micros(floored).cast("timestamp_ntz")


def start_of_day(ts, offset_days: int = 0) -> Column:
    """TM-3 ``startofday(ts[, offset])``."""
    c = F.date_trunc("day", col(ts)).cast("timestamp_ntz")
    return c if not offset_days else c + F.make_dt_interval(F.lit(offset_days))


def end_of_day(ts, offset_days: int = 0) -> Column:
    """TM-3 ``endofday``: next day's start minus one microsecond."""
    return start_of_day(ts, offset_days + 1) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))


def start_of_week(ts) -> Column:
    """TM-6; weeks start on Sunday as in the query language."""
    c = col(ts)
    d = F.to_date(c)
    return F.date_sub(d, F.dayofweek(d) - 1).cast("timestamp_ntz")


def start_of_month(ts) -> Column:
    return F.date_trunc("month", col(ts)).cast("timestamp_ntz")


def end_of_week(ts) -> Column:
    """TM-6: last microsecond of the week (Saturday)."""
    return start_of_week(ts) + F.make_dt_interval(F.lit(6), F.lit(23), F.lit(59), F.lit(59.999999))


def end_of_month(ts) -> Column:
    """TM-6: last microsecond of the month."""
    return start_of_month(ts) + F.make_ym_interval(F.lit(0), F.lit(1)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))


def diff_hours(a, b) -> Column:
    """TM-4 ``(a - b) / 1h`` as a double."""
    return (F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))) / F.lit(3.6e9)


def diff_in(a, b, span) -> Column:
    """``(a - b) / span`` as a double."""
    step = span_seconds(span) * 1e6
    return (F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))) / F.lit(step)


def datetime_diff(unit: str, a, b) -> Column:
    """TM-5 ``datetime_diff(unit, a, b)``: unit boundaries crossed from b to a."""
    unit = unit.lower()
    trunc = {"minute": "minute", "hour": "hour", "day": "day", "second": "second"}[unit]
    step = {"minute": 60e6, "hour": 3.6e9, "day": 8.64e10, "second": 1e6}[unit]
    ta = F.unix_micros(F.date_trunc(trunc, col(a).cast("timestamp")))
    tb = F.unix_micros(F.date_trunc(trunc, col(b).cast("timestamp")))
    return ((ta - tb) / F.lit(step)).cast("bigint")


def time_scope(df, ts: str, as_of, span="24h"):
    """S-2 time-scoped scan: keep ``ts > as_of - span`` (and ``<= as_of``).

    ``span=None`` opts out.  The predicate is a plain comparison so it reaches
    the parquet scan as a pushed filter and prunes date partitions.
    """
    if span is None:
        return df
    return df.filter((col(ts) > ago(span, as_of)) & (col(ts) <= as_timestamp(as_of)))


def to_datetime(c, fmt: str | None = None) -> Column:
    """F-3 ``todatetime(s)``: null when the text does not parse."""
    return F.try_to_timestamp(col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(col(c))


def datetime_lit(s: str) -> Column:
    """F-3 ``datetime(2024-01-01 10:00)`` literal."""
    return as_timestamp(s)
