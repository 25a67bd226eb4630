"""Filter predicates and scalar helpers of the pipe-style query language.

Decisions: ``==``/``!=``/``in`` are case-sensitive; ``contains``, ``startswith``,
``endswith``, ``has`` and ``in~`` ignore case.  Negated string predicates keep
rows whose value is null (a null value does not start with anything).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemark.functions._col import col

# A "term" is a maximal run of ASCII letters and digits.
_TERM_EDGE_L = "(^|[^A-Za-z0-9])"
_TERM_EDGE_R = "($|[^A-Za-z0-9])"


def is_not_empty(c) -> Column:
    """P-15 ``isnotempty``: not null and not the empty string."""
    c = col(c)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def is_empty(c) -> Column:
    c = col(c)
    return c.isNull() | (c.cast("string") == F.lit(""))


def not_equal_keep_null(c, value) -> Column:
    """P-3 ``!=`` where a null value counts as different (keeps the row)."""
    return ~col(c).eqNullSafe(F.lit(value))


def in_ci(c, values) -> Column:
    """P-7 ``in~``: case-insensitive list membership."""
    return F.lower(col(c)).isin([v.lower() for v in values])


def contains_ci(c, value: str) -> Column:
    """P-9 ``contains``: case-insensitive substring."""
    return F.contains(F.lower(col(c)), F.lit(value.lower()))


def startswith_ci(c, value: str) -> Column:
    """P-10 ``startswith``."""
    return F.startswith(F.lower(col(c)), F.lit(value.lower()))


def not_startswith_ci(c, value: str) -> Column:
    """P-10 ``!startswith``: nulls are kept."""
    return F.coalesce(~startswith_ci(c, value), F.lit(True))


def endswith_ci(c, value: str) -> Column:
    """P-11 ``endswith``."""
    return F.endswith(F.lower(col(c)), F.lit(value.lower()))


def has_pattern(term: str) -> str:
    """Java regex for the ``has`` whole-term test of one term."""
    return "(?i)" + _TERM_EDGE_L + re.escape(term) + _TERM_EDGE_R


def has(c, term: str) -> Column:
    """P-12 ``has``: ``term`` occurs as a whole alphanumeric term, any case."""
    return col(c).rlike(has_pattern(term))


def has_any(c, terms) -> Column:
    """P-13 ``has_any``: one alternation regex over the plain terms; terms that
    contain non-alphanumeric characters (such as ``" at "``) use a plain
    case-insensitive substring test, as their edges are not term edges."""
    plain = [t for t in terms if re.fullmatch(r"[A-Za-z0-9]+", t)]
    other = [t for t in terms if t not in plain]
    conds = []
    if plain:
        alt = "|".join(re.escape(t) for t in plain)
        conds.append(col(c).rlike("(?i)" + _TERM_EDGE_L + "(" + alt + ")" + _TERM_EDGE_R))
    for t in other:
        conds.append(contains_ci(c, t))
    if not conds:
        return F.lit(False)
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


def strcat(*cols) -> Column:
    """F-1 ``strcat``: concatenation where null parts count as ''."""
    return F.concat(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])


def coalesce_nonempty(*cols) -> Column:
    """F-5 ``coalesce`` that skips empty strings as well as nulls."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in cols])


def iff(cond: Column, a, b) -> Column:
    """F-6 ``iff``."""
    return F.when(cond, a).otherwise(b)


def extract(regex: str, group: int, c) -> Column:
    """F-7 ``extract``: regex group, null when there is no match."""
    return F.nullif(F.regexp_extract(col(c), regex, group), F.lit(""))


def to_long(c) -> Column:
    return col(c).try_cast("bigint")


def to_double(c) -> Column:
    """F-2 ``todouble``: null on failure (ANSI mode would raise on ``cast``)."""
    return col(c).try_cast("double")


def to_int(c) -> Column:
    return col(c).try_cast("int")


def safe_ratio(num, den, scale: float = 100.0) -> Column:
    """A-19 rate with a zero guard: ``scale * num / den``, den 0 -> 1."""
    d = col(den)
    return F.lit(scale) * col(num) / F.when(d == 0, F.lit(1)).otherwise(d)


def clamp01(c) -> Column:
    """F-19 clamp to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def truncate(c, n: int, suffix: str = "...TRUNCATED...") -> Column:
    """F-18 truncate with a suffix when longer than ``n``."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(suffix))).otherwise(c)


def sha256_prefix(c, n: int = 16) -> Column:
    """F-15 hex SHA-256 prefix of the UTF-8 text."""
    return F.left(F.sha2(col(c), 256), F.lit(n))
