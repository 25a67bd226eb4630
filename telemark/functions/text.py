"""Text functions for query texts, prompts and model responses.

All are regex / string built-ins evaluated on the whole text.
"""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemark.functions._col import col

# Keywords lower-cased by the text fingerprint (T-12), in order.
FINGERPRINT_KEYWORDS = ("where", "project", "summarize", "extend", "join", "order by", "take", "top",
                        "union", "let", "parse", "parse_json", "make-series", "render", "bin", "by")
# Phrases that mark a model answer as an error (T-16).
ERROR_PHRASES = ("an error occurred", "error: ", "unable to", "cannot ", "can't ", "i cannot", "i can't",
                 "sorry", "apologize", "could not")
# Markers of a failed generation in a stored query text (T-16).
GENERATION_ERROR_MARKERS = ("// Error", "Error:", "Error translating NL to KQL",
                            "Could not translate question to KQL")
# Words that ask for an explanation (T-18).
EXPLANATION_WORDS = ("why", "explain", "describe", "root cause", "reason")


def _any_contains(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# The whitespace set of the regex class \s: blank, tab, newline, vertical tab,
# form feed, carriage return.
_WS = " \t\n\x0b\x0c\r"


def strip_ws(c) -> Column:
    """``strip()`` of leading and trailing whitespace (the \\s set), as a
    character trim rather than a regex."""
    return F.btrim(col(c), F.lit(_WS))


def collapse_ws(c) -> Column:
    """F-13 collapse whitespace runs to one blank and trim."""
    return strip_ws(F.regexp_replace(col(c), r"\s+", " "))


def tokens(c) -> Column:
    """F-14 / T-3 token set: lower-case, split on non-alphanumerics, drop
    tokens of one character, distinct."""
    parts = F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 1))


def normalize_query(c) -> Column:
    """T-1 query-text normalise: drop ``//`` and ``/* */`` comments, join lines,
    collapse blanks, trim."""
    q = F.regexp_replace(col(c), r"//.*?(?=\n|$)", "")
    q = F.regexp_replace(q, r"(?s)/\*.*?\*/", "")
    q = F.regexp_replace(q, r"[\r\n]+", " ")
    q = F.regexp_replace(q, r"\s+", " ")
    return strip_ws(q)


def fingerprint_text(c) -> Column:
    """T-12 normalised text for query-log grouping: drop ``// meta`` lines,
    collapse blanks, single to double quotes, lower-case keywords, drop
    ``desc``, remove blanks around ``, | = == != <= >= < >``."""
    s = F.regexp_replace(col(c), r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?im)^[ \t\x0B\f\r]*//[ \t\x0B\f\r]*meta[^\n]*(\n|$)", "")
    s = F.regexp_replace(s, "\n", " ")
    s = strip_ws(F.regexp_replace(s, r"\s+", " "))
    s = F.replace(s, F.lit("'"), F.lit('"'))
    for kw in FINGERPRINT_KEYWORDS:
        s = F.regexp_replace(s, r"(?i)\b" + kw.replace("-", r"\-") + r"\b", kw)
    s = F.regexp_replace(s, r"(?i)\s+desc\b", "")
    for op, rep in ((",", ","), (r"\|", "|"), ("=", "="), ("==", "=="), ("!=", "!="), ("<=", "<="),
                    (">=", ">="), ("<", "<"), (">", ">")):
        s = F.regexp_replace(s, r"\s*" + op + r"\s*", rep)
    return s


def fingerprint(c, n: int = 16) -> Column:
    """T-12 fingerprint: hex SHA-256 prefix of the normalised text."""
    return F.left(F.sha2(fingerprint_text(c), 256), F.lit(n))


def edit_diff(a, b, threshold: int | None = None) -> Column:
    """T-13 length and edit-distance difference of two texts."""
    lev = F.levenshtein(col(a), col(b), threshold) if threshold is not None else F.levenshtein(col(a), col(b))
    return F.struct(F.length(col(a)).alias("len_expected"), F.length(col(b)).alias("len_generated"),
                    lev.alias("levenshtein"))


def clean_response(c) -> Column:
    """T-15 model response clean-up: code fences removed, runs of 3+ newlines
    collapsed to 2, trailing blanks of each line removed, trimmed."""
    s = strip_ws(F.regexp_replace(col(c), r"```[a-zA-Z0-9]*\n|```", ""))
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, r"[ \t\x0B\f\r]+(?=\n|$)", "")
    return strip_ws(s)


def validity_label(c) -> Column:
    """T-16 output validity of a generated query text: 'generation_error'
    (stored error marker), 'empty' (under 5 characters), 'leading_dot',
    'error_response' (apology / error phrase) or 'valid'."""
    raw = F.coalesce(col(c), F.lit(""))
    t = strip_ws(raw)
    low = F.lower(t)
    return (F.when(_any_contains(t, GENERATION_ERROR_MARKERS), "generation_error")
             .when(F.length(t) < 5, "empty")
             .when(F.startswith(t, F.lit(".")), "leading_dot")
             .when(_any_contains(low, ERROR_PHRASES), "error_response")
             .otherwise("valid"))


def normalize_code(c) -> Column:
    """T-17 code normalise for dedup: CRLF to LF, trim, no blank lines."""
    s = F.regexp_replace(col(c), r"\r\n?", "\n")
    s = strip_ws(s)
    return F.regexp_replace(s, r"\n{2,}", "\n")


def wants_explanation(c) -> Column:
    """T-18 the prompt asks for an explanation."""
    return _any_contains(F.lower(F.coalesce(col(c), F.lit(""))), EXPLANATION_WORDS)


def strip_tags(c) -> Column:
    """F-20 drop HTML tags, decode character references (a no-break space as a
    blank), collapse blanks."""
    s = F.regexp_replace(col(c), "<[^>]+>", "")
    return collapse_ws(F.translate(unescape_entities(s), "\u00a0", " "))


# A character reference: decimal, hexadecimal, or a name of up to 32 characters.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_LOW = 0xA0     # code points below this have rules of their own (controls, the Windows block)


def _constant(value, schema: str) -> Column:
    """A table as one literal: constant folding reads the JSON once a plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _code_point(n: Column) -> Column:
    """Text of a numeric reference, by the rules of HTML 5."""
    low = _constant([html.unescape(f"&#{i};") for i in range(_LOW)], "array<string>")
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
             .when(n < _LOW, F.get(low, n.cast("int")))
             .when(n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFF)) >= 0xFFFE), "")
             .when(n == 0xFEFF, "\ufeff")           # decoding would take it for a byte order mark
             .otherwise(char))


def unescape_entities(c) -> Column:
    """Decode all character references: numeric ones, and every HTML 5 name, also
    those that are known without the semicolon.  The text is cut at the references
    once and joined again around what they stand for, so nothing is decoded twice."""
    s = col(c)
    by_start: dict = {}
    for name, text in html.entities.html5.items():
        by_start.setdefault(name[:2], {})[name] = text
    names = _constant(by_start, "map<string,map<string,string>>")
    open_ended = max(len(n) for n in html.entities.html5 if not n.endswith(";"))

    def known(name):
        return F.try_element_at(F.try_element_at(names, F.left(name, F.lit(2))), name)

    def named(m):
        name = F.substring(m, 2, 64)
        starts = [F.when(F.length(name) > k, F.concat(known(F.left(name, F.lit(k))), F.substring(name, k + 1, 64))) for k in range(open_ended, 1, -1)]
        return F.coalesce(known(name), *starts, m)

    def numeric(m):
        hexa = F.lower(F.substring(m, 3, 1)) == "x"
        digits = F.regexp_extract(m, "&#[xX]?0*([0-9a-fA-F]*)", 1)
        fits = F.when(digits == "", "0").when(F.length(digits) <= 10, digits)       # longer ones are beyond any code point
        return _code_point(F.when(hexa, F.conv(fits, 16, 10)).otherwise(fits).cast("long"))

    gaps = F.split(s, _REFERENCE, -1)
    refs = F.regexp_extract_all(s, F.lit(_REFERENCE), F.lit(0))
    texts = F.transform(refs, lambda m: F.when(F.startswith(m, F.lit("&#")), numeric(m)).otherwise(named(m)))
    whole = F.array_join(F.zip_with(gaps, texts, lambda gap, text: F.concat(gap, F.coalesce(text, F.lit("")))), "")
    return F.when(F.contains(s, F.lit("&")), whole).otherwise(s)


# Fixed values (T-14): aggregate function names recognised in query texts.
AGGREGATE_FUNCTIONS = ("count", "countif", "dcount", "dcountif", "sum", "sumif", "avg", "min", "max",
                       "percentile", "percentiles", "arg_max", "arg_min", "make_set", "make_list")


def query_features(q) -> Column:
    """T-14 structural features of a query text: source tables (first token
    and tokens after ``join``/``union``), number of ``where`` clauses,
    aggregate functions used, group-by columns."""
    s = F.coalesce(col(q), F.lit(""))
    first = F.regexp_extract(s, r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
    joined = F.regexp_extract_all(s, F.lit(r"(?i)\b(?:join|union)\b[^|(]*?\(?\s*([A-Za-z_][A-Za-z0-9_]*)"), 1)
    tables = F.array_distinct(F.filter(F.concat(F.array(first), joined),
                                       lambda t: (t != "") & ~F.lower(t).isin("kind", "hint", "withsource")))
    n_where = F.size(F.regexp_extract_all(s, F.lit(r"(?i)\|\s*where\b"), 0))
    alts = "|".join(sorted(AGGREGATE_FUNCTIONS, key=len, reverse=True))
    aggs = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"(?i)\b(" + alts + r")\s*\("), 1), F.lower))
    by = F.regexp_extract(s, r"(?is)\bsummarize\b.*?\bby\b([^|]+)", 1)
    gb = F.filter(F.transform(F.split(by, ","), lambda x: F.lower(F.regexp_extract(x, r"([A-Za-z_][A-Za-z0-9_.]*)", 1))),
                  lambda x: x != "")
    return F.struct(tables.alias("tables"), n_where.alias("n_where"), aggs.alias("aggregates"),
                    F.array_distinct(gb).alias("group_by"))


def _jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def structural_similarity(q1, q2) -> Column:
    """T-14 similarity 0.4 tables + 0.3 filters + 0.3 aggregations (the
    documented split; the filter part compares where-clause counts)."""
    a, b = query_features(q1), query_features(q2)
    lower = lambda arr: F.transform(arr, F.lower)
    tables = _jaccard(lower(a["tables"]), lower(b["tables"]))
    na, nb = a["n_where"], b["n_where"]
    filt = F.when(F.greatest(na, nb) == 0, F.lit(1.0)).otherwise(1.0 - F.abs(na - nb) / F.greatest(na, nb))
    return F.lit(0.4) * tables + F.lit(0.3) * filt + F.lit(0.3) * _jaccard(a["aggregates"], b["aggregates"])
