"""Aggregate helpers.

All are ordinary aggregate expressions, so Spark plans partial (map-side) and
final aggregation around the shuffle.  Approximate variants are the default at
scale; ``exact=True`` gives the exact value used by oracles and tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemark.functions._col import col


def count_all() -> Column:
    """A-4 ``count()``."""
    return F.count(F.lit(1))


def countif(pred: Column) -> Column:
    """A-5 ``countif(p)``; a null predicate does not count."""
    return F.count_if(F.coalesce(pred, F.lit(False)))


def sumif(x, pred: Column) -> Column:
    """A-7 ``sumif(x, p)``: 0 (not null) when nothing matches (decision)."""
    x = F.lit(x) if isinstance(x, (int, float)) else col(x)
    return F.coalesce(F.sum(F.when(pred, x)), F.lit(0))


def dcount(x, exact: bool = False, rsd: float = 0.05) -> Column:
    """A-10 ``dcount``: HyperLogLog++ by default, exact on request."""
    return F.count_distinct(col(x)) if exact else F.approx_count_distinct(col(x), rsd)


def dcountif(x, pred: Column, exact: bool = False, rsd: float = 0.05) -> Column:
    """A-11 ``dcountif(x, p)``."""
    v = F.when(pred, col(x))
    return F.count_distinct(v) if exact else F.approx_count_distinct(v, rsd)


SKETCH_LG_K = 12
#: Relative error that a merged distinct count keeps in all but rare cases: four
#: standard errors of a sketch with 2 ** SKETCH_LG_K registers.
SKETCH_ERROR = 4 * 1.04 / 2 ** (SKETCH_LG_K / 2)


def dcount_sketch(x, pred: Column | None = None) -> Column:
    """A-10 / A-11 a mergeable distinct-count sketch of bounded size, to be stored
    by (bucket, key) and rolled up by ``dcount_merge``."""
    v = col(x) if pred is None else F.when(pred, col(x))
    return F.hll_sketch_agg(v, F.lit(SKETCH_LG_K))


def dcount_merge(sketch) -> Column:
    """The sketch of the union of the sets behind stored sketches."""
    return F.hll_union_agg(col(sketch))


def dcount_of(sketch) -> Column:
    """The distinct count that a sketch estimates."""
    return F.hll_sketch_estimate(col(sketch))


def percentile(x, p: float, accuracy: int = 10000) -> Column:
    """A-12 ``percentile(x, p)`` as ``percentile_approx``, a sketch of bounded
    size; exact values come from ``operators.ordered.percentiles``."""
    return F.percentile_approx(col(x).cast("double"), F.lit(p), accuracy)


def percentiles(x, ps, prefix: str | None = None, name: str = "x") -> list[Column]:
    """A-13 ``percentiles(x, p1, p2, ..)``: one aggregate column per p, named
    ``percentile_<name>_<p>`` (A-18 default naming) unless ``prefix`` is given;
    one sketch serves all p."""
    ps = list(ps)
    arr = F.percentile_approx(col(x).cast("double"), F.array(*[F.lit(float(p)) for p in ps]), 10000)
    out = []
    for i, p in enumerate(ps):
        label = f"{prefix}{_p_label(p)}" if prefix is not None else f"percentile_{name}_{_p_label(p)}"
        out.append(arr[i].alias(label))
    return out


def _p_label(p) -> str:
    v = float(p) * 100 if float(p) <= 1 else float(p)
    return str(int(v)) if v == int(v) else str(v).replace(".", "_")


def arg_max_row(order_cols, value_cols) -> Column:
    """A-14 ``arg_max(t, *)``: the struct of ``value_cols`` from the row with the
    largest ``order_cols`` tuple (tie-breakers belong in ``order_cols``).
    ``max_by`` is partially aggregated, so the whole group never sits in one
    buffer and a hot key costs no more than a cold one."""
    order = F.struct(*[col(c) for c in order_cols])
    return F.max_by(F.struct(*[col(c) for c in value_cols]), order)


def arg_min_row(order_cols, value_cols) -> Column:
    order = F.struct(*[col(c) for c in order_cols])
    return F.min_by(F.struct(*[col(c) for c in value_cols]), order)


def default_name(func: str, column: str | None = None, p=None) -> str:
    """A-18 default result names: ``count_``, ``avg_X``, ``percentile_X_p``."""
    if func == "count":
        return "count_"
    if func == "percentile":
        return f"percentile_{column}_{_p_label(p)}"
    return f"{func}_{column}"


def sorted_set(x) -> Column:
    """A-20 group-to-list with sorted unique values."""
    return F.array_sort(F.collect_set(col(x)))
