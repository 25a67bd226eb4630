"""Latest-row and ordered-neighbour operators.

``latest_by`` is a grouped ``max_by`` over a struct: Spark aggregates it
partially on the map side, so a key holding a third of all rows is reduced to
one row per input partition before the shuffle (no window, no skew hot spot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemark.operators import ordered


def latest_by(df: DataFrame, keys, order_cols, columns=None) -> DataFrame:
    """W-1 / A-14 ``summarize arg_max(order, *) by keys``.

    ``order_cols`` must end with a tie-breaker that is unique within a key so
    that the chosen row is repeatable.  Returns ``keys + columns``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    columns = [c for c in (columns or df.columns) if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in columns]),
                      F.struct(*[F.col(c) for c in order_cols])).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_row." + c).alias(c) for c in columns])


def earliest_by(df: DataFrame, keys, order_cols, columns=None) -> DataFrame:
    """First row per key (``arg_min``), e.g. first-seen dedup (W-4, W-5)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    columns = [c for c in (columns or df.columns) if c not in keys]
    picked = F.min_by(F.struct(*[F.col(c) for c in columns]),
                      F.struct(*[F.col(c) for c in order_cols])).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_row." + c).alias(c) for c in columns])


def with_neighbours(df: DataFrame, entity, order_cols, value: str, prev_name: str = "prev_value", next_name: str = "next_value") -> DataFrame:
    """W-2 ``prev(c)`` / ``next(c)`` over rows of one entity in ``order_cols``
    order, which needs a unique tie-breaker.  An entity of any size spreads over
    the partitions of one range sort (``operators.ordered``)."""
    return ordered.with_neighbours(df, entity, [order_cols] if isinstance(order_cols, str) else list(order_cols), value, prev_name, next_name)


def change_points(df: DataFrame, entity, order_cols, value: str, prev_name: str = "prev_value", next_name: str = "next_value") -> DataFrame:
    """W-3 status timeline: keep rows whose value differs from the previous or
    the next row of the same entity; a missing neighbour counts as different."""
    out = with_neighbours(df, entity, order_cols, value, prev_name, next_name)
    return out.filter(~F.col(value).eqNullSafe(F.col(prev_name)) | ~F.col(value).eqNullSafe(F.col(next_name)))


def first_k_per_group(df: DataFrame, keys, order_cols, k: int, rank_name: str | None = None) -> DataFrame:
    """W-7 / L-6 at most ``k`` rows per group by ``order_cols``.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so at most ``k`` rows per key and input partition move.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    name = rank_name or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_name else out.drop(name)


def top_n(df: DataFrame, n: int, order_cols) -> DataFrame:
    """L-3 ``top n by x``: global top-n (TakeOrderedAndProject: each partition
    keeps its n best, one task merges n x partitions rows).  ``order_cols``
    must end with a unique tie-breaker for repeatable rows."""
    return df.orderBy(*order_cols).limit(n)


def row_budget(df: DataFrame, table_no: str, order_cols, budget: int) -> DataFrame:
    """W-6 pass tables in ``table_no`` order until ``budget`` rows in total.

    Two-level counts: rows per table (one small aggregate, one row per table)
    give each table its remaining budget; inside a table rows are numbered
    with ``row_number() <= budget`` (a partial WindowGroupLimit, so no task
    ever holds more than ``budget`` rows of one table), then cut to the
    table's remaining budget.  No unpartitioned window over the rows."""
    counts = df.groupBy(table_no).agg(F.count(F.lit(1)).alias("_n"))
    w_tables = Window.orderBy(table_no).rowsBetween(Window.unboundedPreceding, -1)
    # one row per table: a single small partition is fine here
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w_tables), F.lit(0)))
    offsets = offsets.select(table_no, (F.lit(budget) - F.col("_before")).alias("_left"))
    ranked = first_k_per_group(df, table_no, order_cols, budget, rank_name="_rn")
    out = ranked.join(F.broadcast(offsets), table_no).filter(F.col("_rn") <= F.col("_left"))
    return out.drop("_rn", "_left")
