"""Join and union operators.

Broadcasting is never assumed: ``broadcast_if_small`` measures the side first
(row count and estimated bytes from the optimized plan) and only then hints it;
otherwise Spark's shuffle join (with AQE skew splitting) stays in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def plan_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - estimate unavailable
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES,
                       max_rows: int | None = None) -> DataFrame:
    """J-7 broadcast behind a size check.

    The plan estimate is checked first; if it is unknown or above the bound
    and ``max_rows`` is given, the rows are counted (one cheap job) before the
    hint is applied.  Over the bound the frame is returned unhinted.
    """
    est = plan_size_bytes(df)
    if est is not None and est <= max_bytes:
        return F.broadcast(df)
    if max_rows is not None and df.count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Spread a CPU-heavy per-row stage over all cores when the input arrives
    in fewer splits than the cluster has task slots (small files); a no-op on
    large inputs, which already come in many splits."""
    try:
        target = target or df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            return df.repartition(target)
    except Exception:  # e.g. a Connect session without RDD access: leave the plan as is
        pass
    return df


def shuffle_hint(df: DataFrame) -> DataFrame:
    """J-6 ``hint.strategy=shuffle``."""
    return df.hint("shuffle_hash")


def rename_clashes(left: DataFrame, right: DataFrame, keys=()) -> DataFrame:
    """J-4 right columns that collide with a left column get suffix 1 (``X1``)."""
    keys = set(keys)
    taken = set(left.columns)
    out = right
    for c in right.columns:
        if c in taken and c not in keys:
            n = 1
            while f"{c}{n}" in taken or f"{c}{n}" in right.columns:
                n += 1
            out = out.withColumnRenamed(c, f"{c}{n}")
            taken.add(f"{c}{n}")
    return out


def join_on(left: DataFrame, right: DataFrame, pairs, how: str = "inner") -> DataFrame:
    """J-1 / J-2 equi join on ``[(left_col, right_col), ...]`` (``$left.a == $right.b``).

    Same-named keys are emitted once; right columns that clash get suffix 1.
    """
    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in pairs]
    same = {l for l, r in pairs if l == r}
    r = rename_clashes(left, right, keys=same)
    if all(l == rr for l, rr in pairs):
        return left.join(r, on=[l for l, _ in pairs], how=how)
    ren = {c_old: c_new for c_old, c_new in zip(right.columns, r.columns)}
    cond = reduce(lambda a, b: a & b, [left[l] == r[ren[rr]] for l, rr in pairs])
    return left.join(r, on=cond, how=how)


def grid_join(left: DataFrame, right: DataFrame, pairs, cell_share: float = 1 / 64) -> DataFrame:
    """J-2 inner equi join that deals a hot key over a grid of tasks.

    A key is hot where it holds more than ``cell_share`` of the rows of either
    side, so there are fewer than ``2 / cell_share`` of them at any size.  Its
    left rows are cut into i parts and its right rows into j, by a hash of the
    whole row, each part holding about ``cell_share`` of its side; every left
    part meets every right part in one of i x j cells.  Rows of other keys are
    neither copied nor marked.  Rows that repeat in all columns share a part.
    Null keys join nothing, as in ``join_on``, whose columns this returns.
    """
    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in pairs]
    names = [f"k{i}_" for i in range(len(pairs))]
    sides = [(left, [l for l, _ in pairs]), (right, [r for _, r in pairs])]
    hot = []
    for df, keys in sides:
        counts = df.dropna(subset=keys).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("n_"))
        whole = df.dropna(subset=keys).agg(F.count(F.lit(1))).scalar()
        parts = F.ceil(F.col("n_") / (whole * F.lit(cell_share))).cast("int")
        hot.append(counts.select(*names, parts.alias("parts_")).filter("parts_ > 1"))
    # fewer than 2 / cell_share rows, so a proven bound
    grid = F.broadcast(hot[0].withColumnRenamed("parts_", "i_").join(hot[1].withColumnRenamed("parts_", "j_"), names, "full")
                       .select(*names, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("i_", "j_")]))
    dealt = []
    for (df, keys), own, other, cell, copy in ((sides[0], "i_", "j_", "a_", "b_"), (sides[1], "j_", "i_", "b_", "a_")):
        rows = df.join(grid, reduce(lambda x, y: x & y, [df[k] == grid[n] for k, n in zip(keys, names)]), "left").drop(*names)
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        dealt.append(rows.select(*[F.col(f"`{c}`") for c in df.columns], part.alias(cell), copies.alias(copy)))
    return join_on(dealt[0], dealt[1], [*pairs, "a_", "b_"]).drop("a_", "b_")


def inner_unique(left: DataFrame, right: DataFrame, pairs, left_order, how: str = "inner") -> DataFrame:
    """J-3 ``kind=innerunique``: the left side is reduced to one row per key
    (the row with the largest ``left_order`` tuple, a required tie-break) and
    then joined.  The reduction is a partial ``max_by`` aggregate."""
    from telemark.operators.latest import latest_by

    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in pairs]
    lkeys = [l for l, _ in pairs]
    reduced = latest_by(left, lkeys, left_order)
    return join_on(reduced, right, pairs, how=how)


def semi_join(left: DataFrame, right: DataFrame, pairs) -> DataFrame:
    """J-5 / P-8 ``where x in (subquery)`` as a left-semi join."""
    return join_on(left, right.select(*{p if isinstance(p, str) else p[1] for p in pairs}), pairs, how="left_semi")


def anti_join(left: DataFrame, right: DataFrame, pairs) -> DataFrame:
    """J-11 unmatched rows."""
    return join_on(left, right.select(*{p if isinstance(p, str) else p[1] for p in pairs}), pairs, how="left_anti")


def union_all(frames, with_source: str | None = None, names=None) -> DataFrame:
    """U-1 ``union`` of tables with different columns (missing ones become null);
    U-2 ``withsource=Name`` adds the table name as a column."""
    frames = list(frames)
    if with_source:
        names = list(names or [f"t{i}" for i in range(len(frames))])
        frames = [f.withColumn(with_source, F.lit(n)) for f, n in zip(frames, names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_counts(tables: dict, name_col: str = "table_name", count_col: str = "row_count") -> DataFrame:
    """U-2 / U-3 / C-2 ``union withsource=T * | summarize count() by T``.

    Each scan contributes only a literal table name (no data columns are
    read); the union is counted by one ``groupBy`` whose partial aggregate
    leaves one row per table and input partition, so only counts cross the
    single shuffle."""
    parts = [df.select(F.lit(n).alias(name_col)) for n, df in tables.items()]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy(name_col).agg(F.count(F.lit(1)).alias(count_col))
