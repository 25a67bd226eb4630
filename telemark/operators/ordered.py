"""Ordered work without a task that holds a whole key.

A window ``partitionBy(key).orderBy(t)`` sorts each key in one task.  Here rows
are range-partitioned once on the key and the *full* order tuple, so a key of
any size, and rows that tie on the first order columns, spread over partitions
that follow each other.  Neighbours and running sums are taken inside a
partition; one row for each partition (its first and last key and value, and the
sum of its last key) carries them over the borders.  That table has no more rows
than there are partitions, so it is broadcast, and its window is the only one
over a single partition.

The partitioned rows are kept on the executors' disks (``persist``), so that
both uses see the same partitions; a lost one is sorted again from the shuffle
files with the same bounds.  Nothing runs before an action does.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART, _AT = "_part", "_at"


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def range_sorted(df: DataFrame, keys, order) -> DataFrame:
    """``df`` in partitions of (keys, order), numbered in ``_part``, with the
    place of a row in ``_at``.  ``order`` must be total within a key."""
    by = [*_names(keys), *order]
    d = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return d.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)


def _key(keys) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def with_neighbours(df: DataFrame, keys, order, value: str, prev_name: str, next_name: str) -> DataFrame:
    """``lag`` / ``lead`` of ``value`` within each key."""
    keys = _names(keys)
    d = range_sorted(df, keys, order)
    row = F.struct(_key(keys).alias("key"), F.col(value).alias("value"))
    ends = d.groupBy(_PART).agg(F.min_by(row, F.col(_AT)).alias("lo"), F.max_by(row, F.col(_AT)).alias("hi"))
    w = Window.orderBy(_PART)
    ends = ends.select(_PART, F.lag("hi").over(w).alias("_before"), F.lead("lo").over(w).alias("_after"))
    w = Window.partitionBy(_PART, *keys).orderBy(_AT)
    d = (d.withColumn(prev_name, F.lag(value).over(w)).withColumn(next_name, F.lead(value).over(w))
          .withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead(F.lit(1)).over(w).isNull()))
    d = d.join(F.broadcast(ends), _PART)
    for name, edge, other in ((prev_name, "_first", "_before"), (next_name, "_last", "_after")):
        d = d.withColumn(name, F.when(F.col(edge) & _key(keys).eqNullSafe(F.col(other)["key"]), F.col(other)["value"]).otherwise(F.col(name)))
    return d.drop(_PART, _AT, "_first", "_last", "_before", "_after")


def running_sum(df: DataFrame, keys, order, weight: str | None = None, name: str = "_run") -> DataFrame:
    """Add the sum of ``weight`` (1 where none is given: the position) over the
    rows of a key up to each row, in order."""
    keys = _names(keys)
    d = range_sorted(df, keys, order)
    one = F.col(weight) if weight else F.lit(1).cast("long")
    sums = d.groupBy(_PART, *keys).agg(F.sum(one).alias("sum"), F.min(_AT).alias("at"))
    row = F.struct(_key(keys).alias("key"), F.col("sum").alias("sum"))
    ends = sums.groupBy(_PART).agg(F.min_by(row, F.col("at")).alias("lo"), F.max_by(row, F.col("at")).alias("hi"))
    # a key that goes on over several partitions is the last of each but its final one
    ends = ends.withColumn("sofar", F.sum("hi.sum").over(Window.partitionBy("hi.key").orderBy(_PART)))
    w = Window.orderBy(_PART)
    ends = ends.select(_PART, F.when(F.lag("hi.key").over(w).eqNullSafe(F.col("lo.key")), F.col("lo.key")).alias("_goes_on"), F.lag("sofar").over(w).alias("_before"))
    own = F.sum(one).over(Window.partitionBy(_PART, *keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn(name, own).join(F.broadcast(ends), _PART)
    d = d.withColumn(name, F.col(name) + F.when(F.col("_goes_on").isNotNull() & _key(keys).eqNullSafe(F.col("_goes_on")), F.col("_before")).otherwise(0))
    return d.drop(_PART, _AT, "_goes_on", "_before")


def segments(df: DataFrame, keys, value: str, linked, name: str, then=()) -> DataFrame:
    """Number the runs of neighbouring values of a key: a row goes on with the
    run of the row before it where ``linked(value before, value)`` holds (both
    sorted, nulls first).  ``then`` are further columns that spread equal values.
    Numbers differ between runs and grow with them, but have gaps."""
    keys = _names(keys)
    d = range_sorted(df, keys, [F.col(value), *[F.col(c) for c in then]])
    # a key goes over a border only as the last one before and the first one after it
    at = F.col(_AT)
    ends = d.groupBy(_PART).agg(F.min_by(_key(keys), at).alias("lo"), F.max_by(_key(keys), at).alias("hi"), F.max_by(F.struct(value), at).alias("last"))
    ends = ends.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_k"))
    along = Window.partitionBy("_k").orderBy(_PART)
    before = ends.withColumn("_before", F.lag("last").over(along)).filter(F.col("_k").eqNullSafe(F.col("lo"))).select(_PART, "_k", "_before")
    in_part = Window.partitionBy(_PART).orderBy(_AT)
    d = d.withColumn("_prev", F.lag(F.struct(_key(keys).alias("key"), F.struct(value).alias("last"))).over(in_part)).join(F.broadcast(before), _PART)
    prev = F.when(F.col("_prev").isNull(), F.col("_before")).when(F.col("_prev")["key"].eqNullSafe(_key(keys)), F.col("_prev")["last"])
    goes_on = prev.isNotNull() & F.coalesce(linked(prev[value], F.col(value)), F.lit(False))
    d = d.withColumn("_start", F.when(~goes_on, at)).drop("_prev", "_before", "_k")
    starts = d.groupBy(_PART).agg(F.max("_start").alias("_start"))
    opened = F.max("_start").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_open")
    starts = ends.join(F.broadcast(starts), _PART).select(_PART, "_k", "lo", opened).filter(F.col("_k").eqNullSafe(F.col("lo"))).select(_PART, "_open")
    d = d.withColumn(name, F.max("_start").over(in_part.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(starts), _PART)
    return d.withColumn(name, F.coalesce(F.col(name), F.col("_open"))).drop(_PART, _AT, "_start", "_open")


def percentiles(df: DataFrame, keys, value: str, ps, prefix: str = "p") -> DataFrame:
    """A-12 / A-13 exact interpolating percentiles by distributed selection:
    ``keys, n, mean, <prefix><p> ...``; ``n`` counts all rows, the mean and the
    percentiles those with a value (null without any).

    Equal values of a key are counted by a partial aggregate, the distinct ones
    ranked by ``running_sum``; only the rows at the wanted ranks are gathered,
    so no buffer holds a key's values."""
    from telemark.functions.aggs import _p_label

    keys, ps = _names(keys), [float(p) for p in ps]
    counts = df.select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    some = F.when(F.col("_v").isNotNull(), F.col("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(some), F.lit(0)).alias("_size"), (F.sum(F.col("_v") * F.col("_n")) / F.sum(some)).alias("mean"))
    ranked = running_sum(counts.filter(F.col("_v").isNotNull()), keys, [F.col("_v")], "_n").select(_key(keys).alias("_key"), "_v", (F.col("_run") - F.col("_n")).alias("_lo"), (F.col("_run") - 1).alias("_hi"))
    sizes = totals.select(_key(keys).alias("_k"), "_size")
    met = ranked.join(sizes, F.col("_key").eqNullSafe(F.col("_k")))
    at = [(F.col("_size") - 1) * F.lit(p) for p in ps]

    def holds(rank):
        return F.when((F.col("_lo") <= rank) & (rank <= F.col("_hi")), F.col("_v"))
    picked = [(F.max(holds(F.floor(x))).alias(f"_a{i}"), F.max(holds(F.ceil(x))).alias(f"_b{i}")) for i, x in enumerate(at)]
    wanted = F.lit(False)
    for x in at:
        wanted = wanted | holds(F.floor(x)).isNotNull() | holds(F.ceil(x)).isNotNull()
    picked = met.filter(wanted).groupBy("_k").agg(*[c for pair in picked for c in pair])
    out = totals.join(picked, _key(keys).eqNullSafe(F.col("_k")), "left")
    names = [f"{prefix}{_p_label(p)}" for p in ps]
    return out.select(*keys, "n", "mean", *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (x - F.floor(x))).alias(name) for i, (x, name) in enumerate(zip(at, names))])
