"""Unordered comparison within tolerance.

Rows of two results match when every pair of cells does: numbers within an
absolute or a relative tolerance, everything else by its text.  Such a relation
has no key, and "equal" is not transitive, so the overlap of a case is the size
of a *maximum matching* between its rows:

1. equal rows of a side are counted by a partial aggregate;
2. rows meet only where their text cells are the same, and a numeric column
   splits such a block where two neighbouring values are too far apart
   (``ordered.segments``: one range sort a column, so a hot case spreads).  No
   matching pair lies on both sides of such a gap;
3. what is left are short chains of neighbouring values.  With one numeric
   column they are matched while they stream by in order, holding only the rows
   that can still find a partner.  With several, the rows of a chain are held
   together, and augmenting paths find the matching.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.operators import ordered
from telemark.session import ship_package

INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_ZERO = 1e-12       # the relative base is |second value| + this, as in ordered comparison


def limits(tolerances) -> tuple[float, float]:
    t = tolerances or {}
    return float(t.get("numeric_abs") or 0.0), float(t.get("numeric_rel") or 0.0)


def _close(e: float, a: float, ab: float, rel: float) -> bool:
    gap = abs(e - a)
    return gap <= ab or gap <= rel * (abs(a) + _ZERO)


def _linked(ab: float, rel: float):
    """Whether two neighbouring values may belong together, in either role.  The
    margin keeps rounding from splitting a pair.  A relative tolerance of 1 or
    more relates values of any distance, so nothing splits there."""
    def test(x: Column, y: Column) -> Column:
        if rel >= 1:
            return F.lit(True)
        reach = F.greatest(F.lit(ab), F.lit(rel) * (F.greatest(F.abs(x), F.abs(y)) + F.lit(_ZERO)))
        return F.coalesce(y - x <= reach * F.lit(1 + 1e-9), F.lit(True))
    return test


def _cells(df: DataFrame, cols, exact, any_order: bool) -> tuple[Column, list[Column]]:
    """Text cells (null where the cell is a finite number) and the numbers."""
    text, number = [], []
    for c, is_exact in zip(cols, exact):
        s = F.coalesce(df[c].cast("string"), F.lit("None"))
        v = F.lit(None).cast("double") if is_exact else s.try_cast("double")
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        text.append(F.when(finite, F.lit(None).cast("string")).otherwise(F.coalesce(v.cast("string"), s)))
        number.append(F.when(finite, v))
    if any_order:       # texts in order, then numbers in order: the sorted pairing is as good as any
        text = F.array_sort(F.array_compact(F.array(*text)))
        sorted_numbers = F.array_sort(F.array_compact(F.array(*number)))
        return text, [F.get(sorted_numbers, F.lit(i)) for i in range(len(number))]
    return F.array(*text), [v for v, is_exact in zip(number, exact) if not is_exact]


class _Chain:
    """Maximum matching of one numeric column, values arriving in order.

    What a value accepts is an interval whose ends grow with the value, so the
    oldest waiting row that fits is always a best partner.  Only rows of one
    side wait at a time, and only while a partner can still come."""

    def __init__(self, ab, rel):
        self.ab, self.rel, self.wait, self.expected, self.matched = ab, rel, deque(), True, 0

    def _reaches(self, old, new):
        return _close(old, new, self.ab, self.rel) if self.expected else _close(new, old, self.ab, self.rel)

    def add(self, value, n_expected, n_actual):
        for is_expected, n in ((True, n_expected), (False, n_actual)):
            while self.wait and not self._reaches(self.wait[0][0], value):
                self.wait.popleft()
            while n and self.wait and self.expected != is_expected:
                take = min(n, self.wait[0][1])
                n, self.matched = n - take, self.matched + take
                self.wait[0][1] -= take
                if not self.wait[0][1]:
                    self.wait.popleft()
                while self.wait and not self._reaches(self.wait[0][0], value):
                    self.wait.popleft()
            if n:
                self.expected = is_expected
                self.wait.append([value, n])


def _match_rows(rows, ab, rel) -> int:
    """Maximum matching of a chain: ``rows`` are (numbers, n_expected, n_actual)."""
    if not any(r[1] for r in rows) or not any(r[2] for r in rows):
        return 0
    width = len(rows[0][0])
    varying = [k for k in range(width) if any(r[0][k] != rows[0][0][k] for r in rows)]
    if len(varying) <= 1 and rel < 1:
        at, chain = (varying or [None])[0], _Chain(ab, rel)
        for numbers, e, a in sorted(rows, key=lambda r: r[0][at] if at is not None else 0):
            chain.add(numbers[at] if at is not None else 0.0, e, a)
        return chain.matched
    pivot = max(varying, key=lambda k: len({r[0][k] for r in rows}), default=None)
    actual = sorted(((r[0], r[2]) for r in rows if r[2]), key=lambda r: r[0][pivot] if pivot is not None else 0)
    keys = [r[0][pivot] if pivot is not None else 0.0 for r in actual]
    left = [[r[0], r[1]] for r in rows if r[1]]
    free, near = [n for _, n in actual], []
    for numbers, _ in left:
        lo, hi = 0, len(actual)
        if rel < 1 and pivot is not None:
            x = numbers[pivot]
            reach = max(ab, rel * (abs(x) + _ZERO) / (1 - rel)) * (1 + 1e-9)     # |a| <= (|x| + ...) / (1 - rel)
            lo, hi = bisect_left(keys, x - reach), bisect_right(keys, x + reach)
        near.append([j for j in range(lo, hi) if all(
            (x is None and y is None) or (x is not None and y is not None and (x == y or _close(x, y, ab, rel))) for x, y in zip(numbers, actual[j][0]))])
    flow, matched = [dict() for _ in actual], 0            # flow[j][i]: copies of expected row i that take actual row j
    for i, (_, want) in enumerate(left):
        while want:
            came, queue, end = {i: None}, deque([i]), None
            seen = {}
            while queue and end is None:
                u = queue.popleft()
                for j in near[u]:
                    if j in seen:
                        continue
                    seen[j] = u
                    if free[j]:
                        end = j
                        break
                    for v in flow[j]:
                        if v not in came:
                            came[v] = j
                            queue.append(v)
            if end is None:
                break
            path, j = [], end
            while True:
                u = seen[j]
                path.append((u, j))
                if came[u] is None:
                    break
                j = came[u]
            # every row on the way but the first gives up the actual row it came by
            amount = min([want, free[end]] + [flow[came[u]][u] for u, _ in path[:-1]])
            free[end] -= amount
            for u, j in path:
                flow[j][u] = flow[j].get(u, 0) + amount
                if came[u] is not None:
                    back = flow[came[u]]
                    back[u] -= amount
                    if not back[u]:
                        del back[u]
            want, matched = want - amount, matched + amount
    return matched


def _matcher(width: int, ab: float, rel: float):
    """Batches of rows in order of their chain -> (case digest, matched)."""
    streaming = width == 1 and rel < 1

    def run(batches):
        import pyarrow as pa

        chain = case = None
        state, rows = _Chain(ab, rel), []

        def finish():
            return state.matched if streaming else _match_rows(rows, ab, rel)

        for batch in batches:
            cols, found = batch.to_pydict(), {}
            numbers = list(zip(*[cols[f"_v{i}"] for i in range(width)]))
            for g, c, v, e, a in zip(cols["_g"], cols["_case"], numbers, cols["_ne"], cols["_na"]):
                if g != chain:
                    if chain is not None:
                        found[case] = found.get(case, 0) + finish()
                    chain, case, state, rows = g, c, _Chain(ab, rel), []
                if streaming:
                    state.add(v[0] if v[0] is not None else 0.0, e, a)
                else:
                    rows.append((v, e, a))
            if found:
                yield pa.RecordBatch.from_pydict({"_case": pa.array(list(found), pa.string()), "_matched": pa.array(list(found.values()), pa.int64())})
        if chain is not None:
            yield pa.RecordBatch.from_pydict({"_case": pa.array([case], pa.string()), "_matched": pa.array([finish()], pa.int64())})
    return run


def _digest(*cols) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def matched_rows(expected: DataFrame, actual: DataFrame, case_col: str, e_cols, a_cols, tolerances, any_order: bool = False) -> DataFrame:
    """``case, _ne, _na, _matched``: rows of either side and the size of a
    maximum matching, for each case that has rows.

    An absolute tolerance of ``t`` lets ``|e - a| <= t``, a relative one of ``r``
    ``|e - a| <= r * |a|``; either suffices.  Numbers compare as doubles, also
    where they are text; null matches null only.  Integer columns are exact
    under an absolute tolerance below 1."""
    ab, rel = limits(tolerances)
    ship_package(expected.sparkSession)
    et, at = dict(expected.dtypes), dict(actual.dtypes)
    exact = [not any_order and ab < 1 and rel == 0 and et[x] in INTEGRAL and at[y] in INTEGRAL for x, y in zip(e_cols, a_cols)]

    def side(df, cols, mine):
        text, numbers = _cells(df, cols, exact, any_order)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        return df.select(F.col(case_col).alias("_c"), text.alias("_t"), *[v.alias(f"_v{i}") for i, v in enumerate(numbers)],
                         (one if mine == "_ne" else none).alias("_ne"), (one if mine == "_na" else none).alias("_na"))

    both = side(expected, e_cols, "_ne").unionAll(side(actual, a_cols, "_na"))
    values = [c for c in both.columns if c.startswith("_v")]
    both = both.groupBy("_c", "_t", *values).agg(F.sum("_ne").alias("_ne"), F.sum("_na").alias("_na"))
    totals = both.groupBy("_c").agg(F.sum("_ne").alias("_ne"), F.sum("_na").alias("_na"))
    d = both.select(_digest("_c").alias("_case"), _digest("_c", "_t").alias("_g"), *values, "_ne", "_na")
    if not values:
        found = d.select("_case", F.least("_ne", "_na").alias("_matched"))
    else:
        for v in values if rel < 1 else []:
            d = ordered.segments(d, "_g", v, _linked(ab, rel), "_seg", [x for x in values if x != v])
            d = d.withColumn("_g", _digest("_g", "_seg")).drop("_seg")
        d = d.repartition("_g").sortWithinPartitions("_g", *values)
        found = d.select("_g", "_case", *values, "_ne", "_na").mapInArrow(_matcher(len(values), ab, rel), "_case string, _matched long")
    found = found.groupBy("_case").agg(F.sum("_matched").alias("_matched"))
    out = totals.withColumn("_case", _digest("_c")).join(found, "_case")
    return out.select(F.col("_c").alias(case_col), "_ne", "_na", "_matched")
