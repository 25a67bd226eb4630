"""Unordered comparison within tolerance against a plain matching of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from telemark.operators import compare as E, ordered
from telemark.operators import tolerant as T


def _number(cell):
    try:
        return float(cell)
    except (TypeError, ValueError):
        return None


def _fits(x, y, ab, rel):
    for e, a in zip(x, y):
        u, v = _number(e), _number(a)
        if u is None or v is None:
            if u is not v or str(e) != str(a):
                return False
        elif u != v and not (abs(u - v) <= ab or abs(u - v) / (abs(v) + 1e-12) <= rel):
            return False
    return True


def _plain(left, right, ab, rel):
    """Size of a maximum matching by trying every augmenting path, row by row."""
    owner = {}

    def place(i, seen):
        for j, y in enumerate(right):
            if j not in seen and _fits(left[i], y, ab, rel):
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False
    return sum(place(i, set()) for i in range(len(left)))


def _overlaps(spark, cases, schema, tol, **kw):
    e = spark.createDataFrame([(c, *r) for c, (left, _) in cases.items() for r in left], "c string, " + schema)
    a = spark.createDataFrame([(c, *r) for c, (_, right) in cases.items() for r in right], "c string, " + schema)
    return {r.c: r for r in E.row_overlap(e, a, "c", tolerances=tol, **kw).collect()}


def test_grid_does_not_matter(spark):
    cases = {"edge": ([(10.04,)], [(10.06,)]), "far": ([(10.0,)], [(10.06,)]),
             # 10.05 takes 10.00, so that 10.00 can take 9.96: equal rows first would match one
             "chain": ([(10.0,), (10.05,)], [(10.01,), (9.96,)]), "copies": ([(1.0,)] * 3, [(1.01,)] * 2)}
    got = _overlaps(spark, cases, "v double", {"numeric_abs": 0.05})
    assert {c: r.intersection for c, r in got.items()} == {"edge": 1, "far": 0, "chain": 2, "copies": 2}
    assert got["edge"].is_match and got["copies"].union_size == 3 and not got["copies"].is_match


@pytest.mark.parametrize("ab,rel", [(0.5, 0.0), (0.0, 0.2), (0.3, 0.1), (0.4, 1.5)])
def test_one_number_against_plain(spark, ab, rel):
    rng = random.Random(7)
    cases = {}
    for i in range(60):
        def some():
            return [(rng.choice("ab"), rng.choice([None, *[round(rng.uniform(-3, 3), 1) for _ in range(6)]])) for _ in range(rng.randrange(9))]
        cases[f"c{i}"] = (some(), some())
    got = _overlaps(spark, cases, "k string, v double", {"numeric_abs": ab, "numeric_rel": rel})
    for c, (left, right) in cases.items():
        if left or right:
            assert got[c].intersection == _plain(left, right, ab, rel), (c, left, right)
            assert (got[c].expected_count, got[c].actual_count) == (len(left), len(right))


@pytest.mark.parametrize("ab,rel", [(0.6, 0.0), (0.0, 0.3), (0.2, 0.2)])
def test_several_numbers_against_plain(spark, ab, rel):
    rng = random.Random(11)
    cases = {}
    for i in range(60):
        def some():
            return [(rng.randrange(3), round(rng.uniform(1, 4), 1), str(round(rng.uniform(1, 3), 1))) for _ in range(rng.randrange(10))]
        cases[f"c{i}"] = (some(), some())
    got = _overlaps(spark, cases, "n int, v double, w string", {"numeric_abs": ab, "numeric_rel": rel})
    for c, (left, right) in cases.items():
        if left or right:
            assert got[c].intersection == _plain(left, right, ab, rel), (c, left, right)


def test_absolute_tolerance_is_symmetric_and_any_order_sorts_cells(spark):
    rng = random.Random(3)
    rows = [[(round(rng.uniform(0, 5), 1), round(rng.uniform(0, 5), 1)) for _ in range(30)] for _ in range(2)]
    tol = {"numeric_abs": 0.7}
    there = _overlaps(spark, {"x": (rows[0], rows[1])}, "v double, w double", tol)["x"]
    back = _overlaps(spark, {"x": (rows[1], rows[0])}, "v double, w double", tol)["x"]
    assert there.intersection == back.intersection == _plain(rows[0], rows[1], 0.7, 0.0)
    swapped = {"x": ([(1.0, 2.0)], [(2.1, 0.9)])}
    assert _overlaps(spark, swapped, "v double, w double", tol)["x"].intersection == 0
    assert _overlaps(spark, swapped, "v double, w double", tol, cell_order="any")["x"].intersection == 1


def test_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    cases = {"nan": ([(nan,)], [(nan,)]), "inf": ([(inf,)], [(inf,)]), "sign": ([(inf,)], [(-inf,)]), "zero": ([(0.0,)], [(-0.0,)]),
             "null": ([(None,)], [(None,)]), "none": ([(None,)], [(0.0,)])}
    got = _overlaps(spark, cases, "v double", {"numeric_abs": 1.0, "numeric_rel": 0.5})
    assert {c: r.intersection for c, r in got.items()} == {"nan": 1, "inf": 1, "sign": 0, "zero": 1, "null": 1, "none": 0}


def test_empty_tables(spark):
    t = spark.createDataFrame([], "c string, v double")
    assert E.row_overlap(t, t, "c", tolerances={"numeric_abs": 1.0}).collect() == []


def test_long_chain_holds_only_what_can_still_match():
    chain = T._Chain(1.5, 0.0)
    for i in range(20000):
        chain.add(float(i), 1, 0)
        assert len(chain.wait) <= 2
    chain.add(20000.0, 0, 5)
    assert chain.matched == 1 and len(chain.wait) == 1


def test_segments_over_partition_borders(spark):
    values = [v for k in range(40) for v in (k * 10.0, k * 10.0 + 1, k * 10.0 + 1, k * 10.0 + 2)]
    df = spark.createDataFrame([("hot", i, v) for i, v in enumerate(values)] + [("b", -1, 1.0), (None, -2, 1.0)], "k string, i int, v double")
    got = ordered.segments(df, "k", "v", lambda x, y: y - x <= 1, "seg", ["i"]).collect()
    assert len(got) == len(values) + 2
    runs = {}
    for r in got:
        runs.setdefault((r.k, r.seg), set()).add(r.v)
    assert len(runs) == 42 and all(max(v) - min(v) <= 2 for v in runs.values())


def test_keyed_tables_within_tolerance(spark):
    e = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    a = spark.createDataFrame([(1, 1.01), (2, 2.4), (4, 4.0)], "k int, v double")
    r = E.compare_tables(e, a, key_cols=["k"], tolerances={"numeric_abs": 0.1}).collect()[0]
    assert (r.keys_only_expected, r.keys_only_actual, r.keys_different, r.intersection) == (1, 1, 1, 1)


def test_query_reaches_both_outcomes(spark):
    from telemark.plans import evaluation
    rows = evaluation.tolerant_overlap(spark, "/root/testdata/sf0.01").groupBy("is_match").count().collect()
    assert {r.is_match for r in rows} == {True, False}
    plan = evaluation.tolerant_overlap(spark, "/root/testdata/sf0.001")
    assert plan.filter((F.col("intersection") > 0) & ~F.col("is_match")).count() > 0
