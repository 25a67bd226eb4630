"""Neighbours, positions and percentiles by one range sort, against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemark.operators import ordered as O
from telemark.operators import runlog as G

KINDS = {"hot": lambda i, r: (1, 0), "tied": lambda i, r: (r.choice([1, 1, 1, 2, None]), 7), "many": lambda i, r: (i % 97, r.randint(0, 3)), "mixed": lambda i, r: (r.choice([None, 3, i]), r.choice([None, 1]))}


def _rows(spark, kind, n=3000):
    r = random.Random(kind)
    rows = [(*KINDS[kind](i, r), i, r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 40)), r.random()])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t int, id long, v string, x double").repartition(7)


@pytest.mark.parametrize("kind", KINDS)
def test_neighbours_and_positions(spark, kind):
    """A key of all rows, and rows that all tie on the first order column, included."""
    d = _rows(spark, kind)
    order = [F.desc("t"), F.asc("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = d.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w)).withColumn("pos", F.row_number().over(w).cast("long"))
    got = O.with_neighbours(d, "k", order, "v", "p", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("pos").collect()))
    got = O.running_sum(d, ["k"], order, name="pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("p", "n").collect()))
    got = O.running_sum(d, ["k"], order, "id", "run").collect()
    want = d.withColumn("run", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("kind", KINDS)
def test_percentiles_are_exact(spark, kind):
    d = _rows(spark, kind)
    ps = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r[0]: tuple(r)[1:] for r in O.percentiles(d, "k", "x", ps).collect()}
    want = {r[0]: tuple(r)[1:] for r in d.groupBy("k").agg(F.count(F.lit(1)), F.avg("x"), *[F.percentile("x", F.lit(p)) for p in ps]).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, nan_ok=True) if w[1] is not None else got[k] == w


def test_one_key_spreads_over_partitions(spark):
    d = O.range_sorted(_rows(spark, "hot", 20_000), "k", [F.col("t"), F.col("id")])
    sizes = [r["count"] for r in d.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 0.5 * sum(sizes)
    assert O.percentiles(_rows(spark, "hot").limit(0), "k", "x", [0.5]).count() == 0
    assert O.with_neighbours(_rows(spark, "hot").limit(0), "k", ["t", "id"], "v", "p", "n").count() == 0


def test_no_job_and_no_value_buffer_while_planning(spark):
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    d = _rows(spark, "hot")
    before = jobs()
    plan = O.percentiles(d, "k", "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    O.with_neighbours(d, "k", ["t", "id"], "v", "p", "n")
    assert jobs() == before and "percentile(" not in plan and "collect_list" not in plan


def test_usage_sums(spark):
    d = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("a", {"x": 5, "z": None}), ("a", None), ("b", {}), (None, {"x": 3})], "purpose string, usage map<string,long>")
    assert {r[0]: r[1] for r in G.usage_sums(d, "purpose").collect()} == {"a": {"x": 6, "y": 2}, "b": {}, None: {"x": 3}}
