"""J-2 over a hot key: equal to the plain join, and no task reads more than a share of a side."""

from pyspark.sql import functions as F

from telemark.operators import joins as J


def _sides(spark, n):
    # half of either side holds one key; the rest is spread; every 50th key is null
    def side(p):
        key = F.when(F.col("id") % 50 == 49, F.lit(None)).when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 97 + 10)
        return spark.range(n).select(key.cast("int").alias(f"{p}k"), F.lit("x").alias(f"{p}c"), F.col("id").alias(f"{p}id"), F.lit(1).alias("note"))
    return side("l"), side("r")


def test_grid_join_equals_plain(spark):
    left, right = _sides(spark, 400)
    pairs = [("lk", "rk"), ("lc", "rc")]
    left, right = left.union(left.filter("lid < 6")), right.union(right.filter("rid = 0"))      # repeated rows
    plain, grid = J.join_on(left, right, pairs), J.grid_join(left, right, pairs, 1 / 16)
    assert grid.columns == plain.columns and "note1" in grid.columns
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, plain.collect()))
    same = J.grid_join(left.withColumnRenamed("lk", "k"), right.withColumnRenamed("rk", "k"), ["k"])
    assert same.count() == J.join_on(left.withColumnRenamed("lk", "k"), right.withColumnRenamed("rk", "k"), ["k"]).count()


def test_grid_join_empty_and_one_sided(spark):
    left, right = _sides(spark, 300)
    pairs = [("lk", "rk")]
    assert J.grid_join(left.limit(0), right, pairs).count() == 0
    assert J.grid_join(left, right.limit(0), pairs).count() == 0
    one = right.filter("rk = 7").limit(1)
    assert J.grid_join(left, one, pairs).count() == left.filter("lk = 7").count()


def test_grid_join_cells_are_bounded(spark):
    left, right = _sides(spark, 4000)
    out = J.grid_join(left, right, [("lk", "rk")], 1 / 16)
    # the hot key's pairs by the task that made them: about 8 x 8 cells over the partitions
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        cells = J.grid_join(left, right, [("lk", "rk")], 1 / 16).filter("lk = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    hot_l, hot_r = left.filter("lk = 7").count(), right.filter("rk = 7").count()
    assert sum(c["count"] for c in cells) == hot_l * hot_r
    assert max(c["count"] for c in cells) < hot_l * hot_r / 5
    assert out.filter("lk is null").count() == 0
