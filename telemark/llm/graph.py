"""Connected components of an edge list, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges (a, b)``: equal labels, the
    least node of the component, for connected nodes.

    Each round takes the least label among a node's neighbours, hangs the old
    label below it, and jumps to the label's label; labels are written after
    each round, and only a count of changes reaches the driver.
    """
    both = C.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = C.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        # an old label (itself a node) learns of the least label any of its nodes has seen
        hook = seen.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("hook"))
        step = seen.join(hook, seen.node == hook.root, "left").select("node", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        step = C.written(step, "labels")
        C.spent(labels)
        up = step.select(F.col("node").alias("up"), F.col("new").alias("top"))
        new = C.written(step.join(up, step.new == up.up, "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("top", "new")).alias("label")), "labels")
        C.spent(step)
        ended = not new.filter("old <> label").head(1)
        labels = new.select("node", "label")
        labels.written_path = new.written_path
        if ended:
            C.spent(both)
            return labels
