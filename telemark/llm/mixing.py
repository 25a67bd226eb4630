"""Mixing sources to target weights.

Words are counted per source, each source gets a target by water filling (its
share by weight, at most ``cap`` times its own words, the excess reshared by
weight until none is above), and each document is emitted ``floor(rate)``
times plus one Bernoulli copy with probability ``rate - floor(rate)``, where
``rate`` is its source's target over its source's words.

The draws are seeded by hashes, so reruns agree whatever the layout, and spread
evenly, so that a source's words come near its target: documents of a source
fall into cells of about ``CELL`` documents by a hash of id and text; a cell
starts at a hashed number in [0, 1) and its documents, by size, go on from it
in steps of the golden section.  Each draw alone is uniform.

Defined results: a null or empty text has size 0 and is emitted like any other
document; a source of null is a source of its own, last in order; a source
without words has target 0 and rate 0; an empty table gives an empty mix.
Input columns named like an output column give way to it.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemark.llm import common as C

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240607
CELL = 2048
GOLDEN = 0.6180339887498949


def size_of(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """``(source, source_size, target, rate)`` from rows of ``(source, size)``.

    Sources take the weights in turn, by code point, null last.  The level of
    the water (words per unit of weight) is found by rounds of one aggregate
    each; only two numbers a round reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = C.ranked(per, F.col("source").asc_nulls_last())
    turn = F.create_map(*chain.from_iterable((F.lit(i), F.lit(w)) for i, w in enumerate(weights)))
    per = C.written(per.select("source", "source_size", turn[(F.col("rank_") % len(weights)).cast("int")].alias("weight")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    goal, level = total * share, 0.0
    while True:
        full = F.col("source_size") * F.lit(cap) <= F.col("weight") * F.lit(level)
        fixed, free = per.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        rise = (goal - cap * (fixed or 0)) / free
        if rise <= level:
            break
        level = rise
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return per.withColumn("target", target.cast("double")).select("source", "source_size", "target", rate.alias("rate"))


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *keep) -> DataFrame:
    size = size_of(F.col(text_col))
    return docs.select(*keep, F.col(source_col).alias("source_"), size.alias("size_"),
                       F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("hash_"))


def _cells(marked: DataFrame, weights, cap: float) -> DataFrame:
    """One row a source: how many cells, its words, target and rate."""
    cells = C.written(marked.groupBy("source_").agg(F.count(F.lit(1)).alias("n_"), F.sum("size_").alias("size")), "cells")
    rates = targets(cells.select(F.col("source_").alias("source"), "size"), weights, cap)
    return C.written(cells.join(rates, cells.source_.eqNullSafe(rates.source))
                     .select(F.col("source_").alias("s_"), F.ceil(F.col("n_") / CELL).alias("cells_"), "source_size", "target", "rate"), "rates")


def _drawn(marked: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """``marked`` with ``source_size, target, rate, copies_``."""
    rows = marked.join(cells, F.col("source_").eqNullSafe(F.col("s_")))
    rows = rows.withColumn("cell_", F.pmod("hash_", "cells_"))
    at = F.row_number().over(W.partitionBy("source_", "cell_").orderBy("size_", "hash_"))
    u = C.uniform(seed, F.col("source_"), F.col("cell_")) + at * F.lit(GOLDEN)
    whole = F.floor("rate")
    return rows.withColumn("u_", u - F.floor(u)).withColumn("copies_", (whole + F.when(F.col("u_") < F.col("rate") - whole, 1).otherwise(0)).cast("int"))


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: ``id, size, source_size, target, copies, taken``."""
    marked = C.written(_marked(docs, id_col, text_col, source_col, seed, F.col(id_col).alias("id")), "sizes")
    rows = _drawn(marked, _cells(marked, weights, cap), seed)
    return rows.select("id", F.col("size_").alias("size"), "source_size", "target", F.col("copies_").alias("copies"), (F.col("size_") * F.col("copies_")).alias("taken"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the
    columns of ``docs``."""
    cells = _cells(_marked(docs, id_col, text_col, source_col, seed), weights, cap)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    rows = _drawn(_marked(docs, id_col, text_col, source_col, seed, row), cells, seed).filter("copies_ > 0")
    return rows.select("row_", F.explode(F.sequence(F.lit(1), "copies_"))).select("row_.*")
