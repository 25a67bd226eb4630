"""Filter interaction audit by contingency tensor contractions.

Every document falls into one cell of a contingency tensor of its part: one
axis for each filter, index 0 where it passes and 1 where it fails.  One pass
over the texts counts the cells (documents, and those with each label); a
part's tensor has ``2 ** filters`` cells whatever the number of documents.  For
each order of the filters and each step, ``einsum`` contracts the tensor with
one selector an axis: *pass* for the filters before, *pass* or *fail* for the
step's own, *all* for those after.  No order is applied to the documents.

Whether a text repeats a smaller id's is told by SHA-256 and an equi-join on
(digest, id), whose keys are single documents, so a text that a third of all
documents share meets no task as a group.

Defined results: a null text is empty; a null part is the empty string; a null
id is no smaller than any other, so it neither repeats nor is repeated, and has
no label; rows that repeat an id and its text are documents each, and none of
them repeats the other; an id with several label rows has a label if one of
them does; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.llm import common as C

#: ASCII space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides, by letter."""
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": distinct * 100 < n * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_rows(docs: DataFrame, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """``(id, part, fails, n)``: the letters that documents fail as an array,
    the last, ``E``, for a text that a smaller id has; ``n`` rows alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    alone = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in text_failures(F.col("text")).items()]))
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
            .select("id", "part", alone.alias("alone"), F.unhex(F.sha2("text", 256)).alias("digest")))
    rows = C.written(rows.groupBy("id", "part", "alone", "digest").agg(F.count(F.lit(1)).alias("n")), "failures")
    first = rows.groupBy("digest").agg(F.min("id").alias("id_")).withColumnRenamed("digest", "digest_")
    marked = rows.join(first, (rows.digest == first.digest_) & (rows.id == first.id_), "left")
    repeats = F.col("id").isNotNull() & F.col("id_").isNull()
    return marked.select("id", "part", F.when(repeats, F.array_append("alone", F.lit("E"))).otherwise(F.col("alone")).alias("fails"), "n")


def cells(rows: DataFrame, labels: DataFrame | None = None, marks: dict[str, Column] | None = None, id_col="doc_id") -> DataFrame:
    """``(part, fails, n, <mark> ...)``: documents in each cell, and those whose
    id has a row of ``labels`` on which the mark holds."""
    marks = marks or {}
    if labels is not None:
        one = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(*[F.max(F.when(m, 1).otherwise(0)).alias(name) for name, m in marks.items()])
        rows = rows.join(one, rows.id == one.label_id, "left")
    return rows.groupBy("part", "fails").agg(F.sum("n").alias("n"), *[F.sum(F.coalesce(F.col(m), F.lit(0)) * F.col("n")).alias(m) for m in marks])


def selectors(letters: str) -> tuple[list[str], np.ndarray]:
    """The orders, and for each order and step a pair (pass, fail) of 0 and 1
    for every axis; the step's own axis selects what fails."""
    orders = ["".join(p) for p in permutations(letters)]
    pick = np.ones((len(orders), len(letters), len(letters), 2), np.int64)
    for i, order in enumerate(orders):
        for step, letter in enumerate(order):
            pick[i, step, [letters.index(x) for x in order[:step]], 1] = 0
            pick[i, step, letters.index(letter), 0] = 0
    return orders, pick


def contract(tensor: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Sums of ``tensor`` (axes, then measures) under each row of ``pick``
    (rows, axes, 2)."""
    axes = "abcdefghijklmnopqrst"[:tensor.ndim - 1]
    return np.einsum(f"{axes}y,{','.join('z' + a for a in axes)}->zy", tensor, *np.moveaxis(pick, 1, 0), optimize=True)


def audit(cells: DataFrame, letters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """One row for each part, order of the filters and step: ``kept, removed,
    redundant, unique_fails, <mark>_lost ..., shapley``.  A task holds one part's
    cells, at most ``2 ** len(letters)``."""
    orders, pick = selectors(letters)
    n_steps = len(letters)
    own = np.array([[letters.index(x) for x in order] for order in orders])
    flat = pick.reshape(-1, n_steps, 2)
    passes = flat.copy()
    passes[np.arange(len(flat)), own.ravel()] = (1, 0)
    alone = np.zeros((n_steps, n_steps, 2), np.int64)      # fails one filter, passes the others
    alone[:, :, 0] = 1 - np.eye(n_steps, dtype=np.int64)
    alone[:, :, 1] = np.eye(n_steps, dtype=np.int64)
    fails = np.ones((n_steps, n_steps, 2), np.int64)
    fails[np.arange(n_steps), np.arange(n_steps), 0] = 0
    names = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(n, pa.int64()) for n in names]])

    def run(t: pa.Table) -> pa.Table:
        tensor = np.zeros((2,) * n_steps + (1 + len(marks),), np.int64)
        counts = np.array([t.column(c).to_numpy() for c in ("n", *marks)], np.int64).T
        for failed, row in zip(t.column("fails").to_pylist(), counts):
            tensor[tuple(int(x in failed) for x in letters)] += row
        removed = contract(tensor, flat)
        kept = contract(tensor, passes)[:, 0]
        unique, every = contract(tensor, alone)[:, 0], contract(tensor, fails)[:, 0]
        at = own.ravel()
        shapley = np.zeros(n_steps, np.int64)
        np.add.at(shapley, at, removed[:, 0])
        cols = [kept, removed[:, 0], every[at] - removed[:, 0], unique[at], *removed[:, 1:].T, shapley[at]]
        part = t.column("part")[0].as_py()
        return pa.Table.from_arrays([pa.array([part] * len(at)), pa.array(np.repeat(orders, n_steps)), pa.array(np.tile(np.arange(1, n_steps + 1, dtype=np.int32), len(orders))),
                                     *[pa.array(np.ascontiguousarray(c)) for c in cols]], schema=schema)

    return cells.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
