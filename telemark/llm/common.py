"""Helpers shared by the operators: the shared folder, written tables, and
column handling that survives extra columns with clashing names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 16
#: Bytes of rows that a task hands to Python at once.
BATCH_BYTES = 1 << 21
#: A word: a run of anything but ASCII space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    A private folder is made only where the setting is unset and the master is
    local, as in tests.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="telemark-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/telemark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a
    lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    w = df.write
    if codec:
        w = w.option("compression", codec)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on tasks hand rows to Python in batches of ``BATCH_BYTES``.  By
    default a batch ends at 10,000 rows, which for texts or their words are tens
    of megabytes, and a task holds it several times: as Arrow vectors and as a
    stream, both outside the heap, and again in the Python worker.  Neither
    gives all of that back to the system later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a task makes of them
    stays small.  After the last, Arrow gives back what it holds for later use:
    the worker lives on, beside the executor's heap, and by then it may hold as
    much again as it needs."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def add(df: DataFrame, **columns) -> DataFrame:
    """Add columns; an input column of the same name (in any case) gives way."""
    names = {n.lower() for n in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*keep, *[v.alias(n) for n, v in columns.items()])


def uniform(seed: int, *columns) -> F.Column:
    """Uniform in [0, 1) from a hash of the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") * F.lit(2.0 ** -53)


def bounded_sample(df: DataFrame, by: str, most: int, draw, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``by``: those whose ``draw`` (a
    uniform number) falls below ``most`` over the value's row count.  The counts
    cover all rows, and no class is ever brought together."""
    counts = counts or {r[0]: r[1] for r in df.groupBy(by).agg(F.count(F.lit(1))).collect()}
    rate = F.lit(0.0)
    for value, n in sorted(counts.items()):
        rate = F.when(F.col(by) == F.lit(value), F.lit(most / n)).otherwise(rate)
    return df.filter(draw < rate)


def bitmap(slots: DataFrame, bits: int):
    """A bitmap of ``2 ** bits`` bits, whatever the input's size, from rows of
    one number ``slot`` each; ``probe`` reads it.  The tasks fill blocks of
    ``2 ** BLOCK_BITS`` bits; only these come to the driver."""
    def packed(batches: Iterator[pa.RecordBatch]):
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            slot = np.sort(b.column("slot").to_numpy())
            block, first = np.unique(slot >> BLOCK_BITS, return_index=True)
            for k, at in zip(block.tolist(), np.split(slot & ((1 << BLOCK_BITS) - 1), first[1:])):
                held = blocks.setdefault(k, np.zeros(1 << (BLOCK_BITS - 3), np.uint8))
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"block": list(blocks), "bytes": [x.tobytes() for x in blocks.values()]},
                                         schema=pa.schema([("block", pa.int64()), ("bytes", pa.binary())]))

    size = 1 << (BLOCK_BITS - 3)
    out = np.zeros(max(1 << (bits - 3), size), np.uint8)
    parts = slots.select(F.col("slot").cast("long")).distinct().repartition(F.shiftright("slot", BLOCK_BITS))
    for r in parts.mapInArrow(packed, "block long, bytes binary").collect():
        out[r.block * size:(r.block + 1) * size] = np.frombuffer(r.bytes, np.uint8)
    return out[:1 << (bits - 3)]


def probe(bits_of, slot):
    """Whether each slot's bit is set."""
    return ((bits_of[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def without(rows: DataFrame, key: str, keys: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose ``key`` is not among ``keys`` (one column of the same name,
    no nulls).  Rows that a fixed-size bitmap of the keys clears pass at once;
    only the others are shuffled to meet the keys."""
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    keys = written(keys.select(F.col(key).alias("without_")).distinct(), "keys")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(slot("without_").alias("slot")), bits))

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(probe(shared.value, s.to_numpy().astype(np.uint64)))

    hit = maybe(slot(F.col(key)))
    return rows.filter(~hit).union(rows.filter(hit).join(keys, F.col(key) == F.col("without_"), "left_anti"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank_``: 0, 1, 2 ... over all rows in this order, without
    sending all rows to one task: range partitions are numbered each on its own
    and shifted by the counts of those before."""
    from pyspark.sql import Window as W

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id()), "ranked")
    before = (parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
              .withColumn("before_", F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))))
    return (parts.join(before, "part_")
            .withColumn("rank_", F.col("at_") - F.col("first_") + F.coalesce("before_", F.lit(0)))
            .drop("part_", "at_", "n_", "first_", "before_"))
