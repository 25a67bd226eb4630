"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by a seeded hash into buckets that fit in memory;
pass two shuffles each bucket by Fisher-Yates (numpy's permutation, seeded with
the bucket's number) and writes it.  The buckets one after another are a random
order of all rows, which is cut into shards of equal row counts (at most one
row apart).

Defined results: a null text counts 0 bytes plus the row's 8; rows that repeat
id and text go to one bucket in a fixed order; an empty table gives empty
shards.  Input columns named like an output column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemark.llm import common as C

BUCKET_BYTES = 32 << 20
SEED = 20240607


def shuffled(docs: DataFrame, id_col="doc_id", text_col="text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` with ``bucket_`` and ``pos_``, written bucket by bucket."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    total = docs.agg(F.sum(size)).first()[0] or 0
    # a few buckets for each partition, so that hashing deals them evenly
    n = max(4 * C.partitions(spark), -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = C.add(docs, key_=key, bucket_=F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(n)).cast("int"), pos_=F.lit(0))
    at = [f.name for f in rows.schema.fields]
    order = [("key_", "ascending"), (id_col, "ascending")]

    def fisher_yates(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        p = np.random.default_rng([seed, t.column("bucket_")[0].as_py()]).permutation(t.num_rows)
        return t.take(pa.array(p)).set_column(at.index("pos_"), "pos_", pa.array(np.arange(t.num_rows, dtype=np.int32)))

    out = rows.groupBy("bucket_").applyInArrow(fisher_yates, rows.schema)
    return C.written(out.drop("key_"), "buckets")


def shard(docs: DataFrame, n_shards: int, id_col="doc_id", text_col="text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``n_shards - 1``) and ``slot`` (0, 1, 2 ...
    within its shard).  Write with ``partitionBy("shard")``: a bucket touches
    one or two shards unless buckets outsize shards."""
    rows = shuffled(docs, id_col, text_col, bucket_bytes, seed)
    # one row a bucket
    before = (rows.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_"))
              .select("bucket_", F.coalesce(F.sum("n_").over(W.orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_")))
    count = rows.count()
    at = F.col("before_") + F.col("pos_")
    # shard s starts at ceil(s * count / n_shards)
    own = F.expr(f"(before_ + pos_) * {n_shards}L div {max(count, 1)}L")
    start = F.expr(f"(shard * {count}L + {n_shards - 1}L) div {n_shards}L")
    joined = rows.join(before, "bucket_")
    joined = C.add(joined, at_=at, shard=own.cast("int"))
    return C.add(joined, slot=(F.col("at_") - start).cast("long")).drop("bucket_", "pos_", "before_", "at_")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
