"""Streaming forms of R-1, R-2 and R-9 (an extension; the reference has no streams).

The same filters and aggregates as the batch queries, over a streaming
DataFrame with a caller-set watermark and epoch-aligned tumbling windows, so
state for closed windows is dropped and late rows beyond the watermark are
ignored (append mode emits each window once, when it closes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.functions import aggs, enrich as D
from telemark.plans.telemetry import failed, with_item_count


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def failed_by_bucket_stream(events: DataFrame, bucket: str = "1 hour", watermark: str = "10 minutes",
                            ts: str = "ts") -> DataFrame:
    """R-2 failed / total weighted count per tumbling window."""
    ev = with_item_count(_event_time(events, ts)).withWatermark(ts, watermark)
    out = ev.groupBy(F.window(ts, bucket).alias("w")).agg(
        aggs.sumif("item_count", failed()).cast("bigint").alias("failed_count"),
        F.sum("item_count").cast("bigint").alias("total_count"))
    return out.select(F.col("w.start").alias("bucket"), "failed_count", "total_count")


def failed_total_stream(events: DataFrame, bucket: str = "1 day", watermark: str = "10 minutes",
                        ts: str = "ts") -> DataFrame:
    """R-1 failed weighted count per window."""
    ev = with_item_count(_event_time(events, ts)).withWatermark(ts, watermark)
    out = ev.groupBy(F.window(ts, bucket).alias("w")).agg(
        aggs.sumif("item_count", failed()).cast("bigint").alias("failed_count"),
        aggs.countif(failed()).alias("failed_rows"))
    return out.select(F.col("w.start").alias("bucket"), "failed_count", "failed_rows")


def error_rate_stream(events: DataFrame, bucket: str = "1 day", watermark: str = "10 minutes",
                      ts: str = "ts", level: str = "event_type", workload: str = "user_id") -> DataFrame:
    """R-9 error rate per workload and tumbling window."""
    ev = _event_time(events, ts).withWatermark(ts, watermark).withColumn("is_error", D.is_error(level))
    out = ev.groupBy(F.col(workload).alias("workload"), F.window(ts, bucket).alias("w")).agg(
        aggs.count_all().alias("total"), aggs.countif(F.col("is_error")).alias("errors"))
    return out.select("workload", F.col("w.start").alias("bucket"), "total", "errors",
                      F.round(F.lit(100.0) * F.col("errors") / F.greatest(F.col("total"), F.lit(1)), 4)
                      .alias("error_rate_pct"))


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Drive a streaming query to completion over the available input
    (``availableNow``) into an in-memory table; for tests and small jobs."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)
