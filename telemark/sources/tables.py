"""Driver tables: parquet scans with fixed names.

Reads are lazy; Catalyst prunes columns and pushes filters into each scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S-1 telemetry/driver table scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Attribute access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def all(self) -> dict:
        return {n: table(self.spark, self.sf_dir, n) for n in TABLES}


def constant_row(spark: SparkSession, **values) -> DataFrame:
    """S-15 ``print x = ...``: one row of constants, built by Spark."""
    from pyspark.sql import functions as F

    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def get_schema(df: DataFrame) -> DataFrame:
    """P-20 ``getschema | project ColumnName, ColumnType`` (schema-sized)."""
    return df.sparkSession.createDataFrame([(n, t) for n, t in df.dtypes], "ColumnName string, ColumnType string")


def first_columns(df: DataFrame, n: int = 40) -> DataFrame:
    """P-21 keep the first ``n`` columns (schema compaction)."""
    return df.select(*df.columns[:n])
