"""Session helpers.

The session is configured the way the library expects: UTC session time zone,
AQE on (runtime coalescing and skew-join splitting), no UI server.  On a
cluster the caller owns the session; these helpers only fill gaps.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Suggested settings for a large cluster (applied by the deployment, not here):
# AQE sizes shuffle partitions at run time from a generous initial count, and
# splits skewed join partitions; scans read ~256 MB splits.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "telemark", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that ``spark.checkpoint.dir`` names, which
    all executors share.  A private folder is made only where the setting is
    unset and the master is local, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="telemark-checkpoint-"))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for functions that run in Python there.
    Once a session; a folder on every worker's PYTHONPATH would do as well."""
    sc = spark.sparkContext
    if getattr(sc, "_telemark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="telemark-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("telemark", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._telemark_shipped = True
