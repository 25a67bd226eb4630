"""Incremental rebuild of a stored example index.

Layout below one shared folder::

    rows/build=N/part=<domain>/   index rows of the domains that build N replaced
    plan/build=N/                 what build N found: current header, dirty or not, why
    header/build=N/               one row a domain: its header and the build that holds its rows

A rebuild compares the stored header with that of the current examples, brings
only the dirty domains (``vectors`` sees no others), writes their rows beside
the old ones and the header last.  Readers go by the newest complete header, so
a driver lost at any point before that leaves the old state; the next rebuild
takes the same number again and overwrites what was begun.  Domains without
examples leave the header.  A null domain is a domain of its own.

One rebuild of an index runs at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.operators import retrieve as R

HEADER = "part string, domain string, n_examples long, vector_dim int, examples_hash string, schema_version int, build long"


def _part(domain: str) -> Column:
    """Folder name of a domain; no name reads back as a null or a number."""
    d = F.col(domain).cast("string")
    return F.when(d.isNull(), F.lit("none")).otherwise(F.concat(F.lit("d-"), d))


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(build, folder, complete) below ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        m = re.fullmatch(r"build=(\d+)", s.getPath().getName())
        if m:
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
            found.append((int(m[1]), s.getPath().toString(), done))
    return sorted(found)


def _newest(spark: SparkSession, path: str) -> int:
    return max((n for n, _, done in _folders(spark, f"{path}/header") if done), default=0)


def stored_header(spark: SparkSession, path: str) -> DataFrame:
    """Header of the newest complete build; no rows where there is none."""
    n = _newest(spark, path)
    return spark.read.schema(HEADER).parquet(f"{path}/header/build={n}") if n else spark.createDataFrame([], HEADER)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the newest complete state: domain, id, question, answer,
    question_hash, vector.  Only folders that the header names are read."""
    header = stored_header(spark, path).select("part", "build")
    builds = [r.build for r in header.select("build").distinct().collect()]     # a number for each build still in use
    if not builds:
        raise FileNotFoundError(f"no complete index at {path}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/build={b}" for b in builds])
    return rows.withColumn("build", F.col("build").cast("long")).join(header, ["part", "build"], "left_semi").drop("part", "build")


def rebuild_index(examples: DataFrame, path: str, domain: str, id_col: str, question: str, answer: str,
                  vec: str | None = None, vectors=None, vector_dim: int | None = None, force: bool = False) -> DataFrame:
    """Bring the index at ``path`` up to date with ``examples``.

    Vectors come from the column ``vec`` or from ``vectors``, a function from the
    index rows of the dirty domains to the same rows with ``vector`` filled.  A
    domain is dirty when forced, missing, of another schema version, or changed
    in any example, or when its vectors have not ``vector_dim`` numbers (where
    given).  Returns what was decided: ``domain, dirty, reason``."""
    spark = examples.sparkSession
    stored, build = stored_header(spark, path), _newest(spark, path) + 1
    source = examples.withColumn("_part", _part(domain))
    rows = R.index_rows(source, domain, id_col, question, answer, vec)
    keyed = R.index_rows(source, "_part", id_col, question, answer)
    current = R.index_header(keyed).withColumn("vector_dim", F.lit(vector_dim).cast("int"))
    dirty = R.dirty_domains(stored.withColumn("domain", F.col("part")).drop("part", "build"), current, force)
    current.join(dirty, "domain").withColumnRenamed("domain", "part").write.mode("overwrite").parquet(f"{path}/plan/build={build}")
    plan = spark.read.parquet(f"{path}/plan/build={build}")

    name = F.when(F.col("part") != "none", F.substring("part", 3, 2**31 - 1)).alias("domain")
    changed = plan.filter("dirty").select("part")
    fresh = spark.createDataFrame([], "part string, vector_dim int")
    if not changed.isEmpty():
        rows = rows.withColumn("domain", F.col("domain").cast("string")).withColumn("part", _part("domain")).join(changed, "part", "left_semi").drop("_rh")
        rows = vectors(rows) if vectors else rows
        place = f"{path}/rows/build={build}"
        # ranges of (domain, id): few files a domain, and a large one over many tasks
        rows.repartitionByRange("part", "id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(place)
        fresh = spark.read.parquet(place).groupBy("part").agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("vector_dim"))
        fresh = fresh.withColumn("vector_dim", F.greatest("vector_dim", F.lit(0)))
    kept = stored.join(plan.filter("not dirty").select("part"), "part", "left_semi").select("part", "domain", "n_examples", "vector_dim", "examples_hash", "schema_version", "build")
    new = plan.filter("dirty").drop("vector_dim").join(fresh, "part").select(
        "part", name, "n_examples", "vector_dim", "examples_hash", "schema_version", F.lit(build).cast("long").alias("build"))
    if not changed.isEmpty() or kept.count() != stored.count():
        kept.unionByName(new).write.mode("overwrite").parquet(f"{path}/header/build={build}")
    return plan.select(name, "dirty", "reason")


def vacuum_index(spark: SparkSession, path: str) -> list[int]:
    """Remove what the newest complete header does not name: older headers and
    plans, and builds whose domains have all been replaced.  Returns the builds
    whose rows went.  Not while a reader or a rebuild is at work."""
    newest = _newest(spark, path)
    used = {r.build for r in stored_header(spark, path).select("build").distinct().collect()}
    if not newest:
        return []
    jvm, gone = spark.sparkContext._jvm, []
    for kind in ("rows", "plan", "header"):
        for n, folder, _ in _folders(spark, f"{path}/{kind}"):
            if (n in used) if kind == "rows" else (n == newest):
                continue
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            if kind == "rows":
                gone.append(n)
    return gone
