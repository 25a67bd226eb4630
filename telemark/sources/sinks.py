"""Report, index and run-log sinks.

Writes are plain DataFrame writers to a caller-given (shared) path.  Jobs
that are rerun after a lost executor recompute from their inputs; the index
sink replaces whole domain partitions atomically through dynamic partition
overwrite, so a retried write never leaves a half-written domain behind.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.functions.predicates import truncate

# Fixed values (S-16): fields removed from outward reports.
DROP_EXACT = ("reasoning", "explanation", "analysis")
DROP_PREFIX = "llm_"
PREVIEW_CHARS = 240


def strip_report_fields(df: DataFrame) -> DataFrame:
    """S-16 drop ``llm_*``, reasoning, explanation and analysis fields (top
    level and inside structs)."""
    def keep(name):
        return not (name.startswith(DROP_PREFIX) or name in DROP_EXACT)

    cols = []
    for f in df.schema.fields:
        if not keep(f.name):
            continue
        if f.dataType.typeName() == "struct":
            sub = [s.name for s in f.dataType.fields if keep(s.name)]
            cols.append(F.struct(*[F.col(f"`{f.name}`.`{s}`").alias(s) for s in sub]).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-16 JSON report."""
    strip_report_fields(df).write.mode(mode).json(path)


def flatten_exec_stats(df: DataFrame, keys: dict | None = None) -> DataFrame:
    """S-17 promote exec-stat map keys to columns.

    ``keys`` gives the keys of each map column, e.g. ``{"gen_stats": ["status"],
    "exp_stats": [...]}``; they become ``gen_status`` and so on, a name already
    taken getting ``_2``, ``_3``.  A map column without keys stays a map, so the
    plan needs no look at the data."""
    out = df
    for c, names in (keys or {}).items():
        if c not in df.columns:
            continue
        values = [F.col(x) for x in out.columns if x != c]
        taken = {x for x in out.columns if x != c}
        for k in names:
            base = f"{c.split('_')[0]}_" + re.sub(r"\W", "_", k)
            name, n = base, 1
            while name in taken:
                n += 1
                name = f"{base}_{n}"
            taken.add(name)
            values.append(F.col(c)[k].alias(name))
        out = out.select(*values)
    return out


def write_flat_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", keys: dict | None = None) -> None:
    """S-17 flat report table, one row per prompt; in CSV a map is JSON text."""
    flat = flatten_exec_stats(strip_report_fields(df), keys)
    if fmt == "csv":
        flat = flat.select(*[F.to_json(c).alias(c) if t.startswith("map<") else F.col(c) for c, t in flat.dtypes])
    w = flat.write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def annotate_input(cases: DataFrame, results: DataFrame, key: str = "case_id") -> DataFrame:
    """S-18 write generated query and status back next to each input row."""
    r = results.select(key, *[c for c in ("generated_query", "status") if c in results.columns])
    return cases.join(r, key, "left")


def write_index(rows: DataFrame, path: str) -> None:
    """S-19 index sink: one partition per domain; the domains in ``rows`` are
    replaced, the others stay, so a rebuild can bring the dirty ones alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)


def runlog_record(df: DataFrame, content: str = "content", full: bool = False) -> DataFrame:
    """S-20 run-log record: the content is replaced by a 16-hex SHA-256 and a
    240-character preview (``...TRUNCATED...`` suffix) unless ``full``."""
    c = F.col(content)
    preview = c if full else truncate(c, PREVIEW_CHARS)
    return df.withColumn("content_hash", F.when(F.coalesce(c, F.lit("")) != "", F.left(F.sha2(c, 256), F.lit(16)))) \
             .withColumn("content_preview", F.when(F.coalesce(c, F.lit("")) != "", preview)).drop(content)


def append_runlog(df: DataFrame, path: str) -> None:
    runlog_record(df).write.mode("append").json(path)
