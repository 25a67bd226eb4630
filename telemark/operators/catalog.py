"""Catalog enrichment and provenance merging.

Inputs are plain DataFrames: a table list ``(name)``, a table -> resource
type mapping ``(table_name, resource_type, manifest_file, pos)``, suggestion
entries and column metadata rows.  Grouped picks are partial aggregates
(``min`` over a struct), so a hot table or a code shared by many entries is
reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.functions.text import normalize_code
from telemark.operators.joins import table_counts  # noqa: F401  (C-2 lives with the union helpers)


def resource_types_per_table(mapping: DataFrame) -> DataFrame:
    """C-6 / C-3 ordered resource types per table (first appearance first)."""
    g = mapping.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("manifest_file", "pos", "resource_type"))).alias("_rts"))
    return g.select("table_name", F.transform("_rts", lambda s: s["resource_type"]).alias("resource_types"))


def attach_resource_types(tables: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """C-3 / J-10 every table with its primary resource type (first), default 'Unknown'."""
    rts = resource_types_per_table(mapping)
    j = tables.join(rts, tables[name] == rts.table_name, "left").drop("table_name")
    return j.withColumn("resource_type", F.coalesce(F.try_element_at("resource_types", F.lit(1)), F.lit("Unknown")))


def matched_split(tables: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """C-4 / J-11 matched (in a manifest) and unmatched tables, as a flag."""
    m = mapping.select(F.col("table_name").alias("_t")).distinct()
    return tables.join(m, tables[name] == m._t, "left").select(
        *[tables[c] for c in tables.columns], F.col("_t").isNotNull().alias("in_manifest"))


def provider_summary(tables: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """C-5 / A-21 per provider: (table, resource type) pairs and distinct resource types."""
    j = mapping.join(tables.select(F.col(name).alias("table_name")).distinct(), "table_name", "left_semi")
    return j.groupBy(F.split("resource_type", "/")[0].alias("provider")).agg(
        F.count(F.lit(1)).alias("tables"), F.count_distinct("resource_type").alias("resource_types"))


def reverse_index(mapping: DataFrame) -> DataFrame:
    """C-6 resource type -> sorted distinct tables."""
    return mapping.groupBy("resource_type").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def suggestion_merge(entries: DataFrame, table: str = "table_name", name: str = "name", code: str = "code",
                     rank: str = "source_rank", pos: str = "pos", manifest_rank: int = 0,
                     keep=None) -> DataFrame:
    """C-7 merge suggestions by source precedence (manifest > CSV > docs).

    Manifest entries (``rank == manifest_rank``) are all kept when named,
    with or without code.  Other entries need a name and code, and are kept
    only if no earlier named entry of the table (by rank, then position; an
    entry of unknown rank after all ranked ones) has the same normalised code.

    Plan: the owner of each (table, code) is picked by a partial ``min_by``
    aggregate over the eligible entries, keyed on the SHA-256 of the
    normalised code (digests are shuffled, not texts, and a code shared by a
    third of all rows is reduced map-side); owners from other sources are
    unioned with the manifest rows, which need no normalisation.  One
    normalisation pass, no join back.  ``keep`` names the output columns
    (default: all); columns not kept, such as the code text, are not carried
    through the aggregate."""
    cols = list(keep) if keep is not None else entries.columns
    cols = [table] + [c for c in cols if c != table]
    carried = [c for c in dict.fromkeys(cols + [rank, pos]) if c != table]
    named = F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
    manifest = entries.filter((F.col(rank) == manifest_rank) & named)
    nc = F.coalesce(normalize_code(F.col(code)), F.lit(""))
    eligible = entries.filter(named).withColumn("_nc", F.when(nc == "", F.lit("")).otherwise(F.sha2(nc, 256)))
    eligible = eligible.filter(F.col("_nc") != "")
    owners = eligible.groupBy(table, "_nc").agg(
        F.min_by(F.struct(*[F.col(c) for c in carried]), F.struct(F.col(rank).isNull(), F.col(rank), F.col(pos))).alias("_o"))
    others = owners.select(table, *[F.col("_o." + c).alias(c) for c in carried]) \
                   .filter(F.col(rank).isNull() | (F.col(rank) != manifest_rank)).select(*cols)
    return manifest.select(*cols).unionByName(others)


def merge_quality(merged: DataFrame, table: str = "table_name", source: str = "source",
                  code: str = "code", description: str = "description") -> DataFrame:
    """C-8 tables per source and incomplete entries (no code or no description)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return merged.groupBy(source).agg(
        F.count_distinct(table).alias("tables"), F.count(F.lit(1)).alias("entries"),
        F.count_if(empty(code) | empty(description)).alias("incomplete"))


def column_metadata_merge(cols: DataFrame) -> DataFrame:
    """C-9 per (table, column): the first non-empty type wins, and the number of
    different descriptions; ``column_descriptions`` lists these."""
    typed = F.when(F.coalesce(F.col("column_type"), F.lit("")) != "",
                   F.struct(F.col("manifest_file"), F.col("pos"), F.col("column_type")))
    return cols.groupBy("table_name", "column_name").agg(
        F.min(typed).alias("_t"),
        F.count_distinct(F.when(F.col("description") != "", F.sha2("description", 256))).alias("n_descriptions")
    ).select("table_name", "column_name", F.col("_t.column_type").alias("column_type"), "n_descriptions")


def column_descriptions(cols: DataFrame) -> DataFrame:
    """C-9 one row per (table, column, description), so that no group of
    descriptions is gathered in one value."""
    return cols.filter(F.coalesce(F.col("description"), F.lit("")) != "").select("table_name", "column_name", "description").distinct()


def metadata_fallback(primary: DataFrame, secondary: DataFrame, key: str, fields) -> DataFrame:
    """C-10 per field: the primary (manifest) value, else the secondary (docs) one."""
    p = primary.select(key, *[F.col(f).alias("p_" + f) for f in fields])
    s = secondary.select(key, *[F.col(f).alias("s_" + f) for f in fields])
    j = p.join(s, key, "full_outer")
    return j.select(key, *[F.coalesce(F.nullif(F.col("p_" + f).cast("string"), F.lit("")),
                                      F.col("s_" + f).cast("string")).alias(f) for f in fields])
