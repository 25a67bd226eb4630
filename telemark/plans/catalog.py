"""Catalog, provenance and page queries over the driver tables.

Stand-ins: suggestion entries are ``documents`` (table = lang, name = doc_id,
code = text, description = first line, source precedence = the number in
``source``, ``src0`` playing the manifest); the table -> resource type mapping
is ``(source, lang/size-tier)``; pages are ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.operators import catalog as C
from telemark.operators import joins as J
from telemark.operators.pages import page_description
from telemark.plans.registry import register
from telemark.sources.tables import TABLES, Tables


def description():
    """Stand-in for an entry's description: where it comes from; none for short texts."""
    return F.when(F.col("n_chars") < 500, F.lit("")).otherwise(F.concat_ws("/", "lang", "source"))


def entries_of(documents: DataFrame) -> DataFrame:
    return J.spread(documents).select(
        F.col("lang").alias("table_name"), F.col("doc_id").cast("string").alias("name"),
        F.col("text").alias("code"), description().alias("description"),
        F.regexp_extract("source", r"(\d+)", 1).try_cast("int").alias("source_rank"),
        F.col("doc_id").alias("pos"), F.col("source"), F.col("doc_id"))


def mapping_of(documents: DataFrame) -> DataFrame:
    tier = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 10000, "medium").otherwise("long")
    m = documents.select(F.col("source").alias("table_name"), F.concat("lang", F.lit("/"), tier).alias("resource_type"),
                         "doc_id")
    return m.groupBy("table_name", "resource_type").agg(F.min("doc_id").alias("pos")).withColumn(
        "manifest_file", F.lit("docs"))


def suggestion_merge_q(documents: DataFrame) -> DataFrame:
    return C.suggestion_merge(entries_of(documents), keep=["table_name", "doc_id", "source"])


def merge_quality_q(documents: DataFrame) -> DataFrame:
    return C.merge_quality(C.suggestion_merge(entries_of(documents)))


def provider_summary_q(documents: DataFrame) -> DataFrame:
    tables = documents.select(F.col("source").alias("name")).distinct()
    return C.provider_summary(tables, mapping_of(documents))


def resource_index_q(documents: DataFrame) -> DataFrame:
    """C-3 + C-6: each table with its primary resource type and type count."""
    tables = documents.select(F.col("source").alias("name")).distinct()
    out = C.attach_resource_types(tables, mapping_of(documents))
    return out.select("name", "resource_type", F.size("resource_types").alias("n_types"))


def table_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.table_counts(Tables(spark, sf_dir).all())


def column_metadata_q(documents: DataFrame) -> DataFrame:
    cols = documents.select(
        F.col("lang").alias("table_name"), F.col("source").alias("column_name"),
        F.when(F.col("n_chars") < 1000, F.lit("")).when(F.col("n_chars") < 3000, F.lit("text")).otherwise(F.lit("longtext")).alias("column_type"),
        F.col("text").alias("description"), F.lit("docs").alias("manifest_file"),
        F.col("doc_id").alias("pos"))
    out = C.column_metadata_merge(cols)
    return out.select("table_name", "column_name", "column_type", "n_descriptions")


def page_description_q(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", page_description("html").alias("description"))


_NORM_CODE = ("regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), "
              "'^\\s+|\\s+$', '', 'g'), '\\n{2,}', chr(10), 'g')")
_ENTRIES = f"""
d AS (SELECT lang AS table_name, doc_id, source, CAST(doc_id AS VARCHAR) AS name, text AS code,
             CASE WHEN n_chars < 500 THEN '' ELSE lang || '/' || source END AS description,
             TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS rnk, {_NORM_CODE} AS nc FROM documents),
o AS (SELECT table_name, doc_id, row_number() OVER (PARTITION BY table_name, nc ORDER BY rnk NULLS LAST, doc_id) AS rn
      FROM d WHERE nc <> '' AND coalesce(name, '') <> ''),
m AS (SELECT d.* FROM d LEFT JOIN o ON d.table_name = o.table_name AND d.doc_id = o.doc_id
      WHERE (d.rnk = 0 AND coalesce(d.name, '') <> '') OR ((d.rnk IS NULL OR d.rnk <> 0) AND coalesce(d.name, '') <> '' AND o.rn = 1))"""


@register("suggestion_merge", f"WITH {_ENTRIES} SELECT table_name, doc_id, source FROM m")
def suggestion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestion_merge_q(Tables(spark, sf_dir).documents)


@register("merge_quality", f"""WITH {_ENTRIES}
SELECT source, count(DISTINCT table_name) AS tables, count(*) AS entries,
       count(*) FILTER (WHERE coalesce(code, '') = '' OR coalesce(description, '') = '') AS incomplete
FROM m GROUP BY source""")
def merge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_quality_q(Tables(spark, sf_dir).documents)


_MAPPING = """
mp AS (SELECT source AS table_name,
              lang || '/' || CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 10000 THEN 'medium' ELSE 'long' END
                AS resource_type, min(doc_id) AS pos
       FROM documents GROUP BY 1, 2)"""


@register("provider_summary", f"""WITH {_MAPPING}
SELECT split_part(resource_type, '/', 1) AS provider, count(*) AS tables, count(DISTINCT resource_type) AS resource_types
FROM mp WHERE table_name IN (SELECT source FROM documents) GROUP BY 1""")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provider_summary_q(Tables(spark, sf_dir).documents)


@register("resource_index", f"""WITH {_MAPPING},
t AS (SELECT DISTINCT source AS name FROM documents),
r AS (SELECT table_name, resource_type, count(*) OVER (PARTITION BY table_name) AS n,
             row_number() OVER (PARTITION BY table_name ORDER BY 'docs', pos) AS rn FROM mp)
SELECT t.name, coalesce(r.resource_type, 'Unknown') AS resource_type, CAST(r.n AS INTEGER) AS n_types
FROM t LEFT JOIN r ON t.name = r.table_name AND r.rn = 1""")
def resource_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resource_index_q(Tables(spark, sf_dir).documents)


@register("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_counts_q(spark, sf_dir)


@register("column_metadata", """
WITH c AS (SELECT lang AS table_name, source AS column_name,
                  CASE WHEN n_chars < 1000 THEN '' WHEN n_chars < 3000 THEN 'text' ELSE 'longtext' END AS ty,
                  text AS description, doc_id AS pos FROM documents)
SELECT table_name, column_name, arg_min(CASE WHEN ty <> '' THEN ty END, CASE WHEN ty <> '' THEN pos END) AS column_type,
       count(DISTINCT nullif(description, '')) AS n_descriptions
FROM c GROUP BY 1, 2""")
def column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_metadata_q(Tables(spark, sf_dir).documents)


@register("page_description", """
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>.*?</h1>\\s*<p>(.*?)</p>', 1),
                                              '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS description
FROM pages""")
def page_description_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_description_q(Tables(spark, sf_dir).pages)


def metadata_fallback_q(documents: DataFrame) -> DataFrame:
    """C-10 per table (language and size tier): the manifest value (``src0``),
    else that of the other sources by rank, field by field.  A side's value is
    that of its first document by source rank and id, sources without a rank
    last; an empty one is missing."""
    tier = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 10000, "medium").otherwise("long")
    rank = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    d = documents.select(F.concat_ws("/", "lang", tier).alias("table_name"), description().alias("description"), F.col("source").alias("origin"), rank.alias("rank"), "doc_id")

    def side(rows):
        first = F.min_by(F.struct("description", "origin"), F.struct(F.col("rank").isNull(), "rank", "doc_id")).alias("v")
        return rows.groupBy("table_name").agg(first).select("table_name", "v.description", "v.origin")
    return C.metadata_fallback(side(d.filter("rank = 0")), side(d.filter("rank is null or rank > 0")), "table_name", ["description", "origin"])


@register("metadata_fallback", """
WITH d AS (SELECT lang || '/' || CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 10000 THEN 'medium' ELSE 'long' END AS table_name,
                  CASE WHEN n_chars < 500 THEN '' ELSE lang || '/' || source END AS description, source AS origin,
                  TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS rnk, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, coalesce(rnk = 0, false) ORDER BY rnk NULLS LAST, doc_id) AS n FROM d),
p AS (SELECT * FROM r WHERE n = 1 AND rnk = 0), s AS (SELECT * FROM r WHERE n = 1 AND (rnk IS NULL OR rnk > 0))
SELECT coalesce(p.table_name, s.table_name) AS table_name,
       coalesce(nullif(p.description, ''), s.description) AS description,
       coalesce(nullif(p.origin, ''), s.origin) AS origin
FROM p FULL OUTER JOIN s ON p.table_name = s.table_name
""")
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_fallback_q(Tables(spark, sf_dir).documents)
