"""Corpus and evaluation-file loaders.

Everything is read by Spark (``spark.read.csv/json/text``); only the first line
of a CSV file is looked at on the driver to choose the reader options.  Line-
oriented formats are read whole per file (``wholetext``) and parsed with
regexes over the full text, then exploded, so each file is one task and a
corpus of many files spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.functions.text import strip_ws

# Fixed values (S-3): header synonyms, compared lower-cased after trimming.
PROMPT_HEADERS = ("prompt", "question", "nl", "natural language", "ask")
QUERY_HEADERS = ("query", "kql", "expected", "expected query", "expected_query")
DELIMITERS = (",", ";", "\t", "|")


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).collect()
    return (row[0][0] if row else "") or ""


def sniff_csv(spark: SparkSession, path: str) -> dict:
    """Pick delimiter and header mode from the first line only."""
    line = _first_line(spark, path).lstrip("﻿")
    counts = {d: line.count(d) for d in DELIMITERS}
    sep = max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))
    if counts[sep] == 0:
        sep = ","
    cells = [c.strip().strip('"').strip().lower() for c in line.split(sep)]
    has_header = any(c in PROMPT_HEADERS or c in QUERY_HEADERS for c in cells)
    return {"sep": sep, "header": has_header}


def _rename_synonyms(df: DataFrame) -> DataFrame:
    out = df
    for c in df.columns:
        k = c.strip().lstrip("﻿").strip().lower()
        if k in PROMPT_HEADERS:
            out = out.withColumnRenamed(c, "prompt")
        elif k in QUERY_HEADERS:
            out = out.withColumnRenamed(c, "expected_query")
    return out


def read_prompt_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-3 / S-8 prompt + expected-query CSV: header synonyms, delimiter
    fallback (, ; tab |), headerless two-column files, multi-line quoted cells
    with ``""`` escapes, BOM.  Rows with an empty prompt are left to
    ``bad_prompt_rows``; a ``case_id`` is added, different for each row."""
    return _with_case_id(_prompt_rows(spark, path).filter(_HAS_PROMPT))


def bad_prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    """S-3 quarantine: the rows that ``read_prompt_csv`` leaves out."""
    return _prompt_rows(spark, path).filter(f"not ({_HAS_PROMPT})")


_HAS_PROMPT = "coalesce(prompt, '') != ''"


def _with_case_id(df: DataFrame) -> DataFrame:
    """A hash of the row's texts and of how many equal rows stand before it."""
    from pyspark.sql import Window

    same = Window.partitionBy("prompt", "expected_query").orderBy(F.lit(0))
    return df.withColumn("_same", F.row_number().over(same)).withColumn("case_id", F.xxhash64("prompt", "expected_query", "_same")).drop("_same")


def _prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    opt = sniff_csv(spark, path)
    df = (spark.read.option("header", opt["header"]).option("sep", opt["sep"]).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path))
    if opt["header"]:
        df = _rename_synonyms(df)
    else:
        cols = df.columns
        df = df.select(F.col(cols[0]).alias("prompt"),
                       (F.col(cols[1]) if len(cols) > 1 else F.lit(None).cast("string")).alias("expected_query"))
    if "expected_query" not in df.columns:
        df = df.withColumn("expected_query", F.lit(None).cast("string"))
    df = df.select(strip_ws(F.regexp_replace("prompt", "^﻿", "")).alias("prompt"),
                   strip_ws("expected_query").alias("expected_query"))
    return df


def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """S-3 rule for one-line files with unquoted commas in the prompt: the
    last cell is the query, everything before it the prompt."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    pat = r'^(.*?),\s*("(?:[^"]|"")*"|[^,]*)\s*$'
    p = strip_ws(F.regexp_extract("line", pat, 1))
    q = strip_ws(F.regexp_extract("line", pat, 2))
    unq = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), '""', '"')
    out = lines.select(unq(p).alias("prompt"), unq(q).alias("expected_query"))
    out = out.filter((F.col("prompt") != "") & ~F.lower("prompt").isin(*PROMPT_HEADERS))
    return _with_case_id(out)


DATASET_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("expected_kql", T.StringType()), T.StructField("workspace_id", T.StringType()),
    T.StructField("time_range", T.StringType()), T.StructField("expected_output_path", T.StringType()),
    T.StructField("expected_output_hash", T.StringType()),
    T.StructField("required_columns", T.ArrayType(T.StringType())),
    T.StructField("required_operators", T.ArrayType(T.StringType())),
    T.StructField("tolerances", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("notes", T.StringType()),
])


def read_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """S-4 evaluation dataset: JSONL with a fixed schema, or CSV with
    ``|``-separated lists and JSON tolerances."""
    if path.lower().endswith(".jsonl") or path.lower().endswith(".json"):
        return spark.read.schema(DATASET_SCHEMA).json(path)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in [f.name for f in DATASET_SCHEMA.fields]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    lst = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.split(F.col(c), r"\|"))
    return df.select(
        "id", "prompt", "expected_kql", "workspace_id", "time_range", "expected_output_path", "expected_output_hash",
        lst("required_columns").alias("required_columns"), lst("required_operators").alias("required_operators"),
        F.coalesce(F.from_json(F.col("tolerances"), "map<string,double>"),
                   F.create_map().cast("map<string,double>")).alias("tolerances"), "notes")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, content)."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


_MD_PAIR = (r"(?m)^[ \t]*\*\*(.+?)\*\*[ \t]*\r?$[\s\S]*?^[ \t]*```(?i:kql)[ \t]*\r?\n([\s\S]*?)\r?\n[ \t]*```[ \t]*\r?$")


def _pairs(arr_q: Column, arr_k: Column, qname: str, kname: str) -> Column:
    return F.explode(F.arrays_zip(arr_q.alias(qname), arr_k.alias(kname)))


def read_markdown_examples(spark: SparkSession, path: str) -> DataFrame:
    """S-5 few-shot examples from markdown: a ``**question**`` line followed
    (possibly after other lines) by a fenced ``kql`` block; files without any
    such pair fall back to the legacy ``Q:`` / ``KQL:`` blocks."""
    docs = read_whole(spark, path)
    qs = F.regexp_extract_all("content", F.lit(_MD_PAIR), 1)
    ks = F.regexp_extract_all("content", F.lit(_MD_PAIR), 2)
    # Legacy: blocks start at lines beginning with "q:"; the query is what
    # follows the "kql:" line of the block.
    blocks = F.filter(F.split("content", r"(?im)^[ \t]*q:"), lambda b, i: i > 0)
    lq = F.transform(blocks, lambda b: strip_ws(F.regexp_extract(b, r"^([^\n]*)", 1)))
    lk = F.transform(blocks, lambda b: strip_ws(F.regexp_extract(b, r"(?ims)^[^\n]*\n.*?^[ \t]*kql:[^\n]*\n(.*)\z", 1)))
    use_md = F.size(qs) > 0
    q = F.when(use_md, F.transform(qs, strip_ws)).otherwise(lq)
    k = F.when(use_md, F.transform(ks, strip_ws)).otherwise(lk)
    out = docs.select("path", _pairs(q, k, "question", "kql").alias("p"))
    return out.select("path", "p.question", "p.kql").filter((F.col("question") != "") & (F.col("kql") != ""))


def read_markdown_catalog(spark: SparkSession, path: str, limit: int = 8, headings_only: bool = False,
                          heading_limit: int = 10) -> DataFrame:
    """S-6 / S-7 markdown catalog: each fenced block containing a pipe (or a
    one-line ``Table | ...`` candidate) is an example titled by the nearest
    heading above it, at most ``limit`` per file.  ``headings_only`` gives the
    ``# `` headings longer than 5 characters, first ``heading_limit``."""
    docs = read_whole(spark, path)
    lines = docs.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("s", F.trim("line"))
    if headings_only:
        h = lines.filter(F.startswith("s", F.lit("# ")) & (F.length("s") > 5))
        from telemark.operators.latest import first_k_per_group
        return first_k_per_group(h.select("path", "pos", F.expr("substring(s, 3)").alias("title")), "path",
                                 [F.col("pos")], heading_limit)
    from pyspark.sql import Window
    w = Window.partitionBy("path").orderBy("pos")
    is_fence = F.startswith("s", F.lit("```"))
    is_head = F.startswith("s", F.lit("#"))
    lines = (lines.withColumn("fences_before", F.sum(is_fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
                  .withColumn("title", F.last(F.when(is_head, F.regexp_replace("s", r"^[#\s]+", "")), ignorenulls=True)
                              .over(w.rowsBetween(Window.unboundedPreceding, 0))))
    in_code = F.coalesce(F.col("fences_before"), F.lit(0)) % 2 == 1
    code_lines = lines.filter(in_code & ~is_fence).groupBy("path", "fences_before").agg(
        F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "\n").alias("kql"))
    code = code_lines.select("path", "pos", "title", strip_ws("kql").alias("kql")).filter(F.contains("kql", F.lit("|")))
    single = lines.filter(~in_code & ~is_fence & ~is_head & F.col("s").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*\|")) \
                  .select("path", "pos", "title", F.col("s").alias("kql"))
    from telemark.operators.latest import first_k_per_group
    return first_k_per_group(code.unionByName(single), "path", [F.col("pos")], limit)


def read_tab_dump(spark: SparkSession, path: str) -> DataFrame:
    """S-9 text dump of ``"prompt"<tab>"query"`` records (quoted cells may span lines)."""
    docs = read_whole(spark, path)
    pat = r'"((?:[^"]|"")*)"\t"((?:[^"]|"")*)"'
    q = F.regexp_extract_all("content", F.lit(pat), 1)
    k = F.regexp_extract_all("content", F.lit(pat), 2)
    out = docs.select(_pairs(q, k, "prompt", "query").alias("p"))
    unq = lambda c: strip_ws(F.regexp_replace(c, '""', '"'))
    return out.select(unq(F.col("p.prompt")).alias("prompt"), unq(F.col("p.query")).alias("query"))


def read_table_suggestions(spark: SparkSession, path: str, file_to_table: dict) -> DataFrame:
    """S-10 per-table suggestion CSVs; the table comes from the file name via
    ``file_to_table``; files not in the map are skipped."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
          .withColumn("file", F.col("_metadata.file_name")))
    m = F.create_map(*[x for kv in file_to_table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    df = _rename_synonyms(df).withColumn("table_name", m[F.col("file")]).filter(F.col("table_name").isNotNull())
    return df.select("table_name", F.col("prompt").alias("name"), F.col("expected_query").alias("code"),
                     F.lit("capsule-csv").alias("source"), "file")


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-13 expected-rows snapshot: header row, every cell a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True) \
        .option("escape", '"').csv(path)


RUNLOG_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("purpose", T.StringType()),
    T.StructField("deployment", T.StringType()), T.StructField("api_version", T.StringType()),
    T.StructField("is_o_model", T.BooleanType()), T.StructField("attempts", T.LongType()),
    T.StructField("escalated", T.BooleanType()), T.StructField("finish_reason", T.StringType()),
    T.StructField("error_code", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("initial_max_tokens", T.LongType()), T.StructField("final_max_tokens", T.LongType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("top_p", T.DoubleType()),
    T.StructField("content_hash", T.StringType()), T.StructField("content_preview", T.StringType()),
    T.StructField("usage", T.MapType(T.StringType(), T.LongType())),
    T.StructField("extra", T.StringType()),
])


def read_runlog(spark: SparkSession, path: str) -> DataFrame:
    """S-14 run-log JSONL with an explicit schema (``extra`` kept as JSON text)."""
    df = spark.read.schema(RUNLOG_SCHEMA).json(path)
    return df.withColumn("ts", F.try_to_timestamp(F.regexp_replace("ts", "Z$", "")))
