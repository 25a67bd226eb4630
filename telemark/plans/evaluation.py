"""Result comparison and scoring queries on two variants of an
orders aggregate.

Cases are order priorities.  The *expected* result of a case is the per
customer order count and amount over all its orders; the *generated* result
is the same aggregate computed without pending orders, with differently
spelled column names (``CustKey``, ``n_order``, ``TotalPrice``), so schema
alignment, row overlap and scores are all exercised on data that grows with
the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.operators import compare as E
from telemark.plans.registry import register
from telemark.sources.tables import Tables

EXPECTED_COLS = ["o_custkey", "n_orders", "total_price"]
ACTUAL_COLS = ["CustKey", "n_order", "TotalPrice"]


def eval_sides(orders: DataFrame):
    exp = orders.groupBy(F.col("o_orderpriority").alias("case_id"), "o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    act = (orders.filter(F.col("o_orderstatus") != "P")
                 .groupBy(F.col("o_orderpriority").alias("case_id"), F.col("o_custkey").alias("CustKey"))
                 .agg(F.count(F.lit(1)).alias("n_order"), F.round(F.sum("o_totalprice"), 2).alias("TotalPrice")))
    return exp, act


def row_overlap_q(orders: DataFrame) -> DataFrame:
    exp, act = eval_sides(orders)
    out = E.row_overlap(exp, act, "case_id", EXPECTED_COLS, ACTUAL_COLS)
    return out.withColumn("overlap", F.round("overlap", 6))


def ordered_overlap_q(orders: DataFrame) -> DataFrame:
    exp, act = eval_sides(orders)
    out = E.ordered_overlap(exp, act, "case_id",
                            [F.desc("n_orders"), F.desc("total_price"), F.asc("o_custkey")],
                            [F.desc("n_order"), F.desc("TotalPrice"), F.asc("CustKey")],
                            EXPECTED_COLS, ACTUAL_COLS)
    return out.withColumn("overlap", F.round("overlap", 6))


def _scored(orders: DataFrame) -> DataFrame:
    """Per-case scores plus the returned row count (one row-overlap plan)."""
    exp, act = eval_sides(orders)
    sc = E.schema_compare(EXPECTED_COLS, ACTUAL_COLS, strict_order=False)
    ro = E.row_overlap(exp, act, "case_id", EXPECTED_COLS, ACTUAL_COLS)
    s = E.score(F.lit(sc["overlap_ratio"]), "overlap", similarity=F.lit(None).cast("double"),
                generated_text=F.lit("generated"), error=F.lit(None).cast("string"), status=F.lit("success"))
    out = ro.select("case_id", F.lit(sc["overlap_ratio"]).alias("schema_overlap"),
                    F.round("overlap", 6).alias("rows_overlap"), "actual_count", s.alias("s"))
    return out.select(
        "case_id", "schema_overlap", "rows_overlap", "s.results_match", "s.total_score", "s.is_successful",
        E.score_band("s.total_score").alias("band"),
        E.zero_rows_warning("rows_overlap", "actual_count").alias("zero_rows_warning"),
        E.case_status(F.lit("generated"), None, F.lit(None), F.lit(None)).alias("status"), "actual_count")


SCORE_COLUMNS = ["case_id", "schema_overlap", "rows_overlap", "results_match", "total_score", "is_successful",
                 "band", "zero_rows_warning", "status"]


def score_cases_q(orders: DataFrame) -> DataFrame:
    """E-9, E-10, E-15, E-16, E-17 per case."""
    return _scored(orders).select(*SCORE_COLUMNS)


def eval_summary_q(orders: DataFrame) -> DataFrame:
    """E-14 over the scored cases (no case has a critical issue here)."""
    cases = score_cases_q(orders).withColumn("critical_issue", F.lit(None).cast("string"))
    return E.evaluation_summary(cases, metrics=("schema_overlap", "rows_overlap", "total_score"))


def batch_summary_q(orders: DataFrame) -> DataFrame:
    """E-13 over the scored cases."""
    return E.batch_summary(_scored(orders), returned_count="actual_count")


_SIDES_SQL = """
e AS (SELECT o_orderpriority AS case_id, o_custkey AS c1, count(*) AS c2, round(sum(o_totalprice), 2) AS c3
      FROM orders GROUP BY 1, 2),
a AS (SELECT o_orderpriority AS case_id, o_custkey AS c1, count(*) AS c2, round(sum(o_totalprice), 2) AS c3
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)"""

_ROW_OVERLAP_SQL = f"""
WITH {_SIDES_SQL},
ec AS (SELECT case_id, c1, c2, c3, count(*) AS ne FROM e GROUP BY ALL),
ac AS (SELECT case_id, c1, c2, c3, count(*) AS na FROM a GROUP BY ALL),
j AS (SELECT coalesce(ec.case_id, ac.case_id) AS case_id, coalesce(ne, 0) AS ne, coalesce(na, 0) AS na
      FROM ec FULL OUTER JOIN ac ON ec.case_id = ac.case_id AND ec.c1 = ac.c1 AND ec.c2 = ac.c2 AND ec.c3 = ac.c3),
ro AS (SELECT case_id, CAST(sum(ne) AS BIGINT) AS expected_count, CAST(sum(na) AS BIGINT) AS actual_count,
              CAST(sum(least(ne, na)) AS BIGINT) AS intersection, CAST(sum(greatest(ne, na)) AS BIGINT) AS union_size,
              bool_and(ne = na) AS is_match
       FROM j GROUP BY case_id)
"""


@register("row_overlap", _ROW_OVERLAP_SQL + """
SELECT case_id, expected_count, actual_count, intersection, union_size,
       round(CASE WHEN union_size = 0 THEN 1.0 ELSE intersection / union_size END, 6) AS overlap, is_match,
       CAST(CASE WHEN is_match THEN 0 ELSE abs(expected_count - actual_count) END AS BIGINT) AS mismatches
FROM ro
""")
def row_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_overlap_q(Tables(spark, sf_dir).orders)


@register("ordered_overlap", f"""
WITH {_SIDES_SQL},
en AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c2 DESC, c3 DESC, c1 ASC) AS pos FROM e),
an AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c2 DESC, c3 DESC, c1 ASC) AS pos FROM a),
j AS (SELECT coalesce(en.case_id, an.case_id) AS case_id, en.pos IS NOT NULL AS has_e, an.pos IS NOT NULL AS has_a,
             coalesce(en.c1 = an.c1 AND en.c2 = an.c2 AND en.c3 = an.c3, false) AS eq
      FROM en FULL OUTER JOIN an ON en.case_id = an.case_id AND en.pos = an.pos),
g AS (SELECT case_id, count(*) FILTER (WHERE has_e) AS expected_count, count(*) FILTER (WHERE has_a) AS actual_count,
             count(*) FILTER (WHERE has_e AND has_a AND eq) AS matched, count(*) FILTER (WHERE has_e AND has_a) AS paired
      FROM j GROUP BY case_id)
SELECT case_id, expected_count, actual_count, matched,
       round(matched / greatest(expected_count, 1), 6) AS overlap,
       CAST((paired - matched) + abs(expected_count - actual_count) AS BIGINT) AS mismatches,
       (paired = matched AND expected_count = actual_count) AS is_match
FROM g
""")
def ordered_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_overlap_q(Tables(spark, sf_dir).orders)


_SCORE_SQL = _ROW_OVERLAP_SQL + """,
ov AS (SELECT case_id, actual_count, CASE WHEN union_size = 0 THEN 1.0 ELSE intersection / union_size END AS overlap FROM ro),
sc AS (SELECT case_id, actual_count, overlap, (1.0 + overlap) / 2.0 AS result,
              ((1.0 + overlap) / 2.0) * 0.5 + 0.5 * 0.5 AS total FROM ov),
cases AS (
SELECT case_id, CAST(1.0 AS DOUBLE) AS schema_overlap, round(overlap, 6) AS rows_overlap, round(result, 3) AS results_match,
       round(total, 3) AS total_score, total >= 0.9 AS is_successful,
       CASE WHEN round(total, 3) >= 0.95 THEN 'perfect' WHEN round(total, 3) >= 0.7 THEN 'good' ELSE 'poor' END AS band,
       coalesce(round(overlap, 6) = 1.0 AND actual_count = 0, false) AS zero_rows_warning, 'success' AS status,
       actual_count
FROM sc)
"""


@register("score_cases", _SCORE_SQL + """
SELECT case_id, schema_overlap, rows_overlap, results_match, total_score, is_successful, band, zero_rows_warning, status
FROM cases
""")
def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_cases_q(Tables(spark, sf_dir).orders)


@register("eval_summary", _SCORE_SQL + """
SELECT count(*) AS total_count, count(*) AS valid_count, CAST(0 AS BIGINT) AS invalid_count,
       CAST(0 AS BIGINT) AS auth_count, CAST(0 AS BIGINT) AS syntax_count,
       round(avg(schema_overlap), 3) AS avg_schema_overlap, round(avg(rows_overlap), 3) AS avg_rows_overlap,
       round(avg(total_score), 3) AS avg_total_score,
       round(CASE WHEN count(*) > 0 THEN count(*) * 100.0 / count(*) ELSE 0.0 END, 2) AS valid_rate,
       round(CASE WHEN count(*) > 0 THEN 0 * 100.0 / count(*) ELSE 0.0 END, 2) AS invalid_rate,
       CAST(0.0 AS DOUBLE) AS auth_rate, CAST(0.0 AS DOUBLE) AS syntax_rate
FROM cases
""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_summary_q(Tables(spark, sf_dir).orders)


@register("batch_summary", _SCORE_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful,
       count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'wrong_query') AS wrong_query,
       CAST(coalesce(sum(actual_count), 0) AS BIGINT) AS total_returned_rows
FROM cases
""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary_q(Tables(spark, sf_dir).orders)


def table_compare_q(orders: DataFrame) -> DataFrame:
    """E-18 whole-table data-quality comparison of the two aggregates (all
    cases together, case id kept as a column of both tables)."""
    exp, act = eval_sides(orders)
    out = E.compare_tables(exp.select("case_id", *EXPECTED_COLS), act.select("case_id", *ACTUAL_COLS))
    return out.withColumn("overlap", F.round("overlap", 6))


@register("table_compare", f"""
WITH {_SIDES_SQL},
ec AS (SELECT case_id, c1, c2, c3, count(*) AS ne FROM e GROUP BY ALL),
ac AS (SELECT case_id, c1, c2, c3, count(*) AS na FROM a GROUP BY ALL),
j AS (SELECT coalesce(ne, 0) AS ne, coalesce(na, 0) AS na
      FROM ec FULL OUTER JOIN ac ON ec.case_id = ac.case_id AND ec.c1 = ac.c1 AND ec.c2 = ac.c2 AND ec.c3 = ac.c3),
ro AS (SELECT CAST(sum(ne) AS BIGINT) AS expected_count, CAST(sum(na) AS BIGINT) AS actual_count,
              CAST(sum(least(ne, na)) AS BIGINT) AS intersection, CAST(sum(greatest(ne, na)) AS BIGINT) AS union_size,
              bool_and(ne = na) AS is_match FROM j)
SELECT CAST(1.0 AS DOUBLE) AS schema_overlap, true AS schema_match, expected_count, actual_count, intersection,
       union_size, round(CASE WHEN union_size = 0 THEN 1.0 ELSE intersection / union_size END, 6) AS overlap,
       is_match, CAST(CASE WHEN is_match THEN 0 ELSE abs(expected_count - actual_count) END AS BIGINT) AS mismatches
FROM ro
""")
def table_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_compare_q(Tables(spark, sf_dir).orders)


def tolerant_overlap_q(orders: DataFrame) -> DataFrame:
    """E-7 in the unordered mode: for each customer, prices of fulfilled orders
    against those of open ones, within 20,000 or 10 % of the open price."""
    def side(status):
        return orders.filter(F.col("o_orderstatus") == status).select("o_custkey", F.col("o_totalprice").alias("price"))
    out = E.row_overlap(side("F"), side("O"), "o_custkey", tolerances={"numeric_abs": 20000.0, "numeric_rel": 0.1})
    return out.withColumn("overlap", F.round("overlap", 6))


# the recursion walks both sorted price lists of all customers at once
@register("tolerant_overlap", """
WITH RECURSIVE e AS (SELECT o_custkey AS c, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i
      FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT o_custkey AS c, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS j
      FROM orders WHERE o_orderstatus = 'O'),
walk AS (
  SELECT DISTINCT o_custkey AS c, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS m FROM orders
  UNION ALL
  SELECT w.c, CASE WHEN ok OR ev < av THEN w.i + 1 ELSE w.i END, CASE WHEN ok OR ev >= av THEN w.j + 1 ELSE w.j END,
         CASE WHEN ok THEN w.m + 1 ELSE w.m END
  FROM (SELECT walk.c, walk.i, walk.j, walk.m, e.v AS ev, a.v AS av,
               abs(e.v - a.v) <= 20000 OR abs(e.v - a.v) <= 0.1::DOUBLE * (abs(a.v) + 1e-12) AS ok
        FROM walk JOIN e ON e.c = walk.c AND e.i = walk.i JOIN a ON a.c = walk.c AND a.j = walk.j) w),
n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS expected_count,
             count(*) FILTER (WHERE o_orderstatus = 'O') AS actual_count
      FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey),
r AS (SELECT o_custkey, expected_count, actual_count, (SELECT max(m) FROM walk WHERE walk.c = o_custkey) AS intersection FROM n)
SELECT o_custkey, expected_count, actual_count, intersection, expected_count + actual_count - intersection AS union_size,
       round(intersection / (expected_count + actual_count - intersection), 6) AS overlap,
       expected_count = intersection AND actual_count = intersection AS is_match,
       CAST(CASE WHEN expected_count = intersection AND actual_count = intersection THEN 0
                 ELSE abs(expected_count - actual_count) END AS BIGINT) AS mismatches
FROM r
""")
def tolerant_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tolerant_overlap_q(Tables(spark, sf_dir).orders)
