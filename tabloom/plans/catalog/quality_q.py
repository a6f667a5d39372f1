"""Registered quality-audit queries (Q1–Q16) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import patterns as P
from ...operators import quality
from ..faults import FAULTY_ORDERS_COLUMNS
from ._common import FAULTY_ORDERS_CTE, faulty_orders, r, rounded, union_all

TARGET = "o_orderstatus"


def q_quality_issues_orders(spark, sf_dir):
    rep = quality.audit(faulty_orders(spark, sf_dir), TARGET)
    return rounded(rep.issues.select("issue_type", F.col("column").alias("col_name"), "severity", "affected_count", "affected_pct"))


def q_quality_score_orders(spark, sf_dir):
    return rounded(quality.audit(faulty_orders(spark, sf_dir), TARGET).score)


def q_outlier_summary_orders(spark, sf_dir):
    st = quality.audit(faulty_orders(spark, sf_dir), TARGET).columns
    return rounded(
        st.where(F.col("outside") > 0).select(
            F.col("column").alias("col_name"), "q25", "q75", F.col("lower").alias("lower_bound"),
            F.col("upper").alias("upper_bound"), F.col("outside").alias("outlier_count"),
            F.round(F.col("outside") / F.col("n") * 100.0, 2).alias("outlier_pct"),
        )
    )


def _col_stats_sql() -> str:
    parts = []
    ph = ", ".join("'" + v + "'" for v in P.PLACEHOLDER_NULLS)
    for i, (c, kind) in enumerate(FAULTY_ORDERS_COLUMNS):
        num = kind == "numeric"
        x = f"CAST({c} AS DOUBLE)" if num else "NULL::DOUBLE"
        hidden = f"count(*) FILTER (WHERE lower(trim(CAST({c} AS VARCHAR))) IN ({ph}))" if kind == "categorical" else "0"
        parts.append(
            f"SELECT '{c}' AS col_name, {i} AS ord, {'TRUE' if num else 'FALSE'} AS is_num, count(*) AS n_rows, "
            f"count(*) - count({c}) AS missing, count({c}) AS n, count(DISTINCT {c}) AS d, {hidden} AS hidden, "
            f"quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75, avg({x}) AS mu, stddev_samp({x}) AS sd, "
            f"count(*) FILTER (WHERE {x} < 0) AS neg FROM faulty"
        )
    return union_all(parts)


def _bounds_sql() -> str:
    return f"""
cs AS ({_col_stats_sql()}),
bnd AS (
  SELECT *, q75 - q25 AS iqr,
    CASE WHEN is_num AND n > {P.OUTLIER_MIN_VALUES} AND q75 - q25 > 0 THEN q25 - 3.0 * (q75 - q25)
         WHEN is_num AND n > {P.OUTLIER_MIN_VALUES} AND sd > 0 THEN mu - 3.0 * sd END AS lo,
    CASE WHEN is_num AND n > {P.OUTLIER_MIN_VALUES} AND q75 - q25 > 0 THEN q75 + 3.0 * (q75 - q25)
         WHEN is_num AND n > {P.OUTLIER_MIN_VALUES} AND sd > 0 THEN mu + 3.0 * sd END AS hi
  FROM cs
),
outs AS ({union_all([f"SELECT '{c}' AS col_name, count(*) FILTER (WHERE CAST(f.{c} AS DOUBLE) < b.lo OR CAST(f.{c} AS DOUBLE) > b.hi) AS outside FROM faulty f, bnd b WHERE b.col_name = '{c}'" for c, k in FAULTY_ORDERS_COLUMNS if k == 'numeric'])}),
st AS (SELECT b.*, o.outside FROM bnd b LEFT JOIN outs o USING (col_name))"""


def _issues_sql() -> str:
    neg = P.NON_NEGATIVE_NAME_PATTERN
    return f"""WITH {FAULTY_ORDERS_CTE},
{_bounds_sql()},
dup AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM faulty)) AS dups FROM faulty),
tgt AS (SELECT {TARGET} AS v, count(*) AS c FROM faulty WHERE {TARGET} IS NOT NULL GROUP BY 1),
tagg AS (SELECT count(*) AS k, min(c) AS cmin, sum(c) AS cn FROM tgt),
issues AS (
  SELECT 'duplicate_rows' AS issue_type, NULL::VARCHAR AS col_name,
    CASE WHEN round(dups * 100.0 / n, 2) > 10 THEN 'high' WHEN round(dups * 100.0 / n, 2) > 1 THEN 'medium' ELSE 'low' END AS severity,
    dups AS affected_count, round(dups * 100.0 / n, 2) AS affected_pct FROM dup WHERE dups > 0
  UNION ALL
  SELECT 'target_missing_values', col_name, 'critical', missing, round(missing * 100.0 / n_rows, 2) FROM st WHERE col_name = '{TARGET}' AND missing > 0
  UNION ALL
  SELECT 'severe_class_imbalance', '{TARGET}', 'high', cmin, round(cmin * 100.0 / cn, 2) FROM tagg
    WHERE k <= {P.IMBALANCE_MAX_CLASSES} AND cn > 0 AND cmin * 100.0 / cn < {P.IMBALANCE_MIN_CLASS_PCT}
  UNION ALL
  SELECT CASE WHEN round(missing * 100.0 / n_rows, 2) >= 80 THEN 'extreme_missing_values'
              WHEN round(missing * 100.0 / n_rows, 2) >= 40 THEN 'high_missing_values' ELSE 'missing_values' END,
         col_name,
         CASE WHEN round(missing * 100.0 / n_rows, 2) >= 80 THEN 'critical'
              WHEN round(missing * 100.0 / n_rows, 2) >= 40 THEN 'high' ELSE 'low' END,
         missing, round(missing * 100.0 / n_rows, 2) FROM st WHERE round(missing * 100.0 / n_rows, 2) > 0
  UNION ALL
  SELECT 'hidden_null_strings', col_name, 'medium', hidden, round(hidden * 100.0 / n_rows, 2) FROM st WHERE NOT is_num AND hidden > 0
  UNION ALL
  SELECT 'constant_column', col_name, 'high', n_rows, 100.0 FROM st WHERE d <= 1
  UNION ALL
  SELECT 'high_cardinality_identifier', col_name, 'medium', d, round(d * 100.0 / n_rows, 2) FROM st
    WHERE NOT is_num AND d > {P.QUALITY_HIGH_CARD_MIN} AND d * 1.0 / n_rows > {P.QUALITY_HIGH_CARD_RATIO}
  UNION ALL
  SELECT 'extreme_outliers', col_name, 'medium', outside, round(outside * 100.0 / n, 2) FROM st
    WHERE outside > 0 AND round(outside * 100.0 / n, 2) > {P.OUTLIER_ISSUE_PCT}
  UNION ALL
  SELECT 'suspicious_negative_values', col_name, 'high', neg, round(neg * 100.0 / n, 2) FROM st
    WHERE is_num AND n > {P.OUTLIER_MIN_VALUES} AND regexp_matches(col_name, '{neg}', 'i') AND neg > 0
)"""


SQL_ISSUES = _issues_sql() + """
SELECT issue_type, col_name, severity, CAST(affected_count AS BIGINT) AS affected_count, round(CAST(affected_pct AS DOUBLE), 4) AS affected_pct FROM issues"""

SQL_SCORE = _issues_sql() + """
SELECT round(greatest(0.0, least(100.0, 100.0 - coalesce(sum(CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 10.0
         WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.0 ELSE 0.0 END), 0.0))), 1) AS overall_score,
  CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS n_critical,
  CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS n_high,
  CAST(count(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS n_medium,
  CAST(count(*) FILTER (WHERE severity = 'low') AS BIGINT) AS n_low,
  coalesce(bool_or(severity = 'critical'), FALSE) AS has_critical_issues
FROM issues"""

SQL_OUTLIERS = f"""WITH {FAULTY_ORDERS_CTE},
{_bounds_sql()}
SELECT col_name, {r('q25')} AS q25, {r('q75')} AS q75, {r('lo')} AS lower_bound, {r('hi')} AS upper_bound,
  CAST(outside AS BIGINT) AS outlier_count, {r('round(outside * 100.0 / n, 2)')} AS outlier_pct
FROM st WHERE outside > 0"""

QUERIES = {
    "quality_issues_orders": q_quality_issues_orders,
    "quality_score_orders": q_quality_score_orders,
    "outlier_summary_orders": q_outlier_summary_orders,
}
ORACLE = {
    "quality_issues_orders": SQL_ISSUES,
    "quality_score_orders": SQL_SCORE,
    "outlier_summary_orders": SQL_OUTLIERS,
}
