"""Registered cleaning queries (C1–C12) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import patterns as P
from ...operators import clean as C
from ._common import FAULTY_ORDERS_CTE, faulty_orders, r, table

TARGET = "o_orderstatus"


def _as_double(df):
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            cols.append(F.round(c.cast("double"), 4).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def q_clean_orders(spark, sf_dir):
    df = faulty_orders(spark, sf_dir)
    out, _ = C.clean(df, TARGET)
    return _as_double(out)


def q_clean_log_orders(spark, sf_dir):
    df = faulty_orders(spark, sf_dir)
    m = C.fit_clean(df, TARGET)
    return m.log(spark).select("step", F.col("column").alias("col_name"), "detail", "count", F.round("value", 4).alias("value"))


def q_notebook_clean_orders(spark, sf_dir):
    return _as_double(C.notebook_clean(table(spark, sf_dir, "orders")))


PH = ", ".join("'" + v + "'" for v in P.PLACEHOLDER_NULLS)


def _ph(c):
    return f"CASE WHEN lower(trim({c})) IN ({PH}) THEN NULL ELSE {c} END AS {c}"


NUMS = ["o_orderkey", "o_custkey", "o_totalprice", "o_item_count",
        "o_orderdate_year", "o_orderdate_month", "o_orderdate_day", "o_orderdate_dayofweek", "o_orderdate_quarter"]


def _winsor(c):
    return (f"CASE WHEN w.{c}_q3 - w.{c}_q1 > 0 THEN least(greatest(CAST(i.{c} AS DOUBLE), w.{c}_q1 - 3.0 * (w.{c}_q3 - w.{c}_q1)), "
            f"w.{c}_q3 + 3.0 * (w.{c}_q3 - w.{c}_q1)) ELSE CAST(i.{c} AS DOUBLE) END")


SQL_CLEAN = f"""WITH {FAULTY_ORDERS_CTE},
c1 AS (SELECT o_orderkey, o_custkey, {_ph('o_orderstatus')}, o_totalprice, o_orderdate, {_ph('o_orderpriority')}, o_sparse,
              {_ph('o_channel')}, {_ph('o_clerk')}, o_item_count FROM faulty),
c2 AS (SELECT DISTINCT * FROM c1),
c3 AS (SELECT * FROM c2 WHERE {TARGET} IS NOT NULL),
c6 AS (SELECT *, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day,
              isodow(o_orderdate) - 1 AS o_orderdate_dayofweek, quarter(o_orderdate) AS o_orderdate_quarter FROM c3),
md AS (SELECT o_orderpriority AS v FROM c6 WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
i AS (SELECT o_orderkey, o_custkey, {TARGET}, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM c6)) AS o_totalprice,
             coalesce(o_orderpriority, (SELECT v FROM md)) AS o_orderpriority, o_item_count,
             o_orderdate_year, o_orderdate_month, o_orderdate_day, o_orderdate_dayofweek, o_orderdate_quarter FROM c6),
w AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_q3' for c in NUMS)} FROM i)
SELECT {', '.join(f"{r(_winsor(c))} AS {c}" for c in NUMS)}, i.{TARGET}, i.o_orderpriority
FROM i, w"""


def _log_sql() -> str:
    return f"""WITH {FAULTY_ORDERS_CTE},
c1 AS (SELECT o_orderkey, o_custkey, {_ph('o_orderstatus')}, o_totalprice, o_orderdate, {_ph('o_orderpriority')}, o_sparse,
              {_ph('o_channel')}, {_ph('o_clerk')}, o_item_count FROM faulty),
c2 AS (SELECT DISTINCT * FROM c1),
c3 AS (SELECT * FROM c2 WHERE {TARGET} IS NOT NULL),
hid AS (
  SELECT 'o_orderstatus' AS c, count(*) FILTER (WHERE lower(trim(o_orderstatus)) IN ({PH})) AS ph, count(*) - count(o_orderstatus) AS nn FROM faulty
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE lower(trim(o_orderpriority)) IN ({PH})), count(*) - count(o_orderpriority) FROM faulty
  UNION ALL SELECT 'o_channel', count(*) FILTER (WHERE lower(trim(o_channel)) IN ({PH})), count(*) - count(o_channel) FROM faulty
  UNION ALL SELECT 'o_clerk', count(*) FILTER (WHERE lower(trim(o_clerk)) IN ({PH})), count(*) - count(o_clerk) FROM faulty),
stats AS (SELECT count(*) AS n, count(*) - count(o_sparse) AS sparse_miss, count(DISTINCT o_clerk) AS clerk_d,
                 count(*) - count(o_totalprice) AS tp_miss, count(*) - count(o_orderpriority) AS pr_miss,
                 median(o_totalprice) AS tp_med FROM c3),
md AS (SELECT o_orderpriority AS v FROM c3 WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
i AS (SELECT coalesce(o_totalprice, (SELECT median(o_totalprice) FROM c3)) AS tp FROM c3),
wq AS (SELECT quantile_cont(tp, 0.25) AS q1, quantile_cont(tp, 0.75) AS q3 FROM i),
wb AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi FROM wq),
wc AS (SELECT count(*) FILTER (WHERE tp < lo OR tp > hi) AS clipped FROM i, wb)
SELECT 'hidden_nulls_replaced' AS step, c AS col_name, 'placeholders' AS detail, CAST(ph AS BIGINT) AS count, NULL::DOUBLE AS value FROM hid WHERE ph + nn > 0
UNION ALL SELECT 'hidden_nulls_replaced', c, 'placeholders_and_nulls', CAST(ph + nn AS BIGINT), NULL FROM hid WHERE ph + nn > 0
UNION ALL SELECT 'deduplicated_rows', NULL, NULL, CAST((SELECT count(*) FROM c1) - (SELECT count(*) FROM c2) AS BIGINT), NULL
UNION ALL SELECT 'dropped_rows', NULL, 'null target', CAST((SELECT count(*) FROM c2) - (SELECT count(*) FROM c3) AS BIGINT), NULL
UNION ALL SELECT 'dropped_column', 'o_orderdate', 'date_parts', NULL, NULL
UNION ALL SELECT 'dropped_column', 'o_sparse', 'missing:' || CAST(round(sparse_miss * 100.0 / n, 1) AS VARCHAR), NULL, NULL FROM stats
UNION ALL SELECT 'dropped_column', 'o_channel', 'constant', NULL, NULL
UNION ALL SELECT 'dropped_column', 'o_clerk', 'identifier:' || CAST(clerk_d AS VARCHAR), NULL, NULL FROM stats
UNION ALL SELECT 'imputation', 'o_totalprice', 'median', CAST(tp_miss AS BIGINT), {r('tp_med')} FROM stats
UNION ALL SELECT 'imputation', 'o_orderpriority', 'mode=' || (SELECT v FROM md), CAST(pr_miss AS BIGINT), NULL FROM stats
UNION ALL SELECT 'winsorized_lower', 'o_totalprice', NULL, CAST(clipped AS BIGINT), {r('lo')} FROM wb, wc WHERE clipped > 0
UNION ALL SELECT 'winsorized_upper', 'o_totalprice', NULL, CAST(clipped AS BIGINT), {r('hi')} FROM wb, wc WHERE clipped > 0"""


QUERIES = {
    "clean_orders": q_clean_orders,
    "clean_log_orders": q_clean_log_orders,
    "notebook_clean_orders": q_notebook_clean_orders,
}
ORACLE = {
    "clean_orders": SQL_CLEAN,
    "clean_log_orders": _log_sql(),
    "notebook_clean_orders": """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  CASE WHEN lower(trim(o_orderstatus)) IN ('?', 'na', 'n/a', 'null', 'none', '', 'nan') THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  round(o_totalprice, 4) AS o_totalprice, o_orderdate,
  CASE WHEN lower(trim(o_orderpriority)) IN ('?', 'na', 'n/a', 'null', 'none', '', 'nan') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year, CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month,
  CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek
FROM orders""",
}
