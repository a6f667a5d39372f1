"""Planted faults for the audit and cleaning checks.

The driver tables are clean (no nulls, no duplicates), so the quality and
cleaning queries first plant faults with SQL text that both Spark and
DuckDB run unchanged: nulls, placeholder strings, a rare class, outliers,
negative counts, a constant column, a mostly-empty column, a text
identifier and duplicated rows.  Every row of the source table is kept; the
faults only change values or add copies.  ``{orders}`` / ``{lineitem}`` are
filled with a DataFrame by ``spark.sql(text, orders=df)`` and with the view
name for DuckDB.
"""

from __future__ import annotations

FAULTY_ORDERS = """
WITH base AS (
  SELECT
    o_orderkey,
    o_custkey,
    CASE WHEN o_orderkey % 97 = 5 THEN NULL
         WHEN o_orderkey % 61 = 7 THEN 'X'
         ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL
         WHEN o_orderkey % 101 = 1 THEN o_totalprice * 1000.0
         ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 23 = 0 THEN '?'
         WHEN o_orderkey % 31 = 0 THEN 'N/A'
         WHEN o_orderkey % 37 = 0 THEN ' none '
         ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_custkey AS DOUBLE) END AS o_sparse,
    'F1' AS o_channel,
    concat('Clerk#', CAST(o_orderkey AS STRING)) AS o_clerk,
    CASE WHEN o_orderkey % 13 = 0 THEN -1 * (o_orderkey % 7) ELSE o_orderkey % 9 END AS o_item_count
  FROM {orders}
)
SELECT * FROM base
UNION ALL
SELECT * FROM base WHERE o_orderkey % 50 = 0
"""

FAULTY_ORDERS_COLUMNS = [
    ("o_orderkey", "numeric"),
    ("o_custkey", "numeric"),
    ("o_orderstatus", "categorical"),
    ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"),
    ("o_orderpriority", "categorical"),
    ("o_sparse", "numeric"),
    ("o_channel", "categorical"),
    ("o_clerk", "categorical"),
    ("o_item_count", "numeric"),
]


def for_duckdb(text: str) -> str:
    """The same SQL with the placeholders replaced by the pre-registered views."""
    return text.replace("{orders}", "orders").replace("{lineitem}", "lineitem")
