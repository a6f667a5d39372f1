"""Registered profile queries (P1–P23) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import patterns as P
from ...operators import profile as prof
from ..faults import FAULTY_ORDERS_COLUMNS
from ._common import FAULTY_ORDERS_CTE, faulty_orders, r, rounded, table, union_all

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical")]
EVENTS_COLS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "categorical"),
               ("value", "numeric"), ("props", "categorical")]


def q_profile_numeric_lineitem(spark, sf_dir):
    cols = prof.profile_columns(table(spark, sf_dir, "lineitem")).where("is_numeric")
    return rounded(
        cols.select(
            F.col("column").alias("col_name"), (F.col("n_rows") - F.col("missing_count")).alias("n"),
            "min", "max", "mean", "median", "std", "skew", "kurtosis", "zeros_count", "negative_count",
        )
    )


def sql_profile_numeric(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS col_name, CAST(count({c}) AS BIGINT) AS n, {r(f'min({x})')} AS min, {r(f'max({x})')} AS max, "
            f"{r(f'avg({x})')} AS mean, {r(f'median({x})')} AS median, {r(f'stddev_samp({x})')} AS std, "
            f"{r(f'skewness({x})')} AS skew, {r(f'kurtosis({x})')} AS kurtosis, "
            f"CAST(count(*) FILTER (WHERE {x} = 0) AS BIGINT) AS zeros_count, "
            f"CAST(count(*) FILTER (WHERE {x} < 0) AS BIGINT) AS negative_count FROM {tbl}"
        )
    return union_all(parts)


def _flags_query(df):
    cols = prof.profile_columns(df)
    return rounded(
        cols.select(
            F.col("column").alias("col_name"), F.col("ordinal").alias("col_ordinal"), "kind", "missing_count",
            "unique_count", "cardinality_pct", "is_suspected_id", "is_constant", "is_all_null",
            "is_high_cardinality", "is_target_candidate",
        )
    )


def q_profile_flags_orders(spark, sf_dir):
    return _flags_query(faulty_orders(spark, sf_dir))


def q_profile_flags_events(spark, sf_dir):
    return _flags_query(table(spark, sf_dir, "events"))


def sql_profile_flags(tbl: str, cols: list[tuple[str, str]], cte: str | None = None) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS col_name, {i} AS col_ordinal, '{kind}' AS kind, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, CAST(count(*) AS BIGINT) AS n_rows, "
            f"{'TRUE' if kind == 'numeric' else 'FALSE'} AS is_num FROM {tbl}"
        )
    idp, tgp = P.ID_NAME_PATTERN, P.TARGET_NAME_PATTERN
    body = f"""
stats AS ({union_all(parts)}),
flags AS (
  SELECT *,
    {r('unique_count * 100.0 / n_rows')} AS cardinality_pct,
    (n_rows > 0 AND ((unique_count = n_rows AND (regexp_matches(col_name, '{idp}', 'i') OR NOT is_num))
        OR (unique_count * 1.0 / n_rows > {P.ID_NEAR_UNIQUE_RATIO} AND regexp_matches(col_name, '{idp}', 'i')))) AS is_suspected_id,
    unique_count = 1 AS is_constant,
    missing_count = n_rows AS is_all_null
  FROM stats
),
flags2 AS (
  SELECT *,
    kind = 'categorical' AND unique_count > {P.PROFILE_HIGH_CARDINALITY} AND NOT is_suspected_id AS is_high_cardinality,
    regexp_matches(col_name, '{tgp}', 'i') AND NOT is_suspected_id AND NOT is_constant AND NOT is_all_null AS by_name,
    NOT is_suspected_id AND NOT is_constant AND NOT is_all_null AS eligible
  FROM flags
)
SELECT col_name, CAST(col_ordinal AS BIGINT) AS col_ordinal, kind, missing_count, unique_count, cardinality_pct,
  is_suspected_id, is_constant, is_all_null, is_high_cardinality,
  by_name OR (NOT bool_or(by_name) OVER () AND col_ordinal = max(CASE WHEN eligible THEN col_ordinal END) OVER ()) AS is_target_candidate
FROM flags2"""
    return "WITH " + (cte + ",\n" if cte else "") + body


def q_top_values_customer(spark, sf_dir):
    tv = prof.top_values(table(spark, sf_dir, "customer"), 5)
    return tv.select(F.col("column").alias("col_name"), F.col("rank").cast("long").alias("rank"), "value", "count")


def sql_top_values(tbl: str, cols: list[str], k: int) -> str:
    parts = [f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols]
    return f"""
SELECT col_name, rank, value, cnt AS count FROM (
  SELECT col_name, value, CAST(cnt AS BIGINT) AS cnt,
         CAST(row_number() OVER (PARTITION BY col_name ORDER BY cnt DESC, value ASC) AS BIGINT) AS rank
  FROM ({union_all(parts)})
) WHERE rank <= {k}"""


def q_profile_summary_orders(spark, sf_dir):
    return rounded(prof.profile_summary(faulty_orders(spark, sf_dir)))


def _sql_summary() -> str:
    names = [c for c, _ in FAULTY_ORDERS_COLUMNS]
    missing = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in names)
    # fixed widths: o_orderkey, o_custkey, o_totalprice, o_orderdate, o_sparse, o_item_count at 8 bytes
    width = 8 * 6
    var = " + ".join(f"coalesce(strlen({c}), 0)" for c in ["o_orderstatus", "o_orderpriority", "o_channel", "o_clerk"])
    return f"""WITH {FAULTY_ORDERS_CTE},
base AS (SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum({missing}) AS BIGINT) AS miss, sum({var}) AS vb FROM faulty),
dist AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM faulty))
SELECT n_rows, CAST({len(names)} AS BIGINT) AS n_cols, {r(f'(n_rows * {width} + vb) / 1048576.0')} AS memory_mb,
  miss AS total_missing_cells, {r(f'miss * 100.0 / (n_rows * {len(names)})')} AS total_missing_pct,
  CAST(n_rows - d AS BIGINT) AS duplicate_rows, {r('(n_rows - d) * 100.0 / n_rows')} AS duplicate_pct
FROM base, dist"""


def q_describe_lineitem(spark, sf_dir):
    d = prof.describe(table(spark, sf_dir, "lineitem"))
    return rounded(d.select(F.col("column").alias("col_name"), "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def _sql_describe() -> str:
    parts = []
    for c in LINEITEM_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS col_name, CAST(count({c}) AS BIGINT) AS count, {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS std, "
            f"{r(f'min({x})')} AS min, {r(f'quantile_cont({x}, 0.25)')} AS p25, {r(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{r(f'quantile_cont({x}, 0.75)')} AS p75, {r(f'max({x})')} AS max FROM lineitem"
        )
    return union_all(parts)


def q_missing_audit_orders(spark, sf_dir):
    m = prof.missing_audit(faulty_orders(spark, sf_dir))
    return rounded(m.select(F.col("column").alias("col_name"), "missing_count", "missing_pct"))


def _sql_missing_audit() -> str:
    parts = [
        f"SELECT '{c}' AS col_name, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
        f"{r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM faulty"
        for c, _ in FAULTY_ORDERS_COLUMNS
    ]
    return f"WITH {FAULTY_ORDERS_CTE} SELECT * FROM ({union_all(parts)}) WHERE missing_count > 0"


def q_target_distribution_orders(spark, sf_dir):
    t = prof.target_distribution(faulty_orders(spark, sf_dir), "o_orderstatus", 10)
    return t.select(F.col("rank").cast("long").alias("rank"), "value", "count")


_SQL_TARGET_DIST = f"""WITH {FAULTY_ORDERS_CTE}
SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderstatus ASC NULLS FIRST) AS BIGINT) AS rank,
         o_orderstatus AS value, CAST(count(*) AS BIGINT) AS count
  FROM faulty GROUP BY o_orderstatus
) WHERE rank <= 10"""


QUERIES = {
    "profile_numeric_lineitem": q_profile_numeric_lineitem,
    "profile_flags_orders": q_profile_flags_orders,
    "profile_flags_events": q_profile_flags_events,
    "top_values_customer": q_top_values_customer,
    "profile_summary_orders": q_profile_summary_orders,
    "describe_lineitem": q_describe_lineitem,
    "missing_audit_orders": q_missing_audit_orders,
    "target_distribution_orders": q_target_distribution_orders,
}

ORACLE = {
    "profile_numeric_lineitem": sql_profile_numeric("lineitem", LINEITEM_NUM),
    "profile_flags_orders": sql_profile_flags("faulty", FAULTY_ORDERS_COLUMNS, FAULTY_ORDERS_CTE),
    "profile_flags_events": sql_profile_flags("events", EVENTS_COLS),
    "top_values_customer": sql_top_values("customer", ["c_name", "c_mktsegment"], 5),
    "profile_summary_orders": _sql_summary(),
    "describe_lineitem": _sql_describe(),
    "missing_audit_orders": _sql_missing_audit(),
    "target_distribution_orders": _SQL_TARGET_DIST,
}


def q_profile_text_orders(spark, sf_dir):
    df = faulty_orders(spark, sf_dir)
    return prof.profile_text(prof.profile_summary(df), prof.profile_columns(df))


QUERIES["profile_text_orders"] = q_profile_text_orders


#: Columns whose values no double holds: integers beyond 2^53 and decimals of 30 digits; and times.
_EXACT = {
    "wide_long": ("o_orderkey * 1000003 + 9007199254740993", "o_orderkey * 1000003 + 9007199254740993"),
    "wide_decimal": ("CAST(o_orderkey AS DECIMAL(30, 4)) + 12345678901234567890123456.1234", "CAST(o_orderkey AS DECIMAL(30, 4)) + 12345678901234567890123456.1234"),
    "negative": ("-9007199254740993 - o_custkey", "-9007199254740993 - o_custkey"),
}


def q_exact_quantiles_orders(spark, sf_dir):
    """Quartiles (P9, E5) of values beyond doubles, exact to the last digit."""
    from functools import reduce

    from ...operators.orderstats import typed_quantiles

    o = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, (e, _) in _EXACT.items()])
    parts = [typed_quantiles(o, c, [0.25, 0.5, 0.75]).select(F.lit(c).alias("col_name"), "p", F.col("value").cast("decimal(38,6)").cast("string").alias("value")) for c in _EXACT]
    return reduce(lambda a, b: a.unionByName(b), parts)


QUERIES["exact_quantiles_orders"] = q_exact_quantiles_orders
ORACLE["exact_quantiles_orders"] = "WITH " + ", ".join(
    f"v_{c} AS (SELECT CAST({e} AS DECIMAL(38, 6)) AS v, row_number() OVER (ORDER BY {e}) - 1 AS r, count(*) OVER () - 1 AS n FROM orders)" for c, (_, e) in _EXACT.items()
) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({k / 4} AS DOUBLE) AS p, CAST(CAST(min(v) + (max(v) - min(v)) * CAST(any_value(n * {k} % 4) * 0.25 AS DECIMAL(3, 2)) AS DECIMAL(38, 6)) AS VARCHAR) AS value "
    f"FROM v_{c} WHERE r = n * {k} // 4 OR r = (n * {k} + 3) // 4" for c in _EXACT for k in (1, 2, 3)
)
