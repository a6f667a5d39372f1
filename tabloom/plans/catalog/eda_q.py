"""Registered exploratory-statistics queries (E1–E13) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import patterns as P
from ...operators import eda
from ._common import r, rounded, table, union_all
from .profile_q import LINEITEM_NUM


def q_histogram_lineitem(spark, sf_dir):
    h = eda.histogram(table(spark, sf_dir, "lineitem"))
    return h.select(F.col("column").alias("col_name"), F.col("bin").cast("long").alias("bin"), F.round("lo", 4).alias("lo"),
                    F.round("hi", 4).alias("hi"), "count", F.round("density", 9).alias("density"))


def _sql_histogram(tbl: str, cols: list[str], bins: int) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS col_name, n, e0, w, b, cnt FROM (
  SELECT count({c}) AS n,
    CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END AS e0,
    (CASE WHEN min({x}) = max({x}) THEN max({x}) + 0.5 ELSE max({x}) END
     - CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END) / {bins} AS w
  FROM {tbl}) e
CROSS JOIN range(0, {bins}) g(b)
LEFT JOIN (
  SELECT CAST(least(floor(({x} - e2.e0) / e2.w), {bins - 1}) AS BIGINT) AS bb, count(*) AS cnt
  FROM {tbl}, (SELECT CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END AS e0,
                      (CASE WHEN min({x}) = max({x}) THEN max({x}) + 0.5 ELSE max({x}) END
                       - CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END) / {bins} AS w FROM {tbl}) e2
  WHERE {c} IS NOT NULL GROUP BY 1
) c ON c.bb = g.b""")
    body = union_all(parts)
    return f"""SELECT col_name, CAST(b AS BIGINT) AS bin, {r('e0 + b * w')} AS lo, {r('e0 + (b + 1) * w')} AS hi,
  CAST(coalesce(cnt, 0) AS BIGINT) AS count, round(coalesce(cnt, 0) / (n * w), 9) AS density FROM ({body})"""


def q_category_top10_customer(spark, sf_dir):
    t = eda.category_frequencies(table(spark, sf_dir, "customer"))
    return t.select(F.col("column").alias("col_name"), F.col("rank").cast("long").alias("rank"), "value", "count")


def q_corr_matrix_lineitem(spark, sf_dir):
    c = eda.correlations(table(spark, sf_dir, "lineitem"))
    return rounded(c.select("col_a", "col_b", "r"))


def _sql_corr(tbl: str, cols: list[str], fill0: bool = True) -> str:
    parts = []
    for a in cols:
        for b in cols:
            expr = f"CASE WHEN '{a}' = '{b}' THEN CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"
            if fill0:
                expr = f"coalesce({expr}, 0.0)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(expr)} AS r FROM {tbl}")
    return union_all(parts)


def q_box_stats_lineitem(spark, sf_dir):
    b = eda.box_stats(table(spark, sf_dir, "lineitem"))
    return rounded(b.select(F.col("group").alias("col_name"), "n", "q1", "median", "q3", "whislo", "whishi", "fliers"))


def _sql_box(src: str, key_sql: str, val_sql: str, key_name: str, min_n: int = 1) -> str:
    """Box statistics of ``val_sql`` per ``key_sql`` over ``src``."""
    return f"""WITH d AS (SELECT {key_sql} AS k, CAST({val_sql} AS DOUBLE) AS v FROM {src}),
dd AS (SELECT * FROM d WHERE v IS NOT NULL AND k IS NOT NULL),
qs AS (SELECT k, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM dd GROUP BY k),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS flo, q3 + 1.5 * (q3 - q1) AS fhi FROM qs),
w AS (SELECT f.k, min(dd.v) FILTER (WHERE dd.v >= f.flo AND dd.v <= f.fhi) AS whislo,
             max(dd.v) FILTER (WHERE dd.v >= f.flo AND dd.v <= f.fhi) AS whishi FROM dd JOIN f USING (k) GROUP BY f.k),
fl AS (SELECT w.k, count(*) FILTER (WHERE dd.v < w.whislo OR dd.v > w.whishi) AS fliers FROM dd JOIN w USING (k) GROUP BY w.k)
SELECT {key_name}, CAST(n AS BIGINT) AS n, {r('q1')} AS q1, {r('med')} AS median, {r('q3')} AS q3, {r('whislo')} AS whislo,
  {r('whishi')} AS whishi, CAST(fliers AS BIGINT) AS fliers
FROM f JOIN w USING (k) JOIN fl USING (k) WHERE n >= {min_n}"""


def _sql_box_columns(tbl: str, cols: list[str]) -> str:
    src = "(" + union_all([f"SELECT '{c}' AS k0, CAST({c} AS DOUBLE) AS v0 FROM {tbl}" for c in cols]) + ")"
    return _sql_box(src, "k0", "v0", "k AS col_name", P.BOX_MIN_VALUES)


ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def q_box_by_class_orders(spark, sf_dir):
    b = eda.box_by_class(table(spark, sf_dir, "orders"), "o_orderstatus")
    return rounded(b)


def _sql_box_by_class() -> str:
    src = "(" + union_all([f"SELECT '{c}' AS feature, o_orderstatus AS t, CAST({c} AS DOUBLE) AS v0 FROM orders" for c in ORDERS_NUM]) + ")"
    return _sql_box(src, "feature || chr(1) || t", "v0", "split_part(k, chr(1), 1) AS feature, split_part(k, chr(1), 2) AS class")


def q_trend_line_lineitem(spark, sf_dir):
    t = eda.trend_lines(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rounded(t)


def _sql_trend() -> str:
    feats = [c for c in LINEITEM_NUM if c != "l_extendedprice"][:P.TARGET_MAX_FEATURES]
    parts = [
        f"SELECT '{c}' AS feature, CAST(regr_count(l_extendedprice, {c}) AS BIGINT) AS n, {r(f'regr_slope(l_extendedprice, {c})')} AS slope, "
        f"{r(f'regr_intercept(l_extendedprice, {c})')} AS intercept FROM lineitem"
        for c in feats
    ]
    return f"SELECT * FROM ({union_all(parts)}) WHERE n > 2"


def q_target_by_category_lineitem(spark, sf_dir):
    return rounded(eda.target_by_category(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


def _sql_target_by_category() -> str:
    cats = ["l_returnflag", "l_linestatus"]
    tops = union_all([
        f"SELECT feature, category FROM (SELECT '{c}' AS feature, {c} AS category, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk "
        f"FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rk <= {P.TARGET_TOP_CATEGORIES}" for c in cats
    ])
    src = "(" + union_all([f"SELECT '{c}' AS feature, {c} AS category, l_extendedprice AS v0 FROM lineitem" for c in cats]) + f") s JOIN ({tops}) t USING (feature, category)"
    return _sql_box(src, "feature || chr(1) || category", "v0", "split_part(k, chr(1), 1) AS feature, split_part(k, chr(1), 2) AS category")


def q_crosstab_orders(spark, sf_dir):
    return eda.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus")


_SQL_CROSSTAB = f"""WITH tops AS (
  SELECT category FROM (SELECT o_orderpriority AS category, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rk
  FROM orders GROUP BY 1) WHERE rk <= {P.TARGET_TOP_CATEGORIES})
SELECT 'o_orderpriority' AS feature, o_orderpriority AS category, o_orderstatus AS class, CAST(count(*) AS BIGINT) AS count
FROM orders JOIN tops ON o_orderpriority = tops.category GROUP BY 1, 2, 3"""


def q_skew_insights_documents(spark, sf_dir):
    s = eda.skew_insights(table(spark, sf_dir, "documents"))
    return rounded(s.select(F.col("column").alias("col_name"), "skew"))


_SQL_SKEW = union_all([
    f"SELECT * FROM (SELECT '{c}' AS col_name, {r(f'skewness(CAST({c} AS DOUBLE))')} AS skew, count({c}) AS n, stddev_samp({c}) AS sd FROM documents) "
    f"WHERE n > {P.SKEW_INSIGHT_MIN_N} AND sd > 0 AND abs(skew) > {P.SKEW_INSIGHT_ABS}"
    for c in ["doc_id", "n_chars"]
]).replace("SELECT * FROM", "SELECT col_name, skew FROM")


def q_collinear_pairs_lineitem(spark, sf_dir):
    return rounded(eda.collinear_pairs(table(spark, sf_dir, "lineitem")).select("col_a", "col_b", "r"))


def _sql_collinear() -> str:
    parts = []
    for i, a in enumerate(LINEITEM_NUM):
        for j, b in enumerate(LINEITEM_NUM):
            if i < j:
                parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, coalesce(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0.0) AS r FROM lineitem")
    return f"SELECT col_a, col_b, {r('r')} AS r FROM ({union_all(parts)}) WHERE abs(r) >= {P.COLLINEAR_ABS_R} ORDER BY i, j LIMIT {P.COLLINEAR_TOP}"


def q_target_corr_lineitem(spark, sf_dir):
    return rounded(eda.target_correlations(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


def _sql_target_corr() -> str:
    parts = [f"SELECT {i} AS i, '{c}' AS feature, corr(CAST({c} AS DOUBLE), l_extendedprice) AS r FROM lineitem"
             for i, c in enumerate(LINEITEM_NUM) if c != "l_extendedprice"]
    return f"SELECT feature, {r('r')} AS r FROM ({union_all(parts)}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, i LIMIT {P.TARGET_CORR_TOP}"


def q_eda_summary_events(spark, sf_dir):
    return eda.eda_summary(table(spark, sf_dir, "events"))


QUERIES = {
    "histogram_lineitem": q_histogram_lineitem,
    "category_top10_customer": q_category_top10_customer,
    "corr_matrix_lineitem": q_corr_matrix_lineitem,
    "box_stats_lineitem": q_box_stats_lineitem,
    "box_by_class_orders": q_box_by_class_orders,
    "trend_line_lineitem": q_trend_line_lineitem,
    "target_by_category_lineitem": q_target_by_category_lineitem,
    "crosstab_orders": q_crosstab_orders,
    "skew_insights_documents": q_skew_insights_documents,
    "collinear_pairs_lineitem": q_collinear_pairs_lineitem,
    "target_corr_lineitem": q_target_corr_lineitem,
    "eda_summary_events": q_eda_summary_events,
}

ORACLE = {
    "histogram_lineitem": _sql_histogram("lineitem", LINEITEM_NUM, P.HIST_BINS),
    "category_top10_customer": __import__("tabloom.plans.catalog.profile_q", fromlist=["sql_top_values"]).sql_top_values(
        "customer", ["c_name", "c_mktsegment"], P.CAT_TOP_N),
    "corr_matrix_lineitem": _sql_corr("lineitem", LINEITEM_NUM),
    "box_stats_lineitem": _sql_box_columns("lineitem", LINEITEM_NUM),
    "box_by_class_orders": _sql_box_by_class(),
    "trend_line_lineitem": _sql_trend(),
    "target_by_category_lineitem": _sql_target_by_category(),
    "crosstab_orders": _SQL_CROSSTAB,
    "skew_insights_documents": _SQL_SKEW,
    "collinear_pairs_lineitem": _sql_collinear(),
    "target_corr_lineitem": _sql_target_corr(),
    "eda_summary_events": "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_cols, CAST(3 AS BIGINT) AS n_numeric, "
                          "CAST(2 AS BIGINT) AS n_categorical FROM events",
}


def q_histogram20_orders(spark, sf_dir):
    """The notebook's 20-bin count histogram of the first 4 numeric columns."""
    h = eda.histogram(table(spark, sf_dir, "orders"), bins=20, max_cols=4)
    return h.select(F.col("column").alias("col_name"), F.col("bin").cast("long").alias("bin"), F.round("lo", 4).alias("lo"),
                    F.round("hi", 4).alias("hi"), "count", F.round("density", 9).alias("density"))


QUERIES["histogram20_orders"] = q_histogram20_orders
ORACLE["histogram20_orders"] = _sql_histogram("orders", ["o_orderkey", "o_custkey", "o_totalprice"], 20)


#: 24 numeric columns: residues of the part key, and the last one a copy of the one before it.
_WIDE = [f"(l_partkey * {k + 3} + l_suppkey * {k * k + 1} + l_orderkey) % {97 + k}" for k in range(23)]


def q_collinear_pairs_wide(spark, sf_dir):
    """Collinear pairs (E11) of a table with 24 numeric columns; the copied pair stands after the twentieth."""
    cols = [F.expr(f"cast({x} as double)").alias(f"x{k:02d}") for k, x in enumerate(_WIDE)]
    wide = table(spark, sf_dir, "lineitem").select(*cols).withColumn("x23", F.col("x22") * 2 + 1)
    return rounded(eda.collinear_pairs(wide).select("col_a", "col_b", "r"))


QUERIES["collinear_pairs_wide"] = q_collinear_pairs_wide
_names = [f"x{k:02d}" for k in range(24)]
ORACLE["collinear_pairs_wide"] = (
    "WITH w AS (SELECT *, x22 * 2 + 1 AS x23 FROM (SELECT " + ", ".join(f"CAST({x} AS DOUBLE) AS x{k:02d}" for k, x in enumerate(_WIDE)) + " FROM lineitem)), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM w" for i, a in enumerate(_names) for b in _names[i + 1:])
    + ") SELECT col_a, col_b, round(r, 4) AS r FROM p WHERE abs(r) >= " + str(P.COLLINEAR_ABS_R)
)


def q_target_points_part(spark, sf_dir):
    """Points of a continuous target against numeric features."""
    out = eda.target_points(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice")
    return rounded(out)


QUERIES["target_points_part"] = q_target_points_part
ORACLE["target_points_part"] = f"""SELECT 'p_partkey' AS feature, {r('p_partkey')} AS x, {r('p_retailprice')} AS y FROM part
UNION ALL SELECT 'p_size', {r('p_size')}, {r('p_retailprice')} FROM part"""
