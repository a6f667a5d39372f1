"""Registered split and leakage queries (L1–L6, G1–G5) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import patterns as P
from ...operators import leakage as G
from ...operators import split as S
from ._common import r, rounded, table


def temporal_order_sql(time: str, keys: list[str], rest: list[str]) -> str:
    """ORDER BY text matching ``temporal_split``: time, md5 of the keys, then the text of every column."""
    md5 = f"CAST(('0x' || left(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 13)) AS BIGINT)"
    return f"{time} NULLS LAST, {md5}, " + ", ".join(f"CAST({c} AS VARCHAR)" for c in keys + rest)


ORDERS_REST = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
LINEITEM_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def q_split_random_orders(spark, sf_dir):
    s = S.random_split(table(spark, sf_dir, "orders"), "o_orderstatus", keys=["o_orderkey"], seed=P.RANDOM_SEED)
    return s.select("o_orderkey", "split")


def q_split_sizes_orders(spark, sf_dir):
    s = S.random_split(table(spark, sf_dir, "orders"), "o_orderstatus", keys=["o_orderkey"], seed=P.RANDOM_SEED)
    return s.groupBy("split", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _h(key: str, seed: int) -> str:
    return f"CAST(('0x' || left(md5(CAST({key} AS VARCHAR) || '|{seed}'), 13)) AS BIGINT)"


def _alloc_sql(counts_cte: str, n_draws: str, name: str) -> str:
    """Largest-remainder allocation over classes (ties by class name)."""
    return f"""{name} AS (
  SELECT cls, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS alloc FROM (
    SELECT cls, fl, (SELECT {n_draws}) - sum(fl) OVER () AS need,
           row_number() OVER (ORDER BY cont - fl DESC, cls) AS rk
    FROM (SELECT cls, cnt * ({n_draws}) / (SELECT sum(cnt) FROM {counts_cte}) AS cont,
                 floor(cnt * ({n_draws}) / (SELECT sum(cnt) FROM {counts_cte})) AS fl FROM {counts_cte})))"""


SQL_SPLIT_RANDOM = f"""WITH cnt0 AS (SELECT o_orderstatus AS cls, count(*) AS cnt FROM orders GROUP BY 1),
tot AS (SELECT sum(cnt) AS n, CAST(ceil(sum(cnt) * {P.TEST_SIZE}) AS BIGINT) AS n_test FROM cnt0),
{_alloc_sql('cnt0', '(SELECT n - n_test FROM tot)', 'tv')},
cnt1 AS (SELECT cls, alloc AS cnt FROM tv),
nv AS (SELECT CAST(ceil((n - n_test) * ({P.VAL_SIZE} / (1.0 - {P.TEST_SIZE}))) AS BIGINT) AS n_val, n - n_test AS n_rest FROM tot),
{_alloc_sql('cnt1', '(SELECT n_rest - n_val FROM nv)', 'tr2')},
cuts AS (SELECT c0.cls, c0.cnt - tv.alloc AS test_c, tv.alloc - tr2.alloc AS val_c
         FROM cnt0 c0 JOIN tv USING (cls) JOIN tr2 USING (cls)),
ranked AS (SELECT o_orderkey, o_orderstatus AS cls,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('o_orderkey', P.RANDOM_SEED)}, CAST(o_orderkey AS VARCHAR)) AS rn
           FROM orders)
SELECT o_orderkey, CASE WHEN rn <= test_c THEN 'test' WHEN rn <= test_c + val_c THEN 'val' ELSE 'train' END AS split
FROM ranked JOIN cuts USING (cls)"""

SQL_SPLIT_SIZES = SQL_SPLIT_RANDOM.replace(
    "SELECT o_orderkey, CASE WHEN rn <= test_c THEN 'test' WHEN rn <= test_c + val_c THEN 'val' ELSE 'train' END AS split\nFROM ranked JOIN cuts USING (cls)",
    "SELECT CASE WHEN rn <= test_c THEN 'test' WHEN rn <= test_c + val_c THEN 'val' ELSE 'train' END AS split, cls AS o_orderstatus, "
    "CAST(count(*) AS BIGINT) AS n FROM ranked JOIN cuts USING (cls) GROUP BY 1, 2",
)


def q_split_temporal_orders(spark, sf_dir):
    s = S.temporal_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", tiebreak=["o_orderkey"])
    return s.select("o_orderkey", "split")


SQL_SPLIT_TEMPORAL = f"""WITH n AS (SELECT count(*) AS n FROM orders),
sz AS (SELECT n, greatest(1, CAST(floor(n * {P.TEST_SIZE}) AS BIGINT)) AS n_test,
              greatest(1, CAST(floor(n * {P.VAL_SIZE}) AS BIGINT)) AS n_val FROM n),
ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY {temporal_order_sql('o_orderdate', ['o_orderkey'], ORDERS_REST)}) AS rn FROM orders)
SELECT o_orderkey, CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split
FROM ranked, sz"""


def _leak_input(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # planted proxy: a currency conversion of the target, named after it
    li = li.withColumn("l_extendedprice_usd", F.col("l_extendedprice") * 1.1)
    s = S.temporal_split(li, "l_extendedprice", "l_shipdate", tiebreak=["l_orderkey", "l_linenumber"])
    return s


def q_leakage_lineitem(spark, sf_dir):
    s = _leak_input(spark, sf_dir)
    feats = [c for c in s.columns if c not in ("split", "l_extendedprice")]
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test")
    found = G.audit_leakage(train.select(*feats), test.select(*feats), train.select(*feats, "l_extendedprice"), "l_extendedprice")
    return rounded(found.select("check", F.col("column").alias("col_name"), "severity", "value"))


def _sql_leakage() -> str:
    nums = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice_usd"]
    corr = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col_name, corr(CAST({c} AS DOUBLE), l_extendedprice) AS rr, count(*) AS n FROM train" for c in nums
    )
    cols = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, l_extendedprice_usd"
    return f"""WITH li AS (SELECT *, l_extendedprice * 1.1 AS l_extendedprice_usd FROM lineitem),
n AS (SELECT count(*) AS n FROM li),
sz AS (SELECT n, greatest(1, CAST(floor(n * {P.TEST_SIZE}) AS BIGINT)) AS n_test, greatest(1, CAST(floor(n * {P.VAL_SIZE}) AS BIGINT)) AS n_val FROM n),
ranked AS (SELECT *, row_number() OVER (ORDER BY {temporal_order_sql('l_shipdate', ['l_orderkey', 'l_linenumber'], LINEITEM_REST + ['l_extendedprice_usd'])}) AS rn FROM li),
lab AS (SELECT ranked.*, CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split FROM ranked, sz),
train AS (SELECT * FROM lab WHERE split = 'train'),
test AS (SELECT * FROM lab WHERE split = 'test'),
prox AS (SELECT 'target_proxy' AS "check", col_name, 'critical' AS severity, {r('rr')} AS value FROM ({corr})
         WHERE n > {P.LEAKAGE_MIN_PAIRS} AND rr IS NOT NULL AND abs(rr) >= {P.LEAKAGE_MIN_ABS_R}),
ov AS (SELECT count(*) AS o FROM (SELECT {cols} FROM train INTERSECT SELECT {cols} FROM test)),
nt AS (SELECT count(*) AS t FROM test)
SELECT 'target_name_in_feature' AS "check", 'l_extendedprice_usd' AS col_name, 'warning' AS severity, NULL::DOUBLE AS value
UNION ALL SELECT * FROM prox
UNION ALL SELECT 'row_overlap', NULL, CASE WHEN o * 100.0 / t > {P.CONTAMINATION_CRITICAL_PCT} THEN 'critical' ELSE 'warning' END, {r('o')}
  FROM ov, nt WHERE o > 0 AND t > 0"""


QUERIES = {
    "split_random_orders": q_split_random_orders,
    "split_sizes_orders": q_split_sizes_orders,
    "split_temporal_orders": q_split_temporal_orders,
    "leakage_lineitem": q_leakage_lineitem,
}
ORACLE = {
    "split_random_orders": SQL_SPLIT_RANDOM,
    "split_sizes_orders": SQL_SPLIT_SIZES,
    "split_temporal_orders": SQL_SPLIT_TEMPORAL,
    "leakage_lineitem": _sql_leakage(),
}


def q_leakage_offset_lineitem(spark, sf_dir):
    """Leakage (G2, G3) with values near 1.7e9: one feature is twice the target, and the sides share rows."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", (F.col("l_quantity") + F.col("l_discount") + 1.7e9).alias("y"))
    li = li.withColumns({"twice": F.col("y") * 2, "far": F.col("l_discount") + 1.7e9})
    feats = ["l_quantity", "l_discount", "twice", "far"]
    train, test = li.where("l_linenumber <= 4"), li.where("l_linenumber > 4")
    found = G.audit_leakage(train.select(*feats), test.select(*feats), train.select(*feats, "y"), "y")
    return rounded(found.select("check", F.col("column").alias("col_name"), "severity", "value"))


QUERIES["leakage_offset_lineitem"] = q_leakage_offset_lineitem
_OFFSET_FEATS = ["l_quantity", "l_discount", "twice", "far"]
ORACLE["leakage_offset_lineitem"] = f"""WITH li AS (
  SELECT l_linenumber, l_quantity, l_discount, y, y * 2 AS twice, l_discount + 1.7e9 AS far
  FROM (SELECT *, l_quantity + l_discount + 1.7e9 AS y FROM lineitem)
), train AS (SELECT * FROM li WHERE l_linenumber <= 4), test AS (SELECT * FROM li WHERE l_linenumber > 4),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS col_name, corr({c} - {1.7e9 if c == 'far' else 3.4e9 if c == 'twice' else 0}, y - 1.7e9) AS rr FROM train" for c in _OFFSET_FEATS)}),
o AS (SELECT count(*) AS o FROM (SELECT {", ".join(_OFFSET_FEATS)} FROM train INTERSECT SELECT {", ".join(_OFFSET_FEATS)} FROM test)), t AS (SELECT count(*) AS t FROM test)
SELECT 'target_proxy' AS "check", col_name, 'critical' AS severity, {r('rr')} AS value FROM c WHERE abs(rr) >= {P.LEAKAGE_MIN_ABS_R}
UNION ALL SELECT 'row_overlap', NULL, CASE WHEN o * 100.0 / t > {P.CONTAMINATION_CRITICAL_PCT} THEN 'critical' ELSE 'warning' END, {r('o')} FROM o, t WHERE o > 0"""


def q_split_hot_time_lineitem(spark, sf_dir):
    """Temporal split (L3) where a third of all lines share one time, through which a cut runs."""
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.when(F.col("l_orderkey") % 3 == 0, F.lit("1997-03-01").cast("timestamp")).otherwise(F.col("l_shipdate")))
    s = S.temporal_split(li, "l_extendedprice", "l_shipdate", tiebreak=["l_orderkey", "l_linenumber"])
    return s.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "split")


def q_split_by_one_key_lineitem(spark, sf_dir):
    """The same with a tie-break column of two values: rows of one time and key are ordered by all columns."""
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.when(F.col("l_orderkey") % 3 == 0, F.lit("1997-03-01").cast("timestamp")).otherwise(F.col("l_shipdate")))
    s = S.temporal_split(li, "l_extendedprice", "l_shipdate", tiebreak=["l_linestatus"])
    return s.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "split")


_HOT = "li AS (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN TIMESTAMP '1997-03-01' ELSE l_shipdate END AS l_shipdate) FROM lineitem)"
_ONE_KEY_REST = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def _hot_sql(keys: list[str], rest: list[str]) -> str:
    return f"""WITH {_HOT}, sz AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * {P.TEST_SIZE}) AS BIGINT)) AS n_test,
  greatest(1, CAST(floor(count(*) * {P.VAL_SIZE}) AS BIGINT)) AS n_val FROM li),
ranked AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {temporal_order_sql('l_shipdate', keys, rest)}) AS rn FROM li)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split
FROM ranked, sz"""


QUERIES["split_hot_time_lineitem"] = q_split_hot_time_lineitem
QUERIES["split_by_one_key_lineitem"] = q_split_by_one_key_lineitem
ORACLE["split_hot_time_lineitem"] = _hot_sql(["l_orderkey", "l_linenumber"], LINEITEM_REST)
ORACLE["split_by_one_key_lineitem"] = _hot_sql(["l_linestatus"], _ONE_KEY_REST)
