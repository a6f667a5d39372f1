"""Registered feature-generation and encoding queries (F1–F7, R1–R9) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import patterns as P
from ...operators import encode as R
from ...operators import features as FE
from ...operators import split as S
from ._common import r, rounded, table
from .split_q import LINEITEM_REST, ORDERS_REST, _h, temporal_order_sql


def _doc_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return S.random_split(docs, "lang", keys=["doc_id"], stratify=False)


def q_features_documents(spark, sf_dir):
    s = _doc_split(spark, sf_dir)
    x_train = s.where(F.col("split") == "train").drop("lang", "split")
    plan = FE.fit_features(x_train)
    test = plan.transform(s.where(F.col("split") == "test").drop("lang", "split"))
    return rounded(test)


def _doc_rank_sql() -> str:
    return f"""WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) * {P.TEST_SIZE}) AS BIGINT) AS n_test FROM documents),
nv AS (SELECT n, n_test, CAST(ceil((n - n_test) * ({P.VAL_SIZE} / (1.0 - {P.TEST_SIZE}))) AS BIGINT) AS n_val FROM n),
ranked AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_h('doc_id', P.RANDOM_SEED)}, CAST(doc_id AS VARCHAR)) AS rn FROM documents),
lab AS (SELECT ranked.*, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM ranked, nv)"""


SQL_FEATURES_DOCS = _doc_rank_sql() + f""",
dec AS (SELECT count(n_chars) > {P.LOG_MIN_VALUES} AND min(n_chars) >= 0 AND stddev_samp(n_chars) > 0
               AND skewness(CAST(n_chars AS DOUBLE)) > {P.LOG_MIN_SKEW} AS use_log FROM lab WHERE split = 'train')
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_chars AS BIGINT) AS n_chars,
  CASE WHEN use_log THEN {r('ln(1 + greatest(CAST(n_chars AS DOUBLE), 0.0))')} END AS log_n_chars,
  {r('CAST(doc_id AS DOUBLE) - CAST(n_chars AS DOUBLE)')} AS diff_doc_id_n_chars,
  {r(f'CAST(doc_id AS DOUBLE) / (abs(CAST(n_chars AS DOUBLE)) + {P.RATIO_EPSILON})')} AS ratio_doc_id_n_chars
FROM lab, dec WHERE split = 'test'"""


def q_features_lineitem(spark, sf_dir):
    s = S.temporal_split(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate", tiebreak=["l_orderkey", "l_linenumber"])
    feats = [c for c in s.columns if c not in ("split", "l_extendedprice")]
    plan = FE.fit_features(s.where(F.col("split") == "train").select(*feats))
    out = plan.transform(s.where(F.col("split") == "test").select(*feats))
    new = [n for n, _, _ in plan.created()]
    return rounded(out.select("l_orderkey", "l_linenumber", *new))


def _sql_features_lineitem() -> str:
    pc = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    cols = []
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = f"CAST({pc[i]} AS DOUBLE)", f"CAST({pc[j]} AS DOUBLE)"
            cols.append(f"{r(f'{a} - {b}')} AS diff_{pc[i]}_{pc[j]}")
            cols.append(f"{r(f'{a} / (abs({b}) + {P.RATIO_EPSILON})')} AS ratio_{pc[i]}_{pc[j]}")
    cols += ["CAST(month(l_shipdate) AS BIGINT) AS l_shipdate_month", "CAST(day(l_shipdate) AS BIGINT) AS l_shipdate_day",
             "CAST(isodow(l_shipdate) - 1 AS BIGINT) AS l_shipdate_dayofweek"]
    return f"""WITH n AS (SELECT count(*) AS n FROM lineitem),
sz AS (SELECT n, greatest(1, CAST(floor(n * {P.TEST_SIZE}) AS BIGINT)) AS n_test, greatest(1, CAST(floor(n * {P.VAL_SIZE}) AS BIGINT)) AS n_val FROM n),
ranked AS (SELECT *, row_number() OVER (ORDER BY {temporal_order_sql('l_shipdate', ['l_orderkey', 'l_linenumber'], LINEITEM_REST)}) AS rn FROM lineitem)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {', '.join(cols)}
FROM ranked, sz WHERE rn > n - n_test"""


def q_feature_log_lineitem(spark, sf_dir):
    s = S.temporal_split(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate", tiebreak=["l_orderkey", "l_linenumber"])
    feats = [c for c in s.columns if c not in ("split", "l_extendedprice")]
    plan = FE.fit_features(s.where(F.col("split") == "train").select(*feats))
    return plan.log(spark)


def _sql_feature_log() -> str:
    pc = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = []
    for i in range(4):
        for j in range(i + 1, 4):
            rows.append((f"diff_{pc[i]}_{pc[j]}", "difference", f"{pc[i]},{pc[j]}"))
            rows.append((f"ratio_{pc[i]}_{pc[j]}", "ratio", f"{pc[i]},{pc[j]}"))
    rows += [(f"l_shipdate_{p}", "datetime_part", "l_shipdate") for p in ("month", "day", "dayofweek")]
    vals = ", ".join(f"('{n}', '{t}', '{s}', {i})" for i, (n, t, s) in enumerate(rows))
    return f"SELECT name, type, source, i < {P.MAX_NEW_FEATURES} AS retained FROM (VALUES {vals}) v(name, type, source, i)"


def q_encode_orders(spark, sf_dir):
    s = S.temporal_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", tiebreak=["o_orderkey"])
    x = s.drop("o_orderstatus")
    enc = R.fit_encoder(x.where(F.col("split") == "train").drop("split"))
    test = x.where(F.col("split") == "test").drop("split").withColumn("row_key", F.col("o_orderkey"))
    return rounded(enc.transform(test, keep=["row_key"]))


def _sql_encode() -> str:
    cats_sql = "SELECT DISTINCT o_orderpriority AS v FROM train"
    return f"""WITH n AS (SELECT count(*) AS n FROM orders),
sz AS (SELECT n, greatest(1, CAST(floor(n * {P.TEST_SIZE}) AS BIGINT)) AS n_test, greatest(1, CAST(floor(n * {P.VAL_SIZE}) AS BIGINT)) AS n_val FROM n),
ranked AS (SELECT *, row_number() OVER (ORDER BY {temporal_order_sql('o_orderdate', ['o_orderkey'], ORDERS_REST)}) AS rn FROM orders),
lab AS (SELECT ranked.*, CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split FROM ranked, sz),
train AS (SELECT * FROM lab WHERE split = 'train'),
test AS (SELECT * FROM lab WHERE split = 'test'),
st AS (SELECT median(o_orderkey) AS m1, median(o_custkey) AS m2, median(o_totalprice) AS m3 FROM train),
sc AS (SELECT avg(coalesce(CAST(o_orderkey AS DOUBLE), m1)) AS a1, stddev_pop(coalesce(CAST(o_orderkey AS DOUBLE), m1)) AS s1,
              avg(coalesce(CAST(o_custkey AS DOUBLE), m2)) AS a2, stddev_pop(coalesce(CAST(o_custkey AS DOUBLE), m2)) AS s2,
              avg(coalesce(o_totalprice, m3)) AS a3, stddev_pop(coalesce(o_totalprice, m3)) AS s3 FROM train, st),
fq AS (SELECT CAST(o_orderdate AS VARCHAR) AS v, count(*) * 1.0 / (SELECT count(*) FROM train) AS f FROM train GROUP BY 1)
SELECT CAST(t.o_orderkey AS BIGINT) AS row_key,
  {r('(coalesce(CAST(t.o_orderkey AS DOUBLE), m1) - a1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END')} AS o_orderkey,
  {r('(coalesce(CAST(t.o_custkey AS DOUBLE), m2) - a2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END')} AS o_custkey,
  {r('(coalesce(t.o_totalprice, m3) - a3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END')} AS o_totalprice,
  {r('coalesce(fq.f, 0.0)')} AS freq_o_orderdate,
  {', '.join(f"CASE WHEN coalesce(t.o_orderpriority, 'missing') = '{v}' AND '{v}' IN ({cats_sql}) THEN 1.0 ELSE 0.0 END AS \"o_orderpriority_{v}\"" for v in ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])}
FROM test t CROSS JOIN st CROSS JOIN sc LEFT JOIN fq ON fq.v = CAST(t.o_orderdate AS VARCHAR)"""


def q_product_feature_lineitem(spark, sf_dir):
    out = FE.product_feature(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    return rounded(out)


QUERIES = {
    "features_documents": q_features_documents,
    "features_lineitem": q_features_lineitem,
    "feature_log_lineitem": q_feature_log_lineitem,
    "encode_orders": q_encode_orders,
    "product_feature_lineitem": q_product_feature_lineitem,
}
ORACLE = {
    "features_documents": SQL_FEATURES_DOCS,
    "features_lineitem": _sql_features_lineitem(),
    "feature_log_lineitem": _sql_feature_log(),
    "encode_orders": _sql_encode(),
    "product_feature_lineitem": f"SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
                                f"{r('l_quantity')} AS l_quantity, {r('CAST(l_orderkey AS DOUBLE) * CAST(l_linenumber AS DOUBLE)')} AS l_orderkey_x_l_linenumber FROM lineitem",
}


def q_encode_sparse_orders(spark, sf_dir):
    """Frequency encoding (R5) of a column of which three fifths are null and one value has half of the rest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SPARSE).alias("agent"))
    enc = R.fit_encoder(o.select("agent"))
    return rounded(enc.transform(o, keep=["o_orderkey"]))


_SPARSE = "CASE WHEN o_custkey % 5 < 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'house' ELSE concat('agent ', CAST(o_custkey AS STRING)) END"
QUERIES["encode_sparse_orders"] = q_encode_sparse_orders
ORACLE["encode_sparse_orders"] = f"""WITH o AS (SELECT o_orderkey, coalesce({_SPARSE.replace('STRING', 'VARCHAR')}, '{P.FREQ_NULL_TEXT}') AS agent FROM orders)
SELECT o_orderkey, {r('count(*) OVER (PARTITION BY agent) * 1.0 / count(*) OVER ()')} AS freq_agent FROM o"""
