"""Registered model-training queries.

DBSCAN and nearest neighbours over all rows have SQL oracles.  Seeded
learners have none; the driver checks their row counts and ``tests/``
checks properties (metrics beat a constant baseline, one prediction per
row).  Each query encodes the training split (fitted on
train only) and trains one model on it, scoring the validation rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ...operators import cluster_quality as Q
from ...operators import encode as R
from ...operators import knn as K
from ...operators import models as M
from ...operators import split as S
from ..run import autorun
from ...operators.dbscan import dbscan
from ._common import r, rounded, table
from .split_q import _h


def _prepared(spark, sf_dir, task):
    if task == M.REGRESSION:
        df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
        target, key = "p_retailprice", ["p_partkey"]
        parts = S.random_split(df, target, keys=key, stratify=False)
    elif task == M.CLASSIFICATION:
        docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
        df = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
        target, key = "quality", ["doc_id"]
        parts = S.random_split(df, target, keys=key)
    else:  # clustering and the multiclass task use customers
        df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
        target, key = "c_mktsegment", ["c_custkey"]
        parts = S.random_split(df, target, keys=key)
    x_cols = [c for c in df.columns if c not in (target, *key)]
    enc = R.fit_encoder(parts.where(F.col("split") == "train").select(*x_cols))
    encoded = enc.transform(parts, keep=[*key, target, "split"])
    return encoded, enc.feature_names, target, key


def q_train(spark, sf_dir, *, name, task):
    encoded, feats, target, key = _prepared(spark, sf_dir, task)
    if task == M.CLUSTERING:
        res = M.train_and_evaluate(name, task, encoded, encoded, [f for f in feats if not f.startswith("c_mktsegment")], None, key=key)
    else:
        tr, va = encoded.where(F.col("split") == "train"), encoded.where(F.col("split") == "val")
        res = M.train_and_evaluate(name, task, tr, va, feats, target, key=key)
    return rounded(M.leaderboard_row(res, task).drop("training_time"))


def q_multiclass(spark, sf_dir, *, name):
    encoded, feats, target, key = _prepared(spark, sf_dir, "multiclass")
    tr, va = encoded.where(F.col("split") == "train"), encoded.where(F.col("split") == "val")
    res = M.train_and_evaluate(name, M.CLASSIFICATION, tr, va, [f for f in feats if not f.startswith("c_mktsegment")], target, key=key)
    return rounded(M.leaderboard_row(res, M.CLASSIFICATION).drop("training_time"))


def q_autorun_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_size", "p_brand", "p_type", "p_retailprice")
    res = autorun(spark, df, target="p_retailprice", task=M.REGRESSION)
    return rounded(res.leaderboard.select("rank", "model_name", "rmse", "mae", "r2"))


def q_autorun_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    df = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id").drop("doc_id")
    res = autorun(spark, df, target="quality", task=M.CLASSIFICATION)
    return rounded(res.leaderboard.select("rank", "model_name", "f1", "accuracy"))


QUERIES = {}
for _n in M.REGRESSORS:
    QUERIES[f"train_{_n.lower()}_part"] = partial(q_train, name=_n, task=M.REGRESSION)
for _n in M.CLASSIFIERS:
    QUERIES[f"train_{_n.lower()}_documents"] = partial(q_train, name=_n, task=M.CLASSIFICATION)
for _n in M.CLASSIFIERS:  # one-vs-rest and native multiclass paths
    QUERIES[f"train_{_n.lower()}_customer_segments"] = partial(q_multiclass, name=_n)
for _n in M.CLUSTERERS:
    QUERIES[f"train_{_n.lower()}_customer"] = partial(q_train, name=_n, task=M.CLUSTERING)
QUERIES["autorun_part"] = q_autorun_part
QUERIES["autorun_documents"] = q_autorun_documents
ORACLE: dict[str, str] = {}


# -- DBSCAN (M22): labels against a self-join ---------------------------------------

CUSTOMER_EPS, CUSTOMER_LEAST = 40.0, 4
LINEITEM_EPS, LINEITEM_LEAST = 1.0, 60
EMBEDDING_EPS, EMBEDDING_LEAST = 1.2, 7


def q_dbscan_customer(spark, sf_dir):
    """Customers by nation (a thousand apart) and balance: chains of balances, borders and noise."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 1000.0).alias("x"), F.col("c_acctbal").alias("y"))
    return dbscan(c, ["x", "y"], key=["c_custkey"], eps=CUSTOMER_EPS, min_samples=CUSTOMER_LEAST)


def q_dbscan_lineitem(spark, sf_dir):
    """Order lines by quantity, discount and tax: many equal points, and a third of all rows in one dense cell."""
    li = table(spark, sf_dir, "lineitem")
    hot = F.col("l_orderkey") % 3 == 0
    li = li.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(hot, F.col("l_extendedprice") / 1e9).otherwise(F.col("l_quantity")).alias("x"),
        F.when(hot, 0.0).otherwise(F.round(F.col("l_discount") * 100)).alias("y"), F.when(hot, 0.0).otherwise(F.round(F.col("l_tax") * 100)).alias("z"),
    )
    return dbscan(li, ["x", "y", "z"], key=["l_orderkey", "l_linenumber"], eps=LINEITEM_EPS, min_samples=LINEITEM_LEAST)


def q_dbscan_embeddings(spark, sf_dir):
    """Vectors of 64 dimensions."""
    return dbscan(table(spark, sf_dir, "embeddings"), ["embedding"], key=["vec_id"], eps=EMBEDDING_EPS, min_samples=EMBEDDING_LEAST)


def _dbscan_sql(points: str, distance: str, eps: float, least: int, keys: str, rows: str) -> str:
    """``points``: SELECT of distinct points (coordinates, w, id in the order of their first row); ``rows``: their rows."""
    return f"""WITH RECURSIVE p AS ({points}),
near AS (SELECT a.id AS a, b.id AS b, b.w FROM p a JOIN p b ON {distance} <= {eps}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING sum(w) >= {least}),
links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
lab(id, label) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT l.b, min(d.label) FROM lab d JOIN links l ON l.a = d.id JOIN recurring.lab o ON o.id = l.b WHERE d.label < o.label GROUP BY l.b
),
named AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab),
edge AS (SELECT n.a AS id, min(m.cluster) AS cluster FROM near n JOIN named m ON m.id = n.b WHERE n.a NOT IN (FROM core) GROUP BY n.a),
found AS (SELECT * FROM named UNION ALL SELECT * FROM edge)
SELECT {keys}, CAST(coalesce(cluster, -1) AS BIGINT) AS cluster FROM ({rows}) t LEFT JOIN found ON found.id = t.id"""


_C = "SELECT c_custkey, c_nationkey * 1000.0 AS x, c_acctbal AS y FROM customer"
_C_POINTS = f"SELECT x, y, count(*) AS w, row_number() OVER (ORDER BY min(c_custkey)) AS id FROM ({_C}) GROUP BY x, y"
_L = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_extendedprice / 1e9 ELSE l_quantity END AS x,
  CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE round(l_discount * 100) END AS y, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE round(l_tax * 100) END AS z FROM lineitem"""
# all points of the dense cell lie within 0.001 of another and are one point to SQL: their least coordinate, within the limit of the same grid points
_L_CELL = f"SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE x END AS cx FROM ({_L})"
_L_POINTS = f"SELECT cx, y, z, count(*) AS w, row_number() OVER (ORDER BY min(ROW(l_orderkey, l_linenumber))) AS id FROM ({_L_CELL}) GROUP BY cx, y, z"
_E_POINTS = "SELECT embedding::DOUBLE[] AS e, 1 AS w, row_number() OVER (ORDER BY vec_id) AS id, vec_id FROM embeddings"

QUERIES["dbscan_customer"] = q_dbscan_customer
QUERIES["dbscan_lineitem"] = q_dbscan_lineitem
QUERIES["dbscan_embeddings"] = q_dbscan_embeddings
ORACLE["dbscan_customer"] = _dbscan_sql(_C_POINTS, "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", CUSTOMER_EPS, CUSTOMER_LEAST, "c_custkey",
                                        f"SELECT c_custkey, id FROM ({_C}) c JOIN p USING (x, y)")
ORACLE["dbscan_lineitem"] = _dbscan_sql(_L_POINTS, "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))", LINEITEM_EPS, LINEITEM_LEAST,
                                        "l_orderkey, l_linenumber", f"SELECT l_orderkey, l_linenumber, id FROM ({_L_CELL}) c JOIN p USING (cx, y, z)")
ORACLE["dbscan_embeddings"] = _dbscan_sql(_E_POINTS, "list_distance(a.e, b.e)", EMBEDDING_EPS, EMBEDDING_LEAST, "vec_id", "SELECT vec_id, id FROM p")


# -- nearest neighbours over all training rows (M5) ------------------------------------

def q_knn_regress_orders(spark, sf_dir):
    """Order number from day and price: four fifths of all orders train, none is sampled."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("price"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("day"))
    s = S.random_split(o, "o_custkey", keys=["o_orderkey"], val_size=0.0, stratify=False)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    return rounded(K.knn_join(train, test, ["price", "day"], "o_custkey", key=["o_orderkey"], keep=["o_orderkey"]))


QUERIES["knn_regress_orders"] = q_knn_regress_orders
ORACLE["knn_regress_orders"] = f"""WITH o AS (
  SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS price, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day,
         row_number() OVER (ORDER BY {_h('o_orderkey', 42)}, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders
), n AS (SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_test FROM o),
d AS (
  SELECT t.o_orderkey, r.o_custkey AS y, sqrt((t.price - r.price) ** 2 + (t.day - r.day) ** 2) AS d, CAST(r.o_orderkey AS VARCHAR) AS k
  FROM (SELECT o.* FROM o, n WHERE rn <= n_test) t JOIN (SELECT o.* FROM o, n WHERE rn > n_test) r ON true
), five AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d, k) AS i, min(d) OVER (PARTITION BY o_orderkey) = 0 AS hit FROM d QUALIFY i <= 5),
w AS (SELECT *, CASE WHEN hit THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END AS w FROM five)
SELECT o_orderkey, {r('sum(w * y) / sum(w)')} AS prediction FROM w GROUP BY o_orderkey"""


# -- clustering scores (V5-V8) of given clusters: the market segments -------------------

def q_clustering_scores_customer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        (F.ascii("c_mktsegment") % 4).cast("int").alias("cluster"), (F.col("c_acctbal") / 1000 + F.ascii("c_mktsegment")).alias("x"), (F.col("c_nationkey") / 5.0).alias("y"))
    return rounded(Q.clustering_scores(c, ["x", "y"], "cluster"))


QUERIES["clustering_scores_customer"] = q_clustering_scores_customer
ORACLE["clustering_scores_customer"] = f"""WITH c AS (
  SELECT ascii(c_mktsegment) % 4 AS k, c_acctbal / 1000 + ascii(c_mktsegment) AS x, c_nationkey / 5.0 AS y, c_custkey AS id FROM customer
), m AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM c GROUP BY k),
far AS (SELECT a.id, a.k, b.k AS other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS total FROM c a JOIN c b ON true GROUP BY ALL),
mean AS (SELECT f.id, f.k, f.other, m.n, total / CASE WHEN f.k = f.other THEN m.n - 1 ELSE m.n END AS d FROM far f JOIN m ON m.k = f.other),
sil AS (SELECT id, max(CASE WHEN k = other THEN d END) AS a, min(CASE WHEN k <> other THEN d END) AS b FROM mean GROUP BY id),
spread AS (SELECT c.k, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s, sum((x - mx) ** 2 + (y - my) ** 2) AS w FROM c JOIN m USING (k) GROUP BY c.k),
ratio AS (SELECT a.k, max((p.s + q.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS r FROM m a JOIN m b ON a.k <> b.k JOIN spread p ON p.k = a.k JOIN spread q ON q.k = b.k GROUP BY a.k),
total AS (SELECT count(*) AS n, avg(x) AS tx, avg(y) AS ty FROM c), kk AS (SELECT count(*) AS k FROM m)
SELECT (SELECT {r('avg((b - a) / greatest(a, b))')} FROM sil) AS silhouette, (SELECT {r('avg(r)')} FROM ratio) AS davies_bouldin,
  (SELECT round(CAST((SELECT sum(m.n * ((mx - tx) ** 2 + (my - ty) ** 2)) FROM m, total) / (k - 1) / ((SELECT sum(w) FROM spread) / (total.n - k)) AS DOUBLE), 2) + 0.0 FROM kk, total) AS calinski_harabasz,
  (SELECT k FROM kk) AS n_clusters, CAST((SELECT count(*) FROM c) AS BIGINT) AS silhouette_references, 0.0 AS silhouette_error"""
