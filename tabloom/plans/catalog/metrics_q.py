"""Registered metric queries (V1–V16, M1, M5, M12) and their DuckDB oracles.

Predictions come from models whose fit SQL can reproduce: a one-feature
least-squares line (M1) and k-nearest neighbours on the embedding vectors
(M5, M12).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import patterns as P
from ...operators import knn as K
from ...operators import metrics as V
from ...operators import split as S
from ...operators.models import REGRESSION, train_and_evaluate
from ._common import r, rounded, table, union_all
from .split_q import LINEITEM_REST, _alloc_sql, _h, temporal_order_sql


def _lineitem_split(spark, sf_dir):
    return S.temporal_split(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate", tiebreak=["l_orderkey", "l_linenumber"])


def _linreg(spark, sf_dir, model="LinearRegression", feature="l_quantity"):
    s = _lineitem_split(spark, sf_dir)
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test")
    return train_and_evaluate(model, REGRESSION, train, test, [feature], "l_extendedprice",
                              key=["l_orderkey", "l_linenumber"])


def q_linreg_predictions_lineitem(spark, sf_dir):
    res = _linreg(spark, sf_dir)
    return rounded(res.predictions.select("l_orderkey", "l_linenumber", "y", "p"), 2)


def q_metrics_regression_lineitem(spark, sf_dir):
    return rounded(_linreg(spark, sf_dir).metrics, 2)


def q_holdout_lineitem(spark, sf_dir):
    return rounded(V.holdout_regression(_linreg(spark, sf_dir).predictions), 2)


def q_residual_hist_lineitem(spark, sf_dir):
    h = V.residual_histogram(_linreg(spark, sf_dir).predictions)
    return h.select(F.col("bin").cast("long").alias("bin"), F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), "count")


_LI_SPLIT = f"""n AS (SELECT count(*) AS n FROM lineitem),
sz AS (SELECT n, greatest(1, CAST(floor(n * {P.TEST_SIZE}) AS BIGINT)) AS n_test, greatest(1, CAST(floor(n * {P.VAL_SIZE}) AS BIGINT)) AS n_val FROM n),
ranked AS (SELECT *, row_number() OVER (ORDER BY {temporal_order_sql('l_shipdate', ['l_orderkey', 'l_linenumber'], LINEITEM_REST)}) AS rn FROM lineitem),
lab AS (SELECT ranked.*, CASE WHEN rn <= n - n_test - n_val THEN 'train' WHEN rn <= n - n_test THEN 'val' ELSE 'test' END AS split FROM ranked, sz),
fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lab WHERE split = 'train'),
pred AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, a + b * l_quantity AS p FROM lab, fit WHERE split = 'test')"""

SQL_LINREG_PRED = f"WITH {_LI_SPLIT} SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " \
                  f"round(y, 2) AS y, round(p, 2) AS p FROM pred"
SQL_METRICS_REG = f"""WITH {_LI_SPLIT},
m AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, sum((y - p) * (y - p)) AS ss_res,
             sum((y - (SELECT avg(y) FROM pred)) * (y - (SELECT avg(y) FROM pred))) AS ss_tot FROM pred)
SELECT round(sqrt(mse), 2) AS rmse, round(mae, 2) AS mae, round(1 - ss_res / ss_tot, 2) + 0.0 AS r2, round(mse, 2) AS mse FROM m"""
SQL_HOLDOUT = f"""WITH {_LI_SPLIT},
e AS (SELECT y - p AS e, (y - (SELECT avg(y) FROM pred)) * (y - (SELECT avg(y) FROM pred)) AS t FROM pred)
SELECT round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, round(1 - sum(e * e) / (sum(t) + 1e-9), 2) + 0.0 AS r2,
  round(avg(e), 2) AS residual_mean, round(stddev_pop(e), 2) AS residual_std FROM e"""
SQL_RESID_HIST = f"""WITH {_LI_SPLIT},
e AS (SELECT y - p AS v FROM pred),
b AS (SELECT min(v) AS e0, (max(v) - min(v)) / 25 AS w FROM e),
c AS (SELECT CAST(least(floor((v - e0) / w), 24) AS BIGINT) AS bin, count(*) AS cnt FROM e, b GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, round(e0 + g.bin * w, 2) AS lo, round(e0 + (g.bin + 1) * w, 2) AS hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM range(0, 25) g(bin) CROSS JOIN b LEFT JOIN c ON c.bin = g.bin"""


# -- kNN on the embedding vectors ------------------------------------------------

def _emb_split(spark, sf_dir, target="label"):
    emb = table(spark, sf_dir, "embeddings")
    if target != "label":
        emb = emb.withColumn(target, F.when(F.col("label") == 0, "1").otherwise("0"))
    return S.random_split(emb, target, keys=["vec_id"])


def _knn(spark, sf_dir, task="classification", target="label"):
    s = _emb_split(spark, sf_dir, target)
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test")
    return K.knn_predict(train, test, ["embedding"], target, key=["vec_id"], task=task, keep=["vec_id", target])


def q_knn_classify_embeddings(spark, sf_dir):
    return _knn(spark, sf_dir).select("vec_id", "prediction")


def q_knn_regress_embeddings(spark, sf_dir):
    return rounded(_knn(spark, sf_dir, task="regression").select("vec_id", "prediction"))


def q_metrics_multiclass_embeddings(spark, sf_dir):
    p = _knn(spark, sf_dir)
    return rounded(V.classification_metrics(p, "label", "prediction"))


def q_confusion_embeddings(spark, sf_dir):
    return V.confusion_matrix(_knn(spark, sf_dir), "label", "prediction")


def q_metrics_binary_embeddings(spark, sf_dir):
    p = _knn(spark, sf_dir, target="is_zero")
    m = V.classification_metrics(p, "is_zero", "prediction")
    from ...operators.scan import one_row

    return rounded(one_row(m, V.roc_auc(p, "is_zero", "score")))


def _emb_sql(target_expr: str) -> str:
    """Stratified seeded split of embeddings (as ``random_split``) and the 5 nearest train rows of each test row."""
    return f"""emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, {target_expr} AS cls FROM embeddings),
cnt0 AS (SELECT cls, count(*) AS cnt FROM emb GROUP BY 1),
tot AS (SELECT sum(cnt) AS n, CAST(ceil(sum(cnt) * {P.TEST_SIZE}) AS BIGINT) AS n_test FROM cnt0),
{_alloc_sql('cnt0', '(SELECT n - n_test FROM tot)', 'tv')},
cnt1 AS (SELECT cls, alloc AS cnt FROM tv),
nv AS (SELECT CAST(ceil((n - n_test) * ({P.VAL_SIZE} / (1.0 - {P.TEST_SIZE}))) AS BIGINT) AS n_val, n - n_test AS n_rest FROM tot),
{_alloc_sql('cnt1', '(SELECT n_rest - n_val FROM nv)', 'tr2')},
cuts AS (SELECT c0.cls, c0.cnt - tv.alloc AS test_c, tv.alloc - tr2.alloc AS val_c FROM cnt0 c0 JOIN tv USING (cls) JOIN tr2 USING (cls)),
ranked AS (SELECT emb.*, row_number() OVER (PARTITION BY cls ORDER BY {_h('vec_id', P.RANDOM_SEED)}, CAST(vec_id AS VARCHAR)) AS rn FROM emb),
lab AS (SELECT ranked.*, CASE WHEN rn <= test_c THEN 'test' WHEN rn <= test_c + val_c THEN 'val' ELSE 'train' END AS split FROM ranked JOIN cuts USING (cls)),
pairs AS (SELECT t.vec_id, t.cls AS actual, r.cls AS ncls, list_distance(t.x, r.x) AS d,
                 row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.x, r.x), r.vec_id) AS k
          FROM lab t JOIN lab r ON t.split = 'test' AND r.split = 'train'),
nn AS (SELECT *, CASE WHEN bool_or(d = 0) OVER (PARTITION BY vec_id) THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END AS w
       FROM pairs WHERE k <= {P.KNN_NEIGHBOURS})"""


def _vote_sql(target_expr: str) -> str:
    return f"""WITH {_emb_sql(target_expr)},
votes AS (SELECT vec_id, actual, CAST(ncls AS VARCHAR) AS c, sum(w) AS s FROM nn GROUP BY 1, 2, 3),
best AS (SELECT vec_id, actual, c AS prediction, s / sum(s) OVER (PARTITION BY vec_id) AS share,
                row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS o FROM votes),
pred AS (SELECT vec_id, CAST(actual AS VARCHAR) AS y, prediction AS p FROM best WHERE o = 1),
score AS (SELECT vec_id, coalesce(max(share) FILTER (WHERE c = '1'), 0.0) AS score
          FROM (SELECT vec_id, c, s / sum(s) OVER (PARTITION BY vec_id) AS share FROM votes) GROUP BY 1)"""


SQL_KNN_CLASSIFY = _vote_sql("label") + "\nSELECT vec_id, p AS prediction FROM pred"
SQL_KNN_REGRESS = f"""WITH {_emb_sql('label')}
SELECT vec_id, {r('sum(w * ncls) / sum(w)')} AS prediction FROM nn GROUP BY vec_id"""


def _metrics_sql(target_expr: str, binary: bool) -> str:
    base = _vote_sql(target_expr) + """,
labels AS (SELECT y AS k FROM pred UNION SELECT p FROM pred),
per AS (SELECT k, count(*) FILTER (WHERE y = k AND p = k) AS tp, count(*) FILTER (WHERE y = k) AS sup,
               count(*) FILTER (WHERE p = k) AS prd FROM labels, pred GROUP BY k),
pm AS (SELECT k, sup, CASE WHEN prd > 0 THEN tp * 1.0 / prd ELSE 0.0 END AS pr, CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0.0 END AS rc FROM per),
pf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pm)"""
    if binary:
        return base + f""",
auc AS (SELECT (sum(CASE WHEN p.y = '1' THEN (SELECT count(*) FROM pred p2 JOIN score s2 USING (vec_id) WHERE p2.y <> '1' AND s2.score < s.score)
                                        + 0.5 * (SELECT count(*) FROM pred p2 JOIN score s2 USING (vec_id) WHERE p2.y <> '1' AND s2.score = s.score) END))
               / ((SELECT count(*) FROM pred WHERE y = '1') * (SELECT count(*) FROM pred WHERE y <> '1')) AS roc_auc
        FROM pred p JOIN score s USING (vec_id))
SELECT {r("(SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM pred)")} AS accuracy,
  {r("coalesce((SELECT pr FROM pf WHERE k = '1'), 0.0)")} AS precision, {r("coalesce((SELECT rc FROM pf WHERE k = '1'), 0.0)")} AS recall,
  {r("coalesce((SELECT f1 FROM pf WHERE k = '1'), 0.0)")} AS f1, {r('roc_auc')} AS roc_auc FROM auc"""
    return base + f"""
SELECT {r("(SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM pred)")} AS accuracy,
  {r('sum(pr * sup) / sum(sup)')} AS precision, {r('sum(rc * sup) / sum(sup)')} AS recall, {r('sum(f1 * sup) / sum(sup)')} AS f1 FROM pf"""


SQL_CONFUSION = _vote_sql("label") + """,
lbl AS (SELECT DISTINCT y AS k FROM pred)
SELECT a.k AS actual, b.k AS predicted, CAST((SELECT count(*) FROM pred WHERE y = a.k AND p = b.k) AS BIGINT) AS count FROM lbl a, lbl b"""

BINARY_TARGET = "CASE WHEN label = 0 THEN '1' ELSE '0' END"


def q_rank_models_embeddings(spark, sf_dir):
    """Leaderboard (V9) of kNN and the seeded tree models on the embedding classes."""
    from ...operators.models import CLASSIFICATION, leaderboard_row
    from ...operators.scan import materialize_small

    s = _emb_split(spark, sf_dir)
    dims = s.agg(F.max(F.size("embedding"))).first()[0]  # the whole vector
    emb = s.select("vec_id", "label", "split", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])
    feats = [f"e{i}" for i in range(dims)]
    train, val = emb.where(F.col("split") == "train"), emb.where(F.col("split") == "val")
    rows = None
    for name in ["KNeighborsClassifier", "DecisionTreeClassifier", "GaussianNB"]:
        res = train_and_evaluate(name, CLASSIFICATION, train, val, feats, "label", key=["vec_id"])
        row = materialize_small(leaderboard_row(res, CLASSIFICATION))
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    ranked = V.rank_models(rows, CLASSIFICATION, top_k=P.TOP_MODELS)
    return ranked.select("rank", "model_name", "f1", "accuracy", "selection_reason")


QUERIES = {
    "linreg_predictions_lineitem": q_linreg_predictions_lineitem,
    "metrics_regression_lineitem": q_metrics_regression_lineitem,
    "holdout_lineitem": q_holdout_lineitem,
    "residual_hist_lineitem": q_residual_hist_lineitem,
    "knn_classify_embeddings": q_knn_classify_embeddings,
    "knn_regress_embeddings": q_knn_regress_embeddings,
    "metrics_multiclass_embeddings": q_metrics_multiclass_embeddings,
    "confusion_embeddings": q_confusion_embeddings,
    "metrics_binary_embeddings": q_metrics_binary_embeddings,
    "rank_models_embeddings": q_rank_models_embeddings,
}
ORACLE = {
    "linreg_predictions_lineitem": SQL_LINREG_PRED,
    "metrics_regression_lineitem": SQL_METRICS_REG,
    "holdout_lineitem": SQL_HOLDOUT,
    "residual_hist_lineitem": SQL_RESID_HIST,
    "knn_classify_embeddings": SQL_KNN_CLASSIFY,
    "knn_regress_embeddings": SQL_KNN_REGRESS,
    "metrics_multiclass_embeddings": _metrics_sql("label", False),
    "confusion_embeddings": SQL_CONFUSION,
    "metrics_binary_embeddings": _metrics_sql(BINARY_TARGET, True),
}


def _knn_leaderboard(spark, sf_dir):
    """kNN classifiers with k = 1, 3, 5 on the embedding classes, as experiment rows."""
    s = _emb_split(spark, sf_dir)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    rows = None
    for order, k in enumerate([1, 3, 5]):
        p = K.knn_predict(train, test, ["embedding"], "label", key=["vec_id"], k=k, keep=["vec_id", "label"])
        m = V.classification_metrics(p, "label", "prediction").select(
            F.lit(f"KNeighborsClassifier_k{k}").alias("model_name"), F.lit(order).alias("run_order"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rows


def q_experiments_embeddings(spark, sf_dir):
    """Experiment table (V10) and notebook leaderboard (V11) over real kNN runs."""
    rows = _knn_leaderboard(spark, sf_dir)
    board = V.notebook_leaderboard(V.experiment_table(rows), "classification")
    return rounded(board.select("experiment_id", "model_name", "is_baseline", F.col("Rank").cast("long").alias("board_rank"), "f1", "accuracy"))


def q_stop_rule_lineitem(spark, sf_dir):
    """Stop / tune decision on the holdout r2 of the least-squares line."""
    ev = V.holdout_regression(_linreg(spark, sf_dir).predictions)
    return V.stop_rule(ev, "regression").select(F.round("r2", 2).alias("r2"), "decision")


def q_sample_check_embeddings(spark, sf_dir):
    """First 5 test rows by key, actual vs predicted."""
    p = _knn(spark, sf_dir).orderBy("vec_id")
    return V.sample_check(p, "label", "prediction").select(F.col("actual").cast("string").alias("actual"), "predicted")


QUERIES["experiments_embeddings"] = q_experiments_embeddings
QUERIES["stop_rule_lineitem"] = q_stop_rule_lineitem
QUERIES["sample_check_embeddings"] = q_sample_check_embeddings
ORACLE["stop_rule_lineitem"] = SQL_HOLDOUT.replace(
    "SELECT round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, round(1 - sum(e * e) / (sum(t) + 1e-9), 2) + 0.0 AS r2,\n"
    "  round(avg(e), 2) AS residual_mean, round(stddev_pop(e), 2) AS residual_std FROM e",
    "SELECT round(1 - sum(e * e) / (sum(t) + 1e-9), 2) + 0.0 AS r2, CASE WHEN 1 - sum(e * e) / (sum(t) + 1e-9) >= 0.85 THEN 'stop_good' "
    "WHEN 1 - sum(e * e) / (sum(t) + 1e-9) < 0.3 THEN 'tune' ELSE 'stop' END AS decision FROM e")
ORACLE["sample_check_embeddings"] = SQL_KNN_CLASSIFY.replace("\nSELECT vec_id, p AS prediction FROM pred",
                                                            "\nSELECT y AS actual, p AS predicted FROM pred ORDER BY vec_id LIMIT 5")


def q_roc_auc_lineitem(spark, sf_dir):
    """ROC-AUC (V4) of the extended price as a score for returned lines: tens of thousands of distinct scores."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), F.col("l_extendedprice").alias("score"))
    return rounded(V.roc_auc(li, "y", "score"), 9)


def q_label_kinds_lineitem(spark, sf_dir):
    """Binary metrics (V2, V3) for the same labels as boolean, double and text: the larger label is positive."""
    li = table(spark, sf_dir, "lineitem")
    y, p = F.col("l_returnflag") == "R", F.col("l_quantity") > 30
    kinds = {
        "boolean": (y, p), "double": (y.cast("double"), p.cast("double")),
        "text": (F.when(y, "yes").otherwise("no"), F.when(p, "yes").otherwise("no")),
    }
    rows = None
    for kind, (a, b) in kinds.items():
        m = V.classification_metrics(li.select(a.alias("y"), b.alias("p"))).select(F.lit(kind).alias("kind"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rounded(rows)


QUERIES["roc_auc_lineitem"] = q_roc_auc_lineitem
QUERIES["label_kinds_lineitem"] = q_label_kinds_lineitem
ORACLE["roc_auc_lineitem"] = """WITH g AS (
  SELECT l_extendedprice AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS np, count(*) FILTER (WHERE l_returnflag <> 'R') AS nn FROM lineitem GROUP BY 1
), c AS (SELECT np, nn, sum(nn) OVER (ORDER BY s) - nn AS below FROM g)
SELECT round(sum(np * (below + 0.5 * nn)) / (sum(np) * sum(nn)), 9) AS roc_auc FROM c"""
ORACLE["label_kinds_lineitem"] = f"""WITH c AS (
  SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) AS n,
         count(*) FILTER (WHERE y = p) AS ok
  FROM (SELECT l_returnflag = 'R' AS y, l_quantity > 30 AS p FROM lineitem)
) SELECT kind, {r('ok / n')} AS accuracy, {r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall, {r('2 * tp / (2 * tp + fp + fn)')} AS f1
FROM c, (VALUES ('boolean'), ('double'), ('text')) k(kind)"""


# -- penalised lines (M2-M4): one feature has a closed form ------------------------------

def q_penalised_predictions_lineitem(spark, sf_dir, *, model):
    return rounded(_linreg(spark, sf_dir, model).predictions.select("l_orderkey", "l_linenumber", "y", "p"), 2)


#: Slope from the centred sums: the reference's ridge, lasso and elastic net of one feature.
_SLOPES = {
    "Ridge": "sxy / (sxx + 1.0)",
    "Lasso": "sign(sxy) * greatest(abs(sxy) / n - 0.1, 0) / (sxx / n)",
    "ElasticNet": "sign(sxy) * greatest(abs(sxy) / n - 0.05, 0) / (sxx / n + 0.05)",
}
_SUMS = """sums AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
  covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx FROM lab WHERE split = 'train')"""

from functools import partial  # noqa: E402

for _m, _slope in _SLOPES.items():
    QUERIES[f"{_m.lower()}_predictions_lineitem"] = partial(q_penalised_predictions_lineitem, model=_m)
    ORACLE[f"{_m.lower()}_predictions_lineitem"] = f"""WITH {_LI_SPLIT}, {_SUMS}, b AS (SELECT {_slope} AS b, mx, my FROM sums)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice, 2) AS y, round(my + b * (l_quantity - mx), 2) AS p
FROM lab, b WHERE split = 'test'"""


# -- points behind the charts (V13, E7) ---------------------------------------------------

def q_residual_points_lineitem(spark, sf_dir):
    return rounded(V.residual_points(_linreg(spark, sf_dir).predictions, keep=["l_orderkey", "l_linenumber"]), 2)


QUERIES["residual_points_lineitem"] = q_residual_points_lineitem
ORACLE["residual_points_lineitem"] = f"""WITH {_LI_SPLIT} SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(p, 2) AS predicted, round(y - p, 2) + 0.0 AS residual FROM pred"""


# -- ranking (V9-V11) of three lines ---------------------------------------------------

_LINES = ["l_quantity", "l_discount", "l_tax"]


def _three_lines(spark, sf_dir):
    from ...operators.scan import materialize_small

    out = None
    for i, f in enumerate(_LINES):
        row = _linreg(spark, sf_dir, feature=f).metrics.select(F.lit(f"by_{f}").alias("model_name"), F.lit(i).alias("run_order"), "rmse", "mae", "r2")
        out = row if out is None else out.unionByName(row)
    return materialize_small(out)


def q_leaderboard_lineitem(spark, sf_dir):
    """Ranked models (V9) with the notebook's rank (V11) and the experiment ids (V10) beside it."""
    found = _three_lines(spark, sf_dir)
    ranked = V.rank_models(found, REGRESSION, top_k=2).select("model_name", "rank")
    noted = V.notebook_leaderboard(found, REGRESSION).select("model_name", F.col("Rank").alias("notebook_rank"))
    runs = V.experiment_table(found).select("model_name", "experiment_id", "is_baseline")
    return runs.join(noted, "model_name").join(ranked, "model_name", "left").select(
        "model_name", "experiment_id", "is_baseline", F.col("notebook_rank").cast("long").alias("notebook_rank"), F.col("rank").cast("long").alias("rank"))


QUERIES["leaderboard_lineitem"] = q_leaderboard_lineitem
ORACLE["leaderboard_lineitem"] = f"""WITH {_LI_SPLIT}, """ + ", ".join(
    f"""m{i} AS (SELECT 'by_{f}' AS model_name, {i} AS run_order, sqrt(avg((l_extendedprice - a - b * {f}) ** 2)) AS rmse FROM lab,
  (SELECT regr_slope(l_extendedprice, {f}) AS b, regr_intercept(l_extendedprice, {f}) AS a FROM lab WHERE split = 'train') fit{i} WHERE split = 'test')"""
    for i, f in enumerate(_LINES)
) + """, m AS (SELECT *, CAST(row_number() OVER (ORDER BY rmse) AS BIGINT) AS r FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2))
SELECT model_name, printf('exp_%03d', run_order + 1) AS experiment_id, run_order = 0 AS is_baseline, r AS notebook_rank, CASE WHEN r <= 2 THEN r END AS rank FROM m"""
