"""Model metrics and ranking (V1–V16) as aggregates over a predictions table.

Every metric is one aggregate (or a group-by on (actual, predicted)) over
``(y, p)`` columns, so it runs where the predictions are.  The exact ROC-AUC
needs cumulative counts over distinct scores; they come from a range-
partitioned sort with per-partition offsets, never from one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import cut_lineage
from .scan import one_row


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: ``rmse, mae, r2, mse`` (V1); r2 = 1 − SSres/SStot (1 or 0 when SStot = 0)."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    e = yy - pp
    ybar = pred.agg(F.avg(yy)).first()[0]
    # SStot from a centred second pass is steadier than the raw-moment form
    m = pred.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("ss_res"),
        F.sum((yy - F.lit(ybar)) ** 2).alias("ss_tot"),
    )
    r2 = F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0))
    return m.select(F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mse")


def label_rank(c: Column) -> Column:
    """Order of a label's text: numbers by value before text, text by itself."""
    return F.struct(c.try_cast("double").isNull().alias("is_text"), c.try_cast("double").alias("number"), c.alias("text"))


def classification_metrics(pred: DataFrame, y: str = "y", p: str = "p", *, positive: str | None = None) -> DataFrame:
    """One row: ``accuracy, precision, recall, f1`` (V2, V3).

    Binary when the actual labels have exactly two values: the positive class
    is ``positive``, by default the larger of the two (as numbers where they
    are numbers).  Otherwise support-weighted over the labels seen in either
    column; a zero division gives 0.  All comes from one count per (actual,
    predicted) pair, which is written once.
    """
    d = pred.select(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p"))
    conf = cut_lineage(d.groupBy("y", "p").agg(F.count(F.lit(1)).alias("c")))
    hit = F.coalesce(F.col("y") == F.col("p"), F.lit(False)) & F.col("y").isNotNull()
    known = F.col("y").isNotNull() & F.col("p").isNotNull()
    acc = conf.agg((F.sum(F.when(hit, F.col("c")).otherwise(0)) / F.sum(F.when(known, F.col("c")))).alias("accuracy"))
    labels = conf.select(F.col("y").alias("k")).union(conf.select(F.col("p").alias("k"))).distinct()
    tp = conf.where(F.col("y") == F.col("p")).select(F.col("y").alias("k"), F.col("c").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("support"))
    prd = conf.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("predicted"))
    per = (
        labels.join(tp, "k", "left").join(sup, "k", "left").join(prd, "k", "left")
        .fillna(0, ["tp", "support", "predicted"])
        .withColumn("prec", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0))
        .withColumn("rec", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
        .withColumn("f1", F.when(F.col("prec") + F.col("rec") > 0, 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0))
    )
    n_true = sup.agg(F.count(F.lit(1)).alias("n_true"))
    weighted = per.agg(
        (F.sum(F.col("prec") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("rec") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
    )
    shown = per.where("support > 0") if positive is None else per.where(F.col("k") == positive)
    top = F.struct("prec", "rec", "f1")
    pos = shown.agg(F.max_by(top, label_rank(F.col("k"))).alias("t")).select(
        F.col("t.prec").alias("bp"), F.col("t.rec").alias("br"), F.col("t.f1").alias("bf"))
    binary = F.col("n_true") == 2
    out = one_row(acc, n_true, weighted, pos)
    return out.select(
        "accuracy",
        F.when(binary, F.coalesce(F.col("bp"), F.lit(0.0))).otherwise(F.col("wp")).alias("precision"),
        F.when(binary, F.coalesce(F.col("br"), F.lit(0.0))).otherwise(F.col("wr")).alias("recall"),
        F.when(binary, F.coalesce(F.col("bf"), F.lit(0.0))).otherwise(F.col("wf")).alias("f1"),
    )


def prefix_sums(df: DataFrame, order: str, cols: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows with a smaller ``order``
    (``order`` unique).  Range-partitioned sort; each partition adds the
    totals of the partitions before it (a table of one row per partition)."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    # one exchange for both uses below: two would cut the ranges at different sampled bounds
    s = cut_lineage(df.repartitionByRange(n, order).withColumn("_pid", F.spark_partition_id()))
    totals = s.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_all = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w_all), F.lit(0)).alias(f"_o_{c}") for c in cols])
    w = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = s.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_l_{c}") for c in cols])
    out = local.join(F.broadcast(offs), "_pid")
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_before") for c in cols])


def roc_auc(pred: DataFrame, y: str = "y", score: str = "score", *, positive: str | None = None) -> DataFrame:
    """Exact ROC-AUC (V4): Mann–Whitney with ties counted half; ``positive`` as in ``classification_metrics``."""
    label = F.col(y).cast("string")
    if positive is None:
        positive = pred.agg(F.max(F.when(label.isNotNull(), label_rank(label)))["text"]).first()[0]
    d = pred.select((label == positive).alias("pos"), F.col(score).cast("double").alias("s"))
    g = d.groupBy("s").agg(F.count_if("pos").alias("np"), F.count_if(~F.col("pos")).alias("nn"))
    c = prefix_sums(g, "s", ["nn"])
    return c.agg(
        (F.sum(F.col("np") * (F.col("nn_before") + 0.5 * F.col("nn"))) / (F.sum("np") * F.sum("nn"))).alias("roc_auc")
    )


def confusion_matrix(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Counts on the grid of labels found in the actual values (V14): ``actual, predicted, count``."""
    d = pred.select(F.col(y).cast("string").alias("actual"), F.col(p).cast("string").alias("predicted"))
    labels = [r_[0] for r_ in d.select("actual").distinct().collect()]  # the classes, a short list
    grid = pred.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "actual string, predicted string")
    counts = d.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def holdout_regression(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """rmse, mae, r2 (with SStot + 1e-9), mean residual, population std of residuals."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    ybar = pred.agg(F.avg(yy)).first()[0]
    d = pred.select((yy - pp).alias("e"), ((yy - F.lit(ybar)) ** 2).alias("t"))
    return d.agg(
        F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"),
        (1 - F.sum(F.col("e") ** 2) / (F.sum("t") + 1e-9)).alias("r2"),
        F.avg("e").alias("residual_mean"), F.stddev_pop("e").alias("residual_std"),
    )


def residual_histogram(pred: DataFrame, y: str = "y", p: str = "p", bins: int = 25) -> DataFrame:
    """25-bin histogram of residuals."""
    from .eda import histogram

    res = pred.select((F.col(y).cast("double") - F.col(p).cast("double")).alias("residual"))
    return histogram(res, ["residual"], bins=bins, max_cols=1)


def residual_points(pred: DataFrame, y: str = "y", p: str = "p", keep: list[str] | None = None) -> DataFrame:
    """Predicted value and residual of every row (V13), to be drawn against each other."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    return pred.select(*(keep or []), pp.alias("predicted"), (yy - pp).alias("residual"))


def sample_check(pred: DataFrame, y: str = "y", p: str = "p", k: int = 5) -> DataFrame:
    """First k rows, actual vs predicted."""
    return pred.select(F.col(y).alias("actual"), F.col(p).alias("predicted")).limit(k)


# -- ranking ----------------------------------------------------------------

_KEYS = {
    "regression": [("rmse", "asc"), ("mae", "asc"), ("r2", "desc"), ("training_time", "asc")],
    "clustering": [("silhouette", "desc"), ("davies_bouldin", "asc"), ("training_time", "asc")],
    "classification": [("f1", "desc"), ("roc_auc", "desc"), ("precision", "desc"), ("accuracy", "desc"), ("training_time", "asc")],
}
_NOTEBOOK_KEYS = {
    "regression": [("rmse", "asc"), ("mae", "asc"), ("r2", "desc")],
    "classification": [("f1", "desc"), ("accuracy", "desc"), ("precision", "desc")],
}


def _order(keys, cols):
    out = []
    for k, how in keys:
        if k not in cols:
            continue
        c = F.col(k)
        out.append(c.asc_nulls_last() if how == "asc" else c.desc_nulls_last())
    return out


def rank_models(results: DataFrame, task: str, top_k: int = P.TOP_MODELS) -> DataFrame:
    """Leaderboard (V9): rank by the task's metric keys (a missing metric is
    worst), keep the top ``max(1, k)``; ``selection_reason`` lists the rank and the
    metrics that decided it."""
    order = _order(_KEYS[task], results.columns) + [F.col("model_name").asc()]
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # one row per model
    ranked = ranked.where(F.col("rank") <= max(1, top_k))
    shown = [k for k, _ in _KEYS[task] if k in results.columns and k != "training_time"]
    facts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("none"))) for k in shown]
    return ranked.withColumn("selection_reason", F.concat_ws(" ", F.concat(F.lit("rank="), F.col("rank").cast("string")), *facts))


def notebook_leaderboard(results: DataFrame, task: str) -> DataFrame:
    """Notebook leaderboard (V11): all models, other keys, a Rank column."""
    order = _order(_NOTEBOOK_KEYS.get(task, _KEYS[task]), results.columns) + [F.col("model_name").asc()]
    return results.withColumn("Rank", F.row_number().over(Window.orderBy(*order)))


def experiment_table(results: DataFrame) -> DataFrame:
    """Experiment rows (V10): id in run order, baseline = first, best = rank 1."""
    w = Window.orderBy("run_order")
    return results.withColumn("experiment_id", F.format_string("exp_%03d", F.row_number().over(w))).withColumn(
        "is_baseline", F.row_number().over(w) == 1
    )


def stop_rule(evaluation: DataFrame, task: str, *, iteration: int = 1, budget: int = 10) -> DataFrame:
    """Stop / tune decision from the holdout metric."""
    if task == "regression":
        m, good, poor = F.col("r2"), P.STOP_R2_GOOD, P.STOP_R2_POOR
    else:
        m, good, poor = F.col("accuracy"), P.STOP_ACC_GOOD, P.STOP_ACC_POOR
    decision = (
        F.when(F.lit(iteration >= budget), "stop_budget")
        .when(m >= good, "stop_good")
        .when((m < poor) & F.lit(iteration == 1), "tune")
        .otherwise("stop")
    )
    return evaluation.select("*", decision.alias("decision"))
