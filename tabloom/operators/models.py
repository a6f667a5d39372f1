"""Model registry and the train → predict → score step.

Spark ML estimators carry the reference's hyper-parameters (mapped to
Spark's loss scaling where they differ); kNN, AdaBoost, DBSCAN and
clustering quality are DataFrame jobs of their own (``knn``, ``boosting``,
``dbscan``, ``cluster_quality``).  Features arrive as numeric columns (the encoder's
output) and are assembled into one vector column.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.kinds import q
from . import boosting, cluster_quality, knn
from .dbscan import dbscan
from ..session import cut_lineage, spread, stored
from .metrics import classification_metrics, regression_metrics, roc_auc

REGRESSION = "regression"
CLASSIFICATION = "classification"
CLUSTERING = "clustering"

REGRESSORS = [
    "LinearRegression", "Ridge", "Lasso", "ElasticNet", "KNeighborsRegressor", "DecisionTreeRegressor",
    "RandomForestRegressor", "AdaBoostRegressor", "GradientBoostingRegressor", "HistGradientBoostingRegressor",
]
CLASSIFIERS = [
    "LogisticRegression", "KNeighborsClassifier", "DecisionTreeClassifier", "RandomForestClassifier",
    "AdaBoostClassifier", "GradientBoostingClassifier", "HistGradientBoostingClassifier", "GaussianNB", "LinearSVC",
]
CLUSTERERS = ["KMeans", "GaussianMixture", "DBSCAN"]

#: Names of parameters that are accepted besides Spark ML's own.
_ALIASES = {
    "max_depth": "maxDepth", "n_estimators": "numTrees", "learning_rate": "stepSize", "subsample": "subsamplingRate", "n_clusters": "k",
    "n_components": "k", "n_neighbors": "k", "max_iter": "maxIter",
}
_BOOSTED = ("GradientBoostingRegressor", "HistGradientBoostingRegressor", "GradientBoostingClassifier", "HistGradientBoostingClassifier")


def spark_params(name: str, params: dict | None) -> dict:
    """``params`` by Spark ML's names; a name that the model doesn't have is an error there."""
    alias = _ALIASES | ({"n_estimators": "maxIter"} if name in _BOOSTED else {})
    return {alias.get(k, k): v for k, v in (params or {}).items()}


def _known(name: str, params: dict | None, names: dict[str, str]) -> dict:
    """``params`` under the names of this library's function; any other name is an error."""
    if odd := set(params or {}) - set(names):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(odd))}")
    return {names[k]: v for k, v in (params or {}).items()}


@dataclass
class TrainResult:
    name: str
    model: object
    predict: object  # function of a table with the features: its predictions
    predictions: DataFrame  # keep columns + y + p (+ score)
    metrics: DataFrame  # one row
    seconds: float


def _label_stats(train: DataFrame, label: str):
    row = train.agg(F.count(F.col(q(label))).alias("n"), F.stddev_pop(F.col(q(label)).cast("double")).alias("s")).first()
    return row["n"], row["s"] or 0.0


def estimator(name: str, task: str, *, seed: int, n: int = 1, sigma: float = 1.0, n_classes: int = 2, alpha: float | None = None, l1_ratio: float = 0.5):
    """Spark ML estimator for a reference model name (M1–M21, M23 fallback).

    ``alpha`` and ``l1_ratio`` are those of the reference's penalised linear models.
    """
    fc, lc, pc = "features", "label", "prediction"
    if task == REGRESSION:
        if name == "LinearRegression":
            return LinearRegression(featuresCol=fc, labelCol=lc, regParam=0.0, solver="normal")
        if name == "Ridge":
            reg = (1.0 if alpha is None else alpha) * (sigma / n if sigma > 0 else 1.0 / n)
            return LinearRegression(featuresCol=fc, labelCol=lc, regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal")
        if name == "Lasso":
            return LinearRegression(featuresCol=fc, labelCol=lc, regParam=0.1 if alpha is None else alpha, elasticNetParam=1.0, standardization=False, maxIter=1000)
        if name == "ElasticNet":
            a = 0.1 if alpha is None else alpha
            one, two = a * l1_ratio, a * (1 - l1_ratio) * sigma
            lam = one + two
            return LinearRegression(featuresCol=fc, labelCol=lc, regParam=lam, elasticNetParam=one / lam if lam else 0.0, standardization=False, maxIter=1000)
        if name == "DecisionTreeRegressor":
            return DecisionTreeRegressor(featuresCol=fc, labelCol=lc, maxDepth=8, seed=seed)
        if name == "GradientBoostingRegressor":
            return GBTRegressor(featuresCol=fc, labelCol=lc, maxIter=80, stepSize=0.1, maxDepth=4, subsamplingRate=0.8, seed=seed)
        if name == "HistGradientBoostingRegressor":
            return GBTRegressor(featuresCol=fc, labelCol=lc, maxIter=80, maxBins=255, seed=seed)
        return RandomForestRegressor(featuresCol=fc, labelCol=lc, numTrees=80, maxDepth=8, seed=seed)
    if task == CLASSIFICATION:
        multi = n_classes > 2
        if name == "LogisticRegression":
            return LogisticRegression(featuresCol=fc, labelCol=lc, maxIter=1000, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                      standardization=False)
        if name == "DecisionTreeClassifier":
            return DecisionTreeClassifier(featuresCol=fc, labelCol=lc, maxDepth=8, seed=seed)
        if name in ("GradientBoostingClassifier", "HistGradientBoostingClassifier"):
            kw = dict(maxIter=80, stepSize=0.1, maxDepth=4, subsamplingRate=0.8) if name == "GradientBoostingClassifier" else dict(maxIter=80, maxBins=255)
            gbt = GBTClassifier(featuresCol=fc, labelCol=lc, seed=seed, **kw)
            return OneVsRest(classifier=gbt, featuresCol=fc, labelCol=lc) if multi else gbt
        if name == "GaussianNB":
            return NaiveBayes(featuresCol=fc, labelCol=lc, modelType="gaussian")
        if name == "LinearSVC":
            svc = LinearSVC(featuresCol=fc, labelCol=lc, maxIter=2000)
            return OneVsRest(classifier=svc, featuresCol=fc, labelCol=lc) if multi else svc
        return RandomForestClassifier(featuresCol=fc, labelCol=lc, numTrees=80, maxDepth=8, seed=seed)
    if name == "GaussianMixture":
        return GaussianMixture(featuresCol=fc, k=4, seed=seed, predictionCol=pc)
    return KMeans(featuresCol=fc, k=4, seed=seed, predictionCol=pc)


def train_and_evaluate(name: str, task: str, train: DataFrame, val: DataFrame, features: list[str], label: str | None, *,
                       key: list[str], seed: int = P.RANDOM_SEED, params: dict | None = None) -> TrainResult:
    """Fit ``name`` on ``train``, predict ``val`` and score it.

    Classification labels are indexed by their text in sorted order; the
    predictions table holds ``key…, y, p`` (and ``score`` = P(positive class)
    for binary tasks).  ``params`` are Spark ML's parameter names or the
    reference's (``n_estimators``, ``max_depth``, ...); a name that the model
    doesn't have raises an error.
    """
    t0 = time.perf_counter()
    train, val = spread(train), spread(val)
    if task == CLUSTERING:
        return _cluster(name, train, val, features, key, seed, params)
    if name in ("KNeighborsRegressor", "KNeighborsClassifier", "AdaBoostClassifier", "AdaBoostRegressor"):
        if name.startswith("K"):
            own = _known(name, params, {"k": "k", "n_neighbors": "k", "max_rows": "max_rows"})
            most = own.pop("max_rows", None)  # all rows, unless the caller asks for a sample
            train = train.select(*[q(c) for c in dict.fromkeys([*key, *features, label])])
            train = stored(train if most is None else knn.sample_train(train, key, max_rows=most, seed=seed))
            model = knn.KnnModel(task, features, label, key, train, max_rows=most, **own)
        else:
            own = _known(name, params, {"n_estimators": "rounds", "rounds": "rounds", "learning_rate": "learning_rate", "max_depth": "max_depth"})
            model = boosting.fit_adaboost(train, features, label, task=task, seed=seed, **own)

        def predict(d: DataFrame) -> DataFrame:
            return model.predict(d, keep=key + [label]).withColumnRenamed(label, "y").withColumnRenamed("prediction", "p")
    else:
        predict, model = _spark_ml(name, task, train, features, label, key, seed, params)
    pred = cut_lineage(predict(val))  # scored once, read by every metric
    seconds = round(time.perf_counter() - t0, 4)
    return TrainResult(name, model, predict, pred, score(pred, task), seconds)


def score(pred: DataFrame, task: str) -> DataFrame:
    """One row of metrics of a predictions table (y, p and for two classes score)."""
    if task == REGRESSION:
        return regression_metrics(pred, "y", "p")
    metrics = classification_metrics(pred, "y", "p")
    labels = [r_[0] for r_ in pred.select(F.col("y").cast("string")).distinct().limit(3).collect()]
    if len(labels) == 2 and "score" in pred.columns:
        from .scan import one_row

        metrics = one_row(metrics, roc_auc(pred, "y", "score"))
    return metrics


def evaluate(res: TrainResult, task: str, data: DataFrame) -> TrainResult:
    """The fitted model of ``res`` applied to other rows; nothing is trained again."""
    pred = cut_lineage(res.predict(data))
    return TrainResult(res.name, res.model, res.predict, pred, score(pred, task), res.seconds)


def _assembler(features):
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _spark_ml(name, task, train, features, label, key, seed, params):
    if task == CLASSIFICATION:
        classes = sorted(r_[0] for r_ in train.select(F.col(q(label)).cast("string")).distinct().collect())
        index = {c: float(i) for i, c in enumerate(classes)}
        mapping = F.create_map(*[x for c, i in index.items() for x in (F.lit(c), F.lit(i))])
        lab = mapping[F.col(q(label)).cast("string")]
        n, sigma = train.count(), 0.0
        est = estimator(name, task, seed=seed, n=n, n_classes=len(classes))
        own = spark_params(name, params)
    else:
        lab = F.col(q(label)).cast("double")
        n, sigma = _label_stats(train, label)
        own = spark_params(name, params)
        linear = {k: own.pop(k) for k in ("alpha", "l1_ratio") if k in own and name in ("Ridge", "Lasso", "ElasticNet")}
        est = estimator(name, task, seed=seed, n=n, sigma=sigma, **linear)
        classes = None
    tr = train.select(*[F.col(q(c)).cast("double").alias(c) for c in features], lab.alias("label")).where(F.col("label").isNotNull())
    base = est.getClassifier() if isinstance(est, OneVsRest) else est
    base.setParams(**own)
    model = Pipeline(stages=[_assembler(features), est]).fit(tr)

    def predict(d: DataFrame) -> DataFrame:
        rows = d.select(*[q(k) for k in key], F.col(q(label)).alias("_actual"), *[F.col(q(c)).cast("double").alias(c) for c in features])
        out = model.transform(rows)
        if task != CLASSIFICATION:
            return out.select(*[q(k) for k in key], F.col("_actual").cast("double").alias("y"), F.col("prediction").alias("p"))
        names = F.array(*[F.lit(c) for c in classes])
        p = F.element_at(names, F.col("prediction").cast("int") + 1)
        cols = [*[q(k) for k in key], F.col("_actual").cast("string").alias("y"), p.alias("p")]
        one = knn.positive_class(classes)
        if "probability" in out.columns and one is not None:
            cols.append(vector_to_array("probability")[one].alias("score"))
        return out.select(*cols)

    return predict, model


def _cluster(name, train, val, features, key, seed, params):
    t0 = time.perf_counter()
    tr = train.select(*[q(k) for k in key], *[F.col(q(c)).cast("double").alias(c) for c in features])
    if name == "DBSCAN":
        own = _known(name, params, {"eps": "eps", "min_samples": "min_samples"})
        found = stored(dbscan(tr, features, key=key, **own))
        model = None
        labelled = tr.join(found.select(*[F.col(q(k)).alias(f"_k{i}") for i, k in enumerate(key)], F.col("cluster").cast("int").alias("cluster")),
                           _same_key(key), "left").drop(*[f"_k{i}" for i in range(len(key))])

        def predict(d: DataFrame) -> DataFrame:
            """Clusters of the rows that were clustered; the method has no rule for others, which get -1."""
            near = found.select(*[F.col(q(k)).alias(f"_k{i}") for i, k in enumerate(key)], F.col("cluster").cast("int").alias("_c"))
            return d.select(*[q(k) for k in key]).join(near, _same_key(key), "left").select(*[q(k) for k in key], F.coalesce("_c", F.lit(-1)).alias("p"))
    else:
        est = estimator(name, CLUSTERING, seed=seed)
        est.setParams(**spark_params(name, params))
        model = Pipeline(stages=[_assembler(features), est]).fit(tr)
        labelled = model.transform(tr).select(*[q(k) for k in key], *features, F.col("prediction").cast("int").alias("cluster"))

        def predict(d: DataFrame) -> DataFrame:
            rows = d.select(*[q(k) for k in key], *[F.col(q(c)).cast("double").alias(c) for c in features])
            return model.transform(rows).select(*[q(k) for k in key], F.col("prediction").cast("int").alias("p"))

    seconds = round(time.perf_counter() - t0, 4)
    metrics = cluster_quality.clustering_scores(labelled, features, "cluster")
    return TrainResult(name, model, predict, predict(val), metrics, seconds)


def _same_key(key: list[str]):
    out = F.lit(True)
    for i, k in enumerate(key):
        out = out & F.col(q(k)).eqNullSafe(F.col(f"_k{i}"))
    return out


def leaderboard_row(res: TrainResult, task: str) -> DataFrame:
    """Metrics row with model name and training time, for ``rank_models``."""
    return res.metrics.select(F.lit(res.name).alias("model_name"), "*", F.lit(res.seconds).alias("training_time"))


def model_file_name(rank: int, name: str) -> str:
    """``model_<rank>_<snake_name>``."""
    import re

    return f"model_{rank}_" + re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def save_top_models(results: dict, leaderboard: DataFrame, root: str) -> dict[str, str]:
    """Save the ranked models and the best one under ``root`` (V17); returns name → path.

    Spark ML pipelines as such, AdaBoost as its trees' rules, kNN as its
    rows; DBSCAN has no model beyond its labels.
    """
    spark, paths = leaderboard.sparkSession, {}

    def save(model, path: str) -> None:
        if hasattr(model, "write"):
            model.write().overwrite().save(path)
        else:
            model.save(spark, path)

    for row in leaderboard.orderBy("rank").collect():
        model = results[row["model_name"]].model
        if model is None:
            continue
        path = f"{root}/{model_file_name(row['rank'], row['model_name'])}"
        save(model, path)
        paths[row["model_name"]] = path
        if row["rank"] == 1:
            save(model, f"{root}/best_model")
    return paths


def load_model(path: str, spark: SparkSession | None = None):
    """Reload a saved model (V17): a Spark ML pipeline, an ``AdaBoostModel`` or a ``KnnModel``."""
    from pyspark.ml import PipelineModel

    spark = spark or SparkSession.getActiveSession()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/model")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    row = spark.read.schema("kind string, model string").json(f"{path}/model").first()
    return boosting.AdaBoostModel.from_json(row["model"]) if row["kind"] == "adaboost" else knn.KnnModel.load(spark, path, row["model"])
