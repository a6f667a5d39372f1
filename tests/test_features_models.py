"""Features, encoding, metrics, ranking and models (FIXTURES.md §7, §8)."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import encode as R
from tabloom.operators import features as FE
from tabloom.operators import metrics as V
from tabloom.operators import models as M


@pytest.fixture(scope="module")
def fe_frames(spark):
    schema = "num1 double, num2 double, cat1 string, skewed double"
    train = spark.createDataFrame([(10.0, 2.0, "Low", 1.0), (20.0, 4.0, "High", 2.0), (30.0, 6.0, "Low", 1.0),
                                   (40.0, 8.0, "Medium", 1.0), (50.0, 10.0, "High", 1000.0)], schema)
    test = spark.createDataFrame([(15.0, 3.0, "Low", 1.5), (25.0, 5.0, "High", 500.0)], schema)
    return train, test


def test_features(spark, fe_frames):
    train, test = fe_frames
    plan = FE.fit_features(train)
    assert plan.log_columns == []  # 5 rows ≤ 10
    a, b = plan.transform(train), plan.transform(test)
    assert len(a.columns) == len(b.columns) == 4 + 6
    assert "diff_num1_num2" in a.columns and "ratio_num1_num2" in a.columns
    assert plan.log(spark).where("retained").count() == 6


def test_encoder(spark, fe_frames):
    train, test = fe_frames
    enc = R.fit_encoder(train)
    assert enc.means["num1"] == pytest.approx(30.0) and enc.scales["num1"] == pytest.approx(14.142135623730951)
    assert enc.low_card["cat1"] == ["High", "Low", "Medium"]
    out = enc.transform(test)
    assert out.columns == ["num1", "num2", "skewed", "cat1_High", "cat1_Low", "cat1_Medium"]
    assert out.where(" OR ".join(f"`{c}` IS NULL" for c in out.columns)).count() == 0
    unseen = enc.transform(spark.createDataFrame([(1.0, 1.0, "Other", None)], "num1 double, num2 double, cat1 string, skewed double"))
    r = unseen.first()
    assert (r["cat1_High"], r["cat1_Low"], r["cat1_Medium"]) == (0.0, 0.0, 0.0)


def test_frequency_encoding(spark):
    rows = [(f"v{i % 20}",) for i in range(100)] + [(None,)] * 10
    df = spark.createDataFrame(rows, "c string")
    enc = R.fit_encoder(df)
    assert enc.high_card == ["c"]
    got = {r["c"]: r["freq_c"] for r in enc.transform(spark.createDataFrame([("v1",), ("zz",), (None,)], "c string"), keep=["c"]).collect()}
    assert got["v1"] == pytest.approx(5 / 110) and got["zz"] == 0.0 and got[None] == pytest.approx(10 / 110)


def test_metrics_and_auc(spark):
    pred = spark.createDataFrame([("1", "1", 0.9), ("0", "1", 0.8), ("1", "0", 0.3), ("0", "0", 0.3), ("1", "1", 0.7)], "y string, p string, score double")
    m = V.classification_metrics(pred).first()
    assert m["accuracy"] == pytest.approx(0.6) and m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)
    auc = V.roc_auc(pred).first()["roc_auc"]
    assert auc == pytest.approx(3.5 / 6)  # 6 (pos, neg) pairs: 3 won, 1 tied (half), 2 lost
    reg = V.regression_metrics(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")).first()
    assert reg["mae"] == pytest.approx(0.5) and reg["r2"] == pytest.approx(1 - 1.25 / 2)


def test_rank_models(spark):
    res = spark.createDataFrame([("a", 1.0, 0.5, 0.1, 2.0), ("b", 0.5, 0.4, 0.5, 3.0), ("c", None, 0.2, 0.9, 1.0)],
                                "model_name string, rmse double, mae double, r2 double, training_time double")
    ranked = V.rank_models(res, "regression", top_k=2).orderBy("rank").collect()
    assert [r["model_name"] for r in ranked] == ["b", "a"]
    assert ranked[0]["selection_reason"].startswith("rank=1 rmse=0.5 ")


@pytest.fixture(scope="module")
def cls_data(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(100):
        y = i % 2
        rows.append((i, rnd.gauss(2.0 * y, 1.0), rnd.gauss(-1.0 * y, 1.0), y))
    df = spark.createDataFrame(rows, "k bigint, feature_1 double, feature_2 double, y int")
    return df.where("k < 80"), df.where("k >= 80")


@pytest.mark.parametrize("name", ["LogisticRegression", "GaussianNB", "KNeighborsClassifier", "DecisionTreeClassifier", "AdaBoostClassifier"])
def test_classifiers(cls_data, name):
    train, test = cls_data
    res = M.train_and_evaluate(name, M.CLASSIFICATION, train, test, ["feature_1", "feature_2"], "y", key=["k"])
    m = res.metrics.first().asDict()
    assert {"accuracy", "f1", "precision", "recall"} <= set(m)
    assert res.predictions.count() == 20
    assert m["accuracy"] > 0.6  # beats the constant baseline (0.5)


@pytest.mark.parametrize("name", ["LinearRegression", "Ridge", "KNeighborsRegressor", "AdaBoostRegressor"])
def test_regressors(spark, name):
    import random

    rnd = random.Random(5)
    rows = [(i, a, b, 3 * a - 2 * b + rnd.gauss(0, 0.1)) for i, (a, b) in enumerate((rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(60))]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, y double")
    res = M.train_and_evaluate(name, M.REGRESSION, df.where("k < 50"), df.where("k >= 50"), ["a", "b"], "y", key=["k"])
    m = res.metrics.first()
    assert res.predictions.count() == 10 and m["rmse"] is not None and m["r2"] > 0.3


def test_clustering(spark):
    import random

    rnd = random.Random(9)
    rows = [(i, rnd.gauss(5 * (i % 3), 0.3), rnd.gauss(-5 * (i % 3), 0.3)) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, f1 double, f2 double")
    res = M.train_and_evaluate("KMeans", M.CLUSTERING, df, df, ["f1", "f2"], None, key=["k"])
    m = res.metrics.first()
    assert m["n_clusters"] == 4 and -1 <= m["silhouette"] <= 1


def test_save_and_reload_models(spark, tmp_path):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(40)]
    df = spark.createDataFrame([(k, a, b, 2 * a + b) for k, a, b in rows], "k bigint, a double, b double, y double")
    res = {n: M.train_and_evaluate(n, M.REGRESSION, df, df, ["a", "b"], "y", key=["k"]) for n in ["LinearRegression", "DecisionTreeRegressor"]}
    board = V.rank_models(spark.createDataFrame([(n, r.metrics.first()["rmse"]) for n, r in res.items()], "model_name string, rmse double"), "regression")
    paths = M.save_top_models(res, board, str(tmp_path))
    assert M.model_file_name(1, "LinearRegression") == "model_1_linear_regression"
    back = M.load_model(paths["LinearRegression"])
    assert back.transform(df.select("a", "b")).count() == 40


def test_save_and_reload_own_models(spark, cls_data, tmp_path):
    """AdaBoost, the best model of a run, and kNN score alike after a reload; AdaBoost has an AUC."""
    train, test = cls_data
    found = {
        "AdaBoostClassifier": M.train_and_evaluate("AdaBoostClassifier", M.CLASSIFICATION, train, test, ["feature_1", "feature_2"], "y", key=["k"], params={"n_estimators": 7}),
        "KNeighborsClassifier": M.train_and_evaluate("KNeighborsClassifier", M.CLASSIFICATION, train, test, ["feature_1", "feature_2"], "y", key=["k"], params={"n_neighbors": 3}),
    }
    assert len(found["AdaBoostClassifier"].model.rules) <= 7 and found["AdaBoostClassifier"].metrics.first()["roc_auc"] > 0.7
    board = spark.createDataFrame([(1, "AdaBoostClassifier"), (2, "KNeighborsClassifier")], "rank int, model_name string")
    paths = M.save_top_models(found, board, str(tmp_path))
    for name, path in [*paths.items(), ("AdaBoostClassifier", f"{tmp_path}/best_model")]:
        again = M.load_model(path).predict(test, keep=["k"])
        own = found[name].model.predict(test, keep=["k"])
        key = lambda d: sorted((r["k"], r["prediction"], round(r["score"], 9)) for r in d.collect())
        assert key(again) == key(own)
    with pytest.raises(ValueError, match="no parameter"):
        M.train_and_evaluate("AdaBoostClassifier", M.CLASSIFICATION, train, test, ["feature_1"], "y", key=["k"], params={"rate": 7})


def test_adaboost_rules_are_the_trees(spark, cls_data):
    """The projection votes as the fitted Spark trees do, also on null and NaN."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from tabloom.operators.boosting import AdaBoostModel, tree_rule

    train, test = cls_data
    odd = test.sparkSession.createDataFrame([(900, None, 1.0, 0), (901, float("nan"), -1.0, 1)], test.schema)
    rows = test.unionByName(odd)
    va = VectorAssembler(inputCols=["feature_1", "feature_2"], outputCol="features", handleInvalid="keep")
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=3).fit(va.transform(train))
    model = AdaBoostModel("regression", ["feature_1", "feature_2"], [tree_rule(tree._java_obj.rootNode())], [1.0])
    want = {r["k"]: r["prediction"] for r in tree.transform(va.transform(rows)).collect()}
    assert {r["k"]: r["prediction"] for r in model.predict(rows, keep=["k"]).collect()} == want


def test_silhouette_by_references(spark):
    """With few reference rows the score stays within the bound that it states."""
    from tabloom.operators import cluster_quality as Q

    import random

    rnd = random.Random(4)
    rows = [(i % 3, rnd.gauss(2.5 * (i % 3), 1.0), rnd.gauss(0, 1.0)) for i in range(900)]
    df = spark.createDataFrame(rows, "c int, f0 double, f1 double")
    sizes = {0: 300, 1: 300, 2: 300}
    exact, n, error = Q.silhouette(df, ["f0", "f1"], sizes)
    assert n == 900 and error == 0
    rough, n, error = Q.silhouette(df, ["f0", "f1"], sizes, reference_bytes=16 * 3 * 100)
    assert n == 300 and 0 < error < 0.5 and abs(rough - exact) <= error
