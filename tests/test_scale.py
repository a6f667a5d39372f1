"""Bounded memory and spread work: neighbours by cells and blocks, silhouette of equal rows, tables of one row group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import session
from tabloom.operators import cluster_quality as Q
from tabloom.operators import knn as K
from tabloom.operators import models as M
from tabloom.sources.readers import balanced


def test_neighbours_by_cells(spark, monkeypatch):
    """Many cells, blocks of a few rows and few distances at once give the neighbours of brute force."""
    for name, value in (("CELL_ROWS", 4), ("SAMPLE_ROWS", 150), ("TEST_BLOCK_BYTES", 100), ("DISTANCES", 40)):
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(3)
    # dense places, scattered rows, and a third of all rows at one place
    a = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(50, 0.01, (50, 2)), rng.uniform(-90, 90, (50, 2)), np.full((120, 2), 7.0)])
    b = np.concatenate([rng.normal(0, 2, (40, 2)), rng.uniform(-200, 200, (40, 2)), np.full((30, 2), 7.0), np.full((1, 2), 6.5)])
    train = spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(a)], "k long, f double, g double").repartition(3)
    test = spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(b)], "_rid long, f double, g double")
    got = {}
    for r in K.nearest_rows(train, test, ["f", "g"], key=["k"], carry=["k"], k=5).collect():
        got.setdefault(r["_rid"], []).append((r["d"], r["t"], r["k"]))
    for i, p in enumerate(b):
        d = np.sqrt(((a - p) ** 2).sum(1))
        near = sorted(range(len(a)), key=lambda j: (d[j], str(j)))[:5]
        assert [k for _, _, k in sorted(got[i])] == near
    assert K.nearest_rows(train.where("false"), test, ["f", "g"], key=["k"], carry=["k"], k=5).collect() == []


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_sampled_neighbours_in_blocks(spark, monkeypatch, task):
    rnd = random.Random(5)
    train = spark.createDataFrame([(i, rnd.random(), rnd.random(), float(rnd.randint(0, 2))) for i in range(60)], "k long, f double, g double, y double")
    test = spark.createDataFrame([(i, rnd.random(), rnd.random()) for i in range(50)], "k long, f double, g double").coalesce(1)
    found = lambda: sorted(K.knn_predict(train, test, ["f", "g"], "y", key=["k"], task=task, keep=["k"]).collect())
    whole = found()
    monkeypatch.setattr(K, "DISTANCES", 7 * 60)
    assert len(whole) == 50 and [r["k"] for r in found()] == [r["k"] for r in whole]
    assert [r["prediction"] for r in found()] == pytest.approx([r["prediction"] for r in whole]) if task == "regression" else found() == whole


def test_neighbours_beyond_the_sample(spark):
    """The only near rows are found among more than 10 000; equal distances go by the keys' values, not by their texts."""
    train = spark.range(12000).selectExpr("id AS k", "CASE WHEN id % 3000 = 7 THEN 0.5D ELSE 100.0D + id END AS f", "CASE WHEN id % 3000 = 7 THEN 'near' ELSE 'far' END AS y")
    test = spark.createDataFrame([(1, 0.0, "near")], "k long, f double, y string")
    out = K.knn_predict(train, test, ["f"], "y", key=["k"], k=4, keep=["k"]).first()
    assert (out["prediction"], out["score"]) == ("near", 1.0)
    res = M.train_and_evaluate("KNeighborsClassifier", M.CLASSIFICATION, train, test, ["f"], "y", key=["k"], params={"n_neighbors": 4})
    assert res.predictions.first()["p"] == "near" and res.model.rows.count() == 12000
    assert K.knn_predict(train, test, ["f"], "y", key=["k"], k=4, keep=["k"], max_rows=5).count() == 1
    same = spark.createDataFrame([(-3, 1.0, "a"), (9, 1.0, "b"), (10, 1.0, "c")], "k long, f double, y string")
    assert K.knn_predict(same, test, ["f"], "y", key=["k"], k=1, keep=["k"]).first()["prediction"] == "a"
    assert K.knn_predict(same.where("k > 0"), test, ["f"], "y", key=["k"], k=1, keep=["k"]).first()["prediction"] == "b"


def test_silhouette_of_equal_rows(spark):
    """Equal rows are one reference: 40 of each row fit where the rows one by one don't, and the score stays exact."""
    rnd = random.Random(6)
    few = [(i % 2, float(rnd.randint(0, 9) + 4 * (i % 2)), float(rnd.randint(0, 9))) for i in range(30)]
    df = spark.createDataFrame(few * 40, "c int, f0 double, f1 double")
    exact, n, error = Q.silhouette(df, ["f0", "f1"], {0: 600, 1: 600})
    small, m, bound = Q.silhouette(df, ["f0", "f1"], {0: 600, 1: 600}, reference_bytes=16 * 2 * 30)
    assert (n, error) == (1200, 0) == (m, bound) and small == pytest.approx(exact)
    x, c = np.array([r[1:] for r in few * 40]), np.array([r[0] for r in few * 40])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    mean = np.stack([d[:, c == k].sum(1) / np.where(c == k, 599, 600) for k in (0, 1)], 1)
    a, b = mean[np.arange(1200), c], mean[np.arange(1200), 1 - c]
    assert exact == pytest.approx(((b - a) / np.maximum(a, b)).mean())


def of_all_pairs(x, c, w) -> float:
    """Mean silhouette of points with weights."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    size = np.array([w[c == k].sum() for k in range(c.max() + 1)])
    total = np.stack([d[:, c == k] @ w[c == k] for k in range(len(size))], 1)
    a = total[np.arange(len(x)), c] / np.maximum(size[c] - 1, 1)
    mean = total / size
    mean[np.arange(len(x)), c] = np.inf
    b = mean.min(axis=1)
    return float((np.where(size[c] == 1, 0.0, (b - a) / np.maximum(a, b)) * w).sum() / w.sum())


@pytest.mark.parametrize("dims", [1, 2, 3, 6])
def test_silhouette_by_boxes(spark, monkeypatch, dims):
    """Many blocks, boxes and passes over clusters give the score of all pairs."""
    rng = np.random.default_rng(dims)
    n = 3000
    x = np.concatenate([rng.normal(0, 1, (n // 2, dims)) ** 3, rng.uniform(-4, 4, (n // 3, dims)), np.round(rng.uniform(-9, 9, (n // 6, dims)))])
    x[:, -1] = np.where(rng.random(n) < 0.5, np.round(x[:, -1]), x[:, -1])
    c = np.where(x[:, 0] > 0.3, 0, 1) + 2 * rng.integers(0, 2, n)
    x[-1], c[-1] = 40.0, 4  # alone in its cluster
    w = rng.integers(1, 3, n)
    df = spark.createDataFrame([(int(k), *p.tolist()) for p, k, m in zip(x, c, w, strict=True) for _ in range(m)], "c int, " + ", ".join(f"f{j} double" for j in range(dims)))
    for name, value in (("BLOCK_ROWS", 200), ("LEAF", 16), ("CLUSTERS", 2), ("NEAR_BYTES", 20000)):
        monkeypatch.setattr(Q, name, value)
    got, refs, error = Q.silhouette(df, [f"f{j}" for j in range(dims)], {k: int(w[c == k].sum()) for k in range(5)})
    assert (refs, error) == (w.sum(), 0) and got == pytest.approx(of_all_pairs(x, c, w), abs=1e-6)


def test_silhouette_beyond_the_references(spark, monkeypatch):
    """However many rows there are, all of them are references."""
    monkeypatch.setattr(Q, "REFERENCE_BYTES", 1600, raising=False)
    rng = np.random.default_rng(2)
    x, c = rng.normal(0, 1, (2000, 2)), rng.integers(0, 2, 2000)
    df = spark.createDataFrame([(int(k), *p.tolist()) for p, k in zip(x, c, strict=True)], "k int, x double, y double")
    got = Q.clustering_scores(df, ["x", "y"], "k").first()
    assert (got["silhouette_references"], got["silhouette_error"]) == (2000, 0)
    assert got["silhouette"] == round(of_all_pairs(x, c, np.ones(2000)), 4)


def largest(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_one_row_group_in_several_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 1000)
    spark.range(20000).withColumn("v", F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "t"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, "20000")
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() > 1 and largest(df) == 20000
        out = balanced(df)
        assert largest(out) <= 20000 / spark.sparkContext.defaultParallelism + 1000 and out.exceptAll(df).count() == 0 == df.exceptAll(out).count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_training_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 200)
    seen, own = [], M._spark_ml
    monkeypatch.setattr(M, "_spark_ml", lambda name, task, train, *a: seen.append(largest(train)) or own(name, task, train, *a))
    df = spark.range(2000).select(F.col("id").alias("k"), F.rand(1).alias("f"), (F.col("id") % 7).cast("double").alias("y")).coalesce(1)
    M.train_and_evaluate("LinearRegression", M.REGRESSION, df, df, ["f"], "y", key=["k"])
    assert seen[0] <= 400
