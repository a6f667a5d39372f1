"""DBSCAN and components against brute force; nearest neighbours over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import components as C
from tabloom.operators import dbscan as D
from tabloom.operators import knn as K
from tabloom.operators import models as M


def scan(keys, x, eps, least):
    """Labels as a scan in key order gives them."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) <= eps
    core, label, k = near.sum(1) >= least, np.full(len(keys), -1), 0
    for i in order:
        if core[i] and label[i] < 0:
            open_, label[i] = [i], k
            while open_:
                for v in np.flatnonzero(near[open_.pop()]):
                    if label[v] < 0:
                        label[v] = k
                        if core[v]:
                            open_.append(v)
            k += 1
    return dict(zip(keys, label.tolist(), strict=True))


def blobs(rng):
    return np.concatenate([rng.normal(0, 0.3, (300, 2)), rng.normal(3, 0.5, (300, 2)), rng.uniform(-2, 6, (200, 2)), np.repeat([[1.0, 1.0]], 400, 0)])


@pytest.mark.parametrize("data, eps, least, bits", [
    (blobs, 0.25, 6, 4),  # a third of all rows are one point
    (lambda rng: np.concatenate([rng.normal(0, 1, (300, 8)), rng.normal(0, 0.05, (300, 8)) + 4]), 1.2, 5, 5),  # half of the rows in one dense cell
    (lambda rng: np.stack([np.arange(120) * 0.1, np.zeros(120)], 1), 0.1000001, 3, 3),  # one long chain
    (lambda rng: rng.uniform(0, 100, (50, 3)), 0.01, 2, 8),
])
def test_dbscan(spark, monkeypatch, data, eps, least, bits):
    monkeypatch.setattr(D, "LEAF_BITS", bits)
    x = data(np.random.default_rng(1))
    keys = list(range(len(x)))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in zip(keys, x, strict=True)], "k long, x array<double>").repartition(4)
    got = {r["k"]: r["cluster"] for r in D.dbscan(df, ["x"], key=["k"], eps=eps, min_samples=least).collect()}
    assert got == scan(keys, x, eps, least)


def test_dbscan_odd_rows(spark):
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, -0.0, 0.1), (3, None, 0.0), (4, float("nan"), 0.0), (5, 9.0, 9.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, cluster double, y double")  # a feature called like the output
    got = sorted((r["k"] or 0, r[1]) for r in D.dbscan(df, ["cluster", "y"], key=["k"], eps=0.5, min_samples=4).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, -1), (4, -1), (5, -1)]
    assert D.dbscan(df.where("false"), ["cluster", "y"], key=["k"]).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)] + [(7, 7), (5000, 5000)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            open_ = [v]
            while open_:
                u = open_.pop()
                if u not in want:
                    want[u] = v
                    open_ += near[u]
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_clustering_parameters(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.gauss(5 * (i % 3), 0.3), rng.gauss(-5 * (i % 3), 0.3)) for i in range(60)], "k bigint, f1 double, f2 double")
    train = lambda name, params: M.train_and_evaluate(name, M.CLUSTERING, df, df, ["f1", "f2"], None, key=["k"], params=params)
    assert train("KMeans", {"k": 2}).metrics.first()["n_clusters"] == 2
    assert train("GaussianMixture", {"n_components": 3}).metrics.first()["n_clusters"] <= 3
    found = train("DBSCAN", {"eps": 1.5, "min_samples": 4})
    assert found.metrics.first()["n_clusters"] == 3 and found.predictions.where("p >= 0").count() == 60
    with pytest.raises(ValueError, match="no parameter"):
        train("DBSCAN", {"k": 2})


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_neighbours_of_all_rows(spark, monkeypatch, task):
    monkeypatch.setattr(K, "TRAIN_BLOCK_BYTES", 4000)
    monkeypatch.setattr(K, "TEST_BLOCK_BYTES", 900)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 12, (600, 2)).astype(float), rng.integers(0, 12, (90, 2)) / 2.0  # many ties, some zero distances
    y = rng.integers(0, 3, 600)
    train = spark.createDataFrame([(i, *p.tolist(), str(v)) for i, (p, v) in enumerate(zip(a, y, strict=True))], "k long, f double, g double, y string")
    test = spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(b)] + [(900, None, 1.0)], "k long, f double, g double")
    got = {r["k"]: r["prediction"] for r in K.knn_join(train, test, ["f", "g"], "y", key=["k"], task=task, keep=["k"]).collect()}
    assert got.pop(900) is None and len(got) == 90
    for i, p in enumerate(b):
        d = np.sqrt(((a - p) ** 2).sum(1))
        near = sorted(range(600), key=lambda j: (d[j], str(j)))[:5]
        w = {j: float(d[j] == 0) if (d[near] == 0).any() else 1 / d[j] for j in near}
        if task == "regression":
            assert got[i] == pytest.approx(sum(w[j] * y[j] for j in near) / sum(w.values()))
        else:
            votes = {c: sum(w[j] for j in near if y[j] == c) for c in range(3)}
            assert votes[int(got[i])] == pytest.approx(max(votes.values()))


def test_dbscan_in_rounds(spark, monkeypatch):
    """Boxes don't part points of many dimensions: near leaves settle what the others would add."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (380, 10)), rng.normal(0, 1, (12, 10)) + 3, rng.normal(0, 4, (8, 10))])
    eps, least = 4.2, 12
    monkeypatch.setattr(D, "LEAF_BITS", 4)
    monkeypatch.setattr(D, "ROUND_PAIRS", 16, raising=False)
    compared, given = [], D._paired
    monkeypatch.setattr(D, "_paired", lambda pairs, members: (compared.append(pairs.count()), given(pairs, members))[1])
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "k long, x array<double>")
    got = {r["k"]: r["cluster"] for r in D.dbscan(df, ["x"], key=["k"], eps=eps, min_samples=least).collect()}
    want = scan(list(range(len(x))), x, eps, least)
    assert got == want and set(want.values()) == {-1, 0}
    assert sum(compared) < 500  # 25 leaves and more make 325 pairs, in each of two passes


def test_dbscan_of_labels_is_not_broadcast(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 0.1).alias("y"))
    plan = C.components(df.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan
    packed = D._order_key(spark.createDataFrame([(3, None), (None, 7), (-2, 1)], "a long, b int"), ["a", "b"])
    rows = spark.createDataFrame([(3, None), (None, 7), (-2, 1)], "a long, b int").select("a", "b", packed.alias("p"))
    assert rows.schema["p"].dataType.typeName() == "long"
    assert [tuple(r) for r in rows.orderBy("p").select("a", "b").collect()] == [(None, 7), (-2, 1), (3, None)]
