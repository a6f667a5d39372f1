"""Exact order statistics: refinement levels against numpy, hot values, infinities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.orderstats import quantiles_long


@pytest.mark.parametrize("exact_rows", [10**6, 50, 3])
def test_quantiles_match_numpy(spark, exact_rows):
    rng = np.random.default_rng(7)
    a = rng.pareto(1.5, 3000)  # heavy tail
    b = np.concatenate([np.full(1000, 5.0), rng.normal(0, 1, 2000)])  # a third of rows share one value
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in quantiles_long(df, probs, exact_rows=exact_rows).collect()}
    for g, arr in (("a", a), ("b", b)):
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(arr, p)), rel=1e-12, abs=1e-12)


def test_infinite_values(spark):
    vals = [float("-inf"), 1.0, 2.0, 3.0, float("inf")] * 20
    df = spark.createDataFrame([("x", v) for v in vals], "g string, v double")
    got = {r["p"]: r["value"] for r in quantiles_long(df, [0.5], exact_rows=5).collect()}
    assert got[0.5] == 2.0
