"""Cleaning, splitting and leakage fixtures (FIXTURES.md §5, §6)."""

import pytest
from pyspark.sql import functions as F

from tabloom.errors import DataLoadError
from tabloom.operators import clean as C
from tabloom.operators import leakage as G
from tabloom.operators import split as S


def test_clean_fixture(spark):
    f1 = [1.0, 2.0, None, 4.0] + [3.0] * 96
    f2 = ["A", "B", "?", "A"] + ["B"] * 96
    tg = [0, 1, 0, 1] + [0] * 96
    df = spark.createDataFrame([(i, f1[i], f2[i], "Fixed", tg[i]) for i in range(100)],
                               "id bigint, feature_1 double, feature_2 string, constant_col string, target int")
    out, m = C.clean(df, "target")
    assert [c for c, _ in m.drop_columns] == ["constant_col"]
    assert m.impute["feature_1"][:2] == ["median", 3.0] and m.impute["feature_2"][:2] == ["mode", "B"]
    assert m.winsor == {}
    assert out.count() == 100 and len(out.columns) == 4
    assert out.where(F.col("feature_1").isNull() | F.col("feature_2").isNull() | (F.col("feature_2") == "?")).count() == 0


def test_clean_dates_and_log(spark):
    rows = [(i, f"2024-01-{(i % 28) + 1:02d}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, order_date string, y double")
    out, m = C.clean(df, "y")
    assert "order_date" not in out.columns and "order_date_dayofweek" in out.columns
    first = out.orderBy("id").first()
    assert (first["order_date_year"], first["order_date_month"], first["order_date_day"], first["order_date_dayofweek"]) == (2024, 1, 1, 0)
    assert m.log(spark).where("step = 'dropped_column'").count() == 1


def test_split_sizes_stratified(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 7), 0 if i < 70 else 1) for i in range(100)], "k bigint, f1 double, f2 double, target int")
    s = S.random_split(df, "target", keys=["k"], test_size=0.2, val_size=0.1)
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 10, "test": 20}
    by = {(r["split"], r["target"]): r["count"] for r in s.groupBy("split", "target").count().collect()}
    assert by[("test", 1)] == 6 and by[("test", 0)] == 14
    again = S.random_split(df, "target", keys=["k"], test_size=0.2, val_size=0.1)
    assert again.where("split = 'test'").select("k").exceptAll(s.where("split = 'test'").select("k")).count() == 0


def test_split_temporal_and_errors(spark):
    df = spark.createDataFrame([(i, i // 10, float(i)) for i in range(50)], "k bigint, t bigint, y double")
    s = S.temporal_split(df, "y", "t", test_size=0.2, val_size=0.1)
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 35, "val": 5, "test": 10}
    assert s.where("split = 'train'").agg(F.max("t")).first()[0] <= s.where("split = 'test'").agg(F.min("t")).first()[0]
    with pytest.raises(DataLoadError):
        S.random_split(df.limit(4), "y")
    with pytest.raises(DataLoadError):
        S.random_split(df, "absent")


def test_split_ties_exact(spark):
    # one timestamp holds most rows, and identical rows exist: sizes stay exact
    rows = [(i % 3, 0 if i < 80 else i, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, y double")
    s = S.temporal_split(df, "y", "t", test_size=0.25, val_size=0.1, tiebreak=["k"])
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 65, "val": 10, "test": 25}


def test_leakage(spark):
    y = list(range(1, 11))
    tr = spark.createDataFrame([(float(v), float(2 * v + 5), float(v % 3), float(v)) for v in y], "target double, proxy double, noise double, y double")
    found = G.audit_leakage(tr.drop("y"), tr.drop("y"), tr.drop("target").withColumnRenamed("y", "target"), "target")
    checks = {(r["check"], r["column"]) for r in found.collect()}
    assert ("target_in_features", "target") in checks
    assert ("target_proxy", "proxy") in checks
    assert ("row_overlap", None) in checks


def test_split_ties_by_key_and_by_row(spark, monkeypatch):
    """A cut through rows of one time, of one key, and of equal rows: sizes stay exact, the order is that of a full sort."""
    from tabloom.operators import orderstats as O

    rows = [(i % 7, 0 if i < 300 else i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, y double")
    for keys in (["k", "y"], ["k"]):
        got = {(r["k"], r["t"], r["y"]): r["split"] for r in S.temporal_split(df, "y", "t", tiebreak=keys).collect()}
        text = "|".join("{" + c + "}" for c in keys)
        import hashlib

        def order(r, text=text):
            own = {"k": r[0], "t": r[1], "y": r[2]}
            rest = [str(own[c]) for c in [*keys, *(c for c in ("k", "y") if c not in keys)]]  # noqa: B023
            return r[1], int(hashlib.md5(text.format(**own).encode()).hexdigest()[:13], 16), rest

        want = sorted(rows, key=order)
        assert [got[r] for r in want] == ["train"] * 260 + ["val"] * 60 + ["test"] * 80
    same = spark.createDataFrame([(1, 1, 1.0)] * 200 + [(2, 2, 2.0)] * 50, "k bigint, t bigint, y double")
    sizes = {(r["split"], r["k"]): r["count"] for r in S.temporal_split(same, "y", "t").groupBy("split", "k").count().collect()}
    assert sizes == {("train", 1): 163, ("val", 1): 37, ("test", 2): 50}
    nulls = spark.createDataFrame([(i, None if i % 3 else i, 1.0) for i in range(90)], "k bigint, t bigint, y double")
    late = S.temporal_split(nulls, "y", "t", tiebreak=["k"]).where("split = 'test'")
    assert late.count() == 18 and late.where("t IS NOT NULL").count() == 0


def test_split_of_a_hot_time_needs_no_window(spark):
    df = spark.range(3000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS t", "1.0D AS y")
    s = S.temporal_split(df, "y", "t", tiebreak=["k"])
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and s.groupBy("split").count().count() == 3
