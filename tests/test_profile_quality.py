"""Profile and quality audit on the reference's planted-fault fixtures (FIXTURES.md §2, §3)."""

import math

import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile as P
from tabloom.operators import quality as Q


@pytest.fixture(scope="module")
def profile_df(spark):
    rows = []
    for i in range(100):
        rows.append((f"ID_{i}", None if i % 10 == 0 else float(20 + i % 50), 30000.0 + 500 * i, "A" if i % 2 == 0 else "B",
                     i % 3 == 0, 1, None, 1 if i % 4 == 0 else 0))
    schema = ("customer_id string, age double, income double, category string, is_active boolean, constant_col bigint, "
              "all_null double, churn int")
    return spark.createDataFrame(rows, schema)


def test_profile_columns(profile_df):
    cols = {r["column"]: r for r in P.profile_columns(profile_df).collect()}
    assert cols["customer_id"]["is_suspected_id"]
    assert cols["age"]["missing_count"] == 10
    assert cols["age"]["unique_count"] == 45
    assert cols["age"]["mean"] == pytest.approx(45.0)
    assert cols["age"]["median"] == pytest.approx(45.0)
    assert cols["age"]["std"] == pytest.approx(14.456443686, rel=1e-9)
    assert cols["income"]["min"] == 30000 and cols["income"]["max"] == 79500
    assert cols["income"]["skew"] == pytest.approx(0.0, abs=1e-9)
    assert cols["income"]["kurtosis"] == pytest.approx(-1.2, abs=1e-9)
    assert cols["category"]["is_categorical"] and cols["is_active"]["is_boolean"]
    assert cols["constant_col"]["is_constant"]
    assert cols["all_null"]["is_all_null"] and not cols["all_null"]["is_constant"]
    assert cols["churn"]["is_target_candidate"]


def test_profile_summary(profile_df):
    s = P.profile_summary(profile_df).first()
    assert (s["n_rows"], s["n_cols"], s["total_missing_cells"]) == (100, 8, 110)


def test_top_values(profile_df):
    tv = P.top_values(profile_df).where(F.col("column") == "is_active").collect()
    assert {(r["value"], r["count"]) for r in tv} == {("true", 34), ("false", 66)}


@pytest.fixture(scope="module")
def quality_df(spark):
    age = [25, 30, -5, 40] + [35] * 96
    income = [50000.0] * 90 + [10_000_000.0] * 10
    feedback = ["Great", "?", "N/A", "none"] + ["Good"] * 96
    almost = [1.0] * 5 + [None] * 95
    churn = [0] * 98 + [1] * 2
    rows = [(i, float(age[i]), income[i], feedback[i], 42, almost[i], churn[i]) for i in range(100)]
    return spark.createDataFrame(rows, "id bigint, age double, income double, feedback string, constant_feature int, almost_empty double, churn int")


def test_quality_planted(quality_df):
    rep = Q.audit(quality_df, "churn")
    issues = {(r["issue_type"], r["column"]): r for r in rep.issues.collect()}
    assert ("suspicious_negative_values", "age") in issues
    assert issues[("hidden_null_strings", "feedback")]["affected_count"] == 3
    assert ("constant_column", "constant_feature") in issues
    assert ("extreme_missing_values", "almost_empty") in issues
    assert ("constant_column", "almost_empty") in issues
    assert issues[("severe_class_imbalance", "churn")]["affected_pct"] == 2.0
    assert ("extreme_outliers", "age") in issues and ("extreme_outliers", "churn") in issues
    assert ("extreme_outliers", "income") not in issues
    score = rep.score.first()
    assert (score["n_critical"], score["n_high"], score["n_medium"], score["n_low"]) == (1, 4, 3, 0)
    assert score["overall_score"] == 20.0


def test_quality_absent_target_and_empty(spark, quality_df):
    rep = Q.audit(quality_df, "nope")
    assert rep.issues.where("issue_type = 'target_not_found'").count() == 1
    empty = spark.createDataFrame([], "a int")
    rep = Q.audit(empty)
    assert rep.score.first()["overall_score"] == 0.0


def test_quality_clean_frame(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.gauss(50, 5), "X" if i % 2 else "Y", i % 2) for i in range(100)]
    rep = Q.audit(spark.createDataFrame(rows, "a double, b string, target int"), "target")
    s = rep.score.first()
    assert s["overall_score"] >= 90 and not s["has_critical_issues"]


def test_skew_guard_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),)], "x double")
    c = P.profile_columns(df).first()
    assert c["missing_count"] == 1 and c["skew"] is None and c["std"] == 0.0
    assert not math.isnan(c["mean"])


def test_summary_text(spark):
    """The first ten issues as sentences (Q16)."""
    from tabloom.operators import quality as Q

    rows = [(-i if i < 6 else i, "?" if i < 9 else f"v{i % 4}", 1) for i in range(60)]
    report = Q.audit(spark.createDataFrame(rows, "age long, note string, fixed int"))
    lines = [r["line"] for r in Q.summary_text(report).collect()]
    issues = report.issues.orderBy("seq", "issue_type").limit(10).collect()
    assert 0 < len(lines) <= 10
    assert lines == [f"[{r['severity'].upper()}] {r['issue_type']}: {r['description']}" for r in issues]
    assert len(Q.summary_text(report, k=1).collect()) == 1
