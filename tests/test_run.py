"""End-to-end run (X1) on the reference's integration fixture (FIXTURES.md §9)."""

import glob
import os

from tabloom.plans.run import autorun
from tabloom.sources.ledger import Ledger


def test_autorun_classification_writes(spark, tmp_path):
    rows = []
    for i in list(range(120)) + [0]:  # row 0 repeated
        rows.append((f"CUST_{i:04d}", 20 + i % 45, None if i == 5 else 100 + 12.5 * i,
                     "?" if i == 10 else ("Month-to-Month" if i % 2 == 0 else "Two-Year"), i % 5,
                     1 if (i % 3 == 0 or i % 7 == 0) else 0))
    df = spark.createDataFrame(rows, "customer_id string, age bigint, monthly_spend double, contract_type string, support_calls bigint, churn int")
    res = autorun(spark, df, target="churn", task="classification", models=["LogisticRegression", "GaussianNB", "DecisionTreeClassifier"],
                  out_root=str(tmp_path), run_id="run1")
    assert [c for c, _ in res.clean_model.drop_columns] == ["customer_id"]
    assert res.clean_model.log_counts["duplicates"] == 1
    assert res.clean_model.impute["monthly_spend"][1] == 850.0
    assert res.clean_model.impute["contract_type"][1] == "Two-Year"
    board = res.leaderboard.orderBy("rank").collect()
    assert len(board) == 3 and board[0]["rank"] == 1
    assert {"accuracy", "f1"} <= set(res.evaluation.columns)
    wanted = {
        "profile": ["profile"], "quality": ["issues", "score"], "eda": ["summary", "histogram", "correlations", "collinear", "target_correlations"],
        "clean": ["table", "log"], "splits": ["data", "X", "y"], "features": ["table", "plan"],
        "models": ["ml_ready", "encoder", "experiments", "best_model", "model_1_*"], "reports": ["leakage", "leakage_summary"],
        "evaluation": ["evaluation", "decision"],
    }
    for stage, names in wanted.items():
        for name in names:
            assert glob.glob(os.path.join(str(tmp_path), "run1", stage, name)), (stage, name)
    ledger = Ledger(spark, str(tmp_path), "run1")
    assert {"profile", "quality", "eda", "clean", "features", "models", "evaluation"} <= set(ledger.completed_phases())
    assert ledger.best_experiment().first()["model_name"] == board[0]["model_name"] and ledger.artifacts_by_type("model").count() >= 3
    y = spark.read.parquet(os.path.join(str(tmp_path), "run1", "splits", "y"))
    assert y.groupBy("split").count().count() == 3 and "churn" in y.columns


def test_autorun_regression_and_clustering(spark):
    rows = [(i, 800 + 25 * i, 2 + i % 4, "Urban" if i % 2 else "Suburban", 150000.0 + 3500 * i) for i in range(100)]
    df = spark.createDataFrame(rows, "house_id bigint, sqft bigint, bedrooms bigint, neighborhood string, price double")
    res = autorun(spark, df, target="price", task="regression", models=["LinearRegression", "DecisionTreeRegressor"])
    leak = {r["column"] for r in res.leakage.where("check = 'target_proxy'").collect()}
    assert {"house_id", "sqft"} <= leak
    assert res.evaluation.first()["r2"] > 0.9
    cl = autorun(spark, df.drop("price"), target=None, task="clustering", models=["KMeans"])
    assert cl.leaderboard.first()["n_clusters"] == 4


def test_time_column_and_repeatable_split(spark):
    from pyspark.sql import functions as F

    from tabloom.operators.clean import fit_clean, parse_time
    from tabloom.operators.split import random_split, temporal_split
    from tabloom.sources.hashing import row_text

    rows = [(f"{1 + i % 12:02d}/{1 + i % 28:02d}/{2001 + i // 12}", float(i), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "day string, x double, y int")
    assert df.where(parse_time(F.col("day"), df.schema["day"].dataType).isNull()).count() == 0
    parts = temporal_split(df, "y", "day")
    ends = {r["split"]: (r["lo"], r["hi"]) for r in parts.groupBy("split").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    assert ends["train"][1] < ends["test"][0] + 12  # days within a year are not in the order of x
    res = autorun(spark, df, target="x", task="regression", time_column="day", models=["LinearRegression"])
    assert res.evaluation.count() == 1
    members = []
    for n in (2, 7):
        cleaned = fit_clean(df, "x").transform(df.repartition(n))
        keyed = cleaned.withColumn("_row_id", F.xxhash64(row_text(cleaned, cleaned.columns)))
        split = random_split(keyed, "x", keys=["_row_id"], stratify=False)
        members.append({r[0] for r in split.where("split = 'test'").select("_row_id").collect()})
    assert members[0] == members[1]
