"""Command entry (X2): ``spark-submit -m tabloom.plans.cli --data PATH --target COL --task regression ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions import patterns as P
from ..session import ensure_checkpoint_dir
from ..sources.readers import read_table
from .run import autorun


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="tabloom", description="Profile, audit, clean, split, encode and rank models on one table.")
    ap.add_argument("--data", required=True, help="input file or folder (csv, tsv, txt, parquet)")
    ap.add_argument("--target", default=None, help="target column (default: last column)")
    ap.add_argument("--task", required=True, choices=["regression", "classification", "clustering", "descriptive"])
    ap.add_argument("--time-column", default=None)
    ap.add_argument("--models", default=None, help="comma-separated model names")
    ap.add_argument("--out", default=None, help="shared output root; a run folder is created under it")
    ap.add_argument("--run-id", default=None)
    ap.add_argument("--seed", type=int, default=P.RANDOM_SEED)
    ap.add_argument("--approx", action="store_true", help="approximate distinct counts and quantiles")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("tabloom").getOrCreate()
    ensure_checkpoint_dir(spark)
    df = read_table(spark, a.data)
    target = a.target or (df.columns[-1] if a.task != "clustering" else None)
    res = autorun(spark, df, target=target, task=a.task, time_column=a.time_column,
                  models=a.models.split(",") if a.models else None, seed=a.seed, out_root=a.out, run_id=a.run_id, approx=a.approx,
                  source_path=a.data)
    res.leaderboard.show(truncate=False)
    if res.evaluation is not None:
        res.evaluation.show(truncate=False)


if __name__ == "__main__":
    main()
