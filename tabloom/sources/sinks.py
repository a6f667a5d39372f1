"""Writers (S12–S17, S19): tables, split tables, reports and the run layout.

A run writes under ``<root>/<run_id>/<stage>``; an existing run id is an
error (``mode("errorifexists")``).  ``root`` must be a shared location
(HDFS, object store) on a cluster.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError

STAGES = ("raw", "profile", "quality", "eda", "clean", "splits", "features", "models", "evaluation", "reports")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def init_run(spark: SparkSession, root: str, run_id: str) -> dict[str, str]:
    """Create the run folder with its stage folders; an existing run id is an error."""
    fs, p = _fs(spark, f"{root}/{run_id}")
    if fs.exists(p):
        raise ArtifactError(f"Run '{run_id}' already exists under {root}")
    paths = {}
    for s in STAGES:
        sp = f"{root}/{run_id}/{s}"
        fs.mkdirs(_fs(spark, sp)[1])
        paths[s] = sp
    return paths


def copy_raw(spark: SparkSession, src: str, dest_folder: str) -> str:
    """Keep an immutable copy of the raw input next to the run."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sfs, sp = _fs(spark, src)
    dfs, dp = _fs(spark, dest_folder)
    target = jvm.org.apache.hadoop.fs.Path(dp, sp.getName())
    if dfs.exists(target):
        raise ArtifactError(f"Raw copy already exists: {target.toString()}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(sfs, sp, dfs, target, False, conf)
    return target.toString()


def write_table(df: DataFrame, path: str, *, formats=("parquet", "csv"), mode: str = "errorifexists") -> None:
    """Cleaned / feature / encoded tables as Parquet and CSV with a header."""
    for f in formats:
        w = df.write.mode(mode)
        if f == "csv":
            w.option("header", True).csv(f"{path}/csv")
        else:
            w.parquet(f"{path}/{f}")


def write_splits(split_df: DataFrame, target: str | None, path: str, *, mode: str = "errorifexists") -> None:
    """Tables partitioned by split (S13): ``data``, and with a target ``X`` (without it) and ``y`` (only it),
    both with the row key ``_row_id`` where there is one.  An empty split writes nothing."""
    key = [c for c in ("_row_id",) if c in split_df.columns]
    split_df.drop(*key).write.mode(mode).partitionBy("split").parquet(f"{path}/data")
    if target:
        split_df.drop(target).write.mode(mode).partitionBy("split").parquet(f"{path}/X")
        split_df.select(*key, target, "split").write.mode(mode).partitionBy("split").parquet(f"{path}/y")


def union_splits(*parts: DataFrame) -> DataFrame:
    """train ∪ test (and others) by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_report(spark: SparkSession, name: str, report: dict | DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A report table as JSON lines (S16); dicts become one JSON document."""
    if isinstance(report, DataFrame):
        report.write.mode(mode).json(f"{path}/{name}")
    else:
        spark.createDataFrame([(json.dumps(report, default=str),)], "report string").write.mode(mode).json(f"{path}/{name}")


def write_experiments(results: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Experiment results table as CSV."""
    results.select(*[F.col(c).cast("string") if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in results.dtypes]) \
        .write.mode(mode).option("header", True).csv(path)
