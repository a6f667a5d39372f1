"""Dataset manifest (S10) and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..operators.profile import profile_summary
from ..session import stored
from .hashing import file_hashes
from .readers import extension


#: Files whose hashes are hashed together.
RUN = 4096


def manifest(spark: SparkSession, path: str, df: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """One row: path, content hash, bytes, format, rows, columns, names,
    types, memory estimate, missing cells, duplicates.

    The content hash says nothing of names: a single file's is the file's
    own hash; of several files it is the sha256 of their hashes in path
    order, runs of 4096 being hashed first.
    """
    files = stored(file_hashes(spark, path, algorithm))
    agg = files.agg(F.sum("length").alias("file_bytes"), F.count(F.lit(1)).alias("n_files"), F.max("hash").alias("only")).first()
    content = agg["only"]
    if agg["n_files"] != 1:
        rows = numbered(files.select("path", "hash"), [F.col("path")], "i")
        joined = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "hash"))), lambda x: x["hash"]), ""), 256)
        runs = rows.groupBy((F.col("i") / RUN).cast("long").alias("run")).agg(joined("i").alias("hash"))
        content = runs.agg(joined("run").alias("hash")).first()["hash"]
    summ = profile_summary(df).first()
    return spark.createDataFrame(
        [(
            path, content, int(agg["file_bytes"] or 0), int(agg["n_files"]), extension(path).lstrip(".") or "parquet",
            summ["n_rows"], summ["n_cols"], list(df.columns), [t for _, t in df.dtypes], float(summ["memory_mb"]),
            summ["total_missing_cells"], summ["duplicate_rows"],
        )],
        "path string, content_hash string, file_bytes long, n_files long, format string, n_rows long, n_cols long, "
        "column_names array<string>, dtypes array<string>, memory_mb double, missing_cells long, duplicate_rows long",
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows."""
    return df.limit(n)
