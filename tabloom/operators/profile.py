"""Column profile of a table.

``profile_columns`` gives one row per column with missing counts,
cardinality, numeric moments, exact median and the heuristic flags
(suspected identifier, constant, all-null, high cardinality, target
candidate).  It is assembled from the shared passes in ``scan`` and joined
on the column name; every joined side has one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.kinds import BOOLEAN, CATEGORICAL, NUMERIC, columns_of, normalize_missing, q
from .scan import materialize_small, one_row, persisted, column_moments, column_quantiles, distinct_counts, quantile_wide, top_k, value_counts

_FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def _per_column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    df = normalize_missing(df)
    moments = column_moments(df)
    dist = distinct_counts(value_counts(df, digest=True))
    if approx:
        dist = approx_distinct(df)
    nums = columns_of(df, NUMERIC)
    med = quantile_wide(column_quantiles(df, nums, [0.5], approx=approx), [0.5], ["median"])
    return moments.join(F.broadcast(dist), "column", "left").join(F.broadcast(med), "column", "left")


def approx_distinct(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """HyperLogLog++ distinct counts (explicit approximate mode)."""
    aggs = [F.approx_count_distinct(F.col(q(c)), rsd).alias(f"d{i}") for i, c in enumerate(df.columns)]
    aggs += [F.count_if(F.col(q(c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"d{i}").alias("distinct"),
            (F.col(f"d{i}") + F.when(F.col(f"n{i}") > 0, 1).otherwise(0)).alias("distinct_with_null"),
            F.col(f"n{i}").alias("nulls"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def profile_columns(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row per column of ``df`` with statistics and flags."""
    with persisted(normalize_missing(df)) as d:
        s = materialize_small(_per_column_stats(d, approx))
    rows = F.col("n_rows")
    distinct = F.coalesce(F.col("distinct"), F.lit(0)).cast("long")
    name_is_id = F.col("column").rlike("(?i)" + P.ID_NAME_PATTERN)
    name_is_target = F.col("column").rlike("(?i)" + P.TARGET_NAME_PATTERN)
    numeric = F.col("kind") == NUMERIC
    is_id = (rows > 0) & (
        ((distinct == rows) & (name_is_id | ~numeric)) | ((distinct / rows > P.ID_NEAR_UNIQUE_RATIO) & name_is_id)
    )
    out = (
        s.withColumn("missing_pct", F.when(rows > 0, F.col("missing") / rows * 100.0).otherwise(0.0))
        .withColumn("unique_count", distinct)
        .withColumn("cardinality_pct", F.when(rows > 0, distinct / rows * 100.0).otherwise(0.0))
        .withColumn("is_suspected_id", F.coalesce(is_id, F.lit(False)))
        .withColumn("is_constant", distinct == 1)
        .withColumn("is_all_null", F.col("missing") == rows)
        .withColumn(
            "is_high_cardinality",
            (F.col("kind") == CATEGORICAL) & (distinct > P.PROFILE_HIGH_CARDINALITY) & ~F.col("is_suspected_id"),
        )
    )
    eligible = ~F.col("is_suspected_id") & ~F.col("is_constant") & ~F.col("is_all_null")
    whole = Window.partitionBy(F.lit(0))  # the table has one row per column
    out = (
        out.withColumn("_by_name", name_is_target & eligible)
        .withColumn("_any_by_name", F.max(F.col("_by_name").cast("int")).over(whole) == 1)
        .withColumn("_last_eligible", F.max(F.when(eligible, F.col("ordinal"))).over(whole))
        .withColumn(
            "is_target_candidate",
            F.col("_by_name") | (~F.col("_any_by_name") & (F.col("ordinal") == F.col("_last_eligible"))),
        )
        .withColumn("is_target_candidate", F.coalesce(F.col("is_target_candidate"), F.lit(False)))
    )
    # numeric statistics are only reported for columns with a non-null value
    has_values = numeric & (F.col("n") > 0)
    stat = lambda c: F.when(has_values, F.col(c))
    return out.select(
        "column", "ordinal", "dtype", "kind",
        numeric.alias("is_numeric"),
        (F.col("kind") == CATEGORICAL).alias("is_categorical"),
        (F.col("kind") == "datetime").alias("is_datetime"),
        (F.col("kind") == BOOLEAN).alias("is_boolean"),
        "n_rows", F.col("missing").alias("missing_count"), "missing_pct", "unique_count", "cardinality_pct",
        stat("min").alias("min"), stat("max").alias("max"), stat("mean").alias("mean"), stat("median").alias("median"),
        stat("std").alias("std"), stat("skew").alias("skew"), stat("kurtosis").alias("kurtosis"),
        stat("zeros").alias("zeros_count"), stat("negatives").alias("negative_count"),
        "is_suspected_id", "is_constant", "is_all_null", "is_high_cardinality", "is_target_candidate",
    )


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """Top-k values (count desc, value asc) of categorical and boolean columns."""
    cols = columns_of(df, CATEGORICAL, BOOLEAN)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count long")
    return top_k(value_counts(normalize_missing(df), cols), k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, duplicate_rows`` (rows minus distinct rows; null equals null)."""
    keys = [
        F.to_json(F.col(q(f.name))).alias(f.name) if isinstance(f.dataType, (T.MapType,)) else F.col(q(f.name))
        for f in df.schema.fields
    ]
    g = normalize_missing(df).select(*keys).groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return g.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: shape, memory estimate, missing cells and duplicate rows."""
    d = normalize_missing(df)
    n_cols = len(df.columns)
    width = sum(next((w for t, w in _FIXED_WIDTH.items() if isinstance(f.dataType, t)), 0) for f in df.schema.fields)
    var_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    var_bytes = sum((F.coalesce(F.octet_length(F.col(q(c))), F.lit(0)) for c in var_cols), F.lit(0))
    missing = sum((F.col(q(c)).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    base = d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("total_missing_cells"),
        F.coalesce(F.sum(var_bytes), F.lit(0)).cast("long").alias("_var_bytes"),
    )
    dup = duplicate_rows(df).select("duplicate_rows")
    cells = F.col("n_rows") * n_cols
    return one_row(base, dup).select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_cols"),
        ((F.col("n_rows") * width + F.col("_var_bytes")) / (1024 * 1024)).alias("memory_mb"),
        "total_missing_cells",
        F.when(cells > 0, F.col("total_missing_cells") / cells * 100.0).otherwise(0.0).alias("total_missing_pct"),
        "duplicate_rows",
        F.when(F.col("n_rows") > 0, F.col("duplicate_rows") / F.col("n_rows") * 100.0).otherwise(0.0).alias("duplicate_pct"),
    )


def target_candidates(columns: DataFrame) -> DataFrame:
    """Names flagged as target candidates by ``profile_columns``."""
    return columns.where("is_target_candidate").select("column", "ordinal")


def describe(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max of every numeric column."""
    d = normalize_missing(df)
    nums = columns_of(d, NUMERIC)
    m = column_moments(d, nums).select("column", "ordinal", F.col("n").alias("count"), "mean", "std", "min", "max")
    qs = quantile_wide(column_quantiles(d, nums, [0.25, 0.5, 0.75], approx=approx), [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return m.join(F.broadcast(qs), "column", "left").select("column", "ordinal", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def missing_audit(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value: count and percent."""
    m = column_moments(normalize_missing(df)).where(F.col("missing") > 0)
    return m.select(
        "column", "ordinal", F.col("missing").alias("missing_count"),
        F.when(F.col("n_rows") > 0, F.col("missing") / F.col("n_rows") * 100.0).alias("missing_pct"),
    )


def target_distribution(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Top-k values of the target, nulls included as a value."""
    vc = value_counts(normalize_missing(df), [target])
    return top_k(vc, k, with_nulls=True).select("rank", "value", "count")


def profile_text(summary: DataFrame, columns: DataFrame) -> DataFrame:
    """Summary sentence of a profile (P20): shape, missing, duplicates, class counts, flags."""
    c = columns.agg(
        F.count_if("is_numeric").alias("n_num"), F.count_if("is_categorical").alias("n_cat"),
        F.count_if("is_datetime").alias("n_dt"), F.count_if("is_boolean").alias("n_bool"),
        F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("is_suspected_id"), F.col("column"))))).alias("ids"),
        F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("is_target_candidate"), F.col("column"))))).alias("targets"),
    )  # one row per column in, one row out
    row = one_row(summary, c)
    return row.select(F.format_string(
        "Dataset: %d rows x %d columns (%.4f MB). Missing cells: %d (%.2f%%). Duplicate rows: %d (%.2f%%). "
        "Numeric: %d, categorical: %d, datetime: %d, boolean: %d. Suspected IDs: [%s]. Target candidates: [%s].",
        "n_rows", "n_cols", "memory_mb", "total_missing_cells", "total_missing_pct", "duplicate_rows", "duplicate_pct",
        "n_num", "n_cat", "n_dt", "n_bool", "ids", "targets").alias("summary"))
