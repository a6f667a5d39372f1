"""Shared statistics passes over a table.

* ``column_moments``  – pass A: one wide aggregate for every column (missing
  counts, and for numeric columns count/min/max/mean/std/skew/kurtosis/
  zeros/negatives).  One row comes back from the executors; it is turned
  into one row per column by ``explode`` on the executor side.
* ``value_counts``    – pass B: the table unpivoted to (column, value) and
  counted; distinct counts, top-k values, modes and encoding dictionaries
  all derive from it.  Map-side combine makes a hot value cheap.
* ``column_quantiles`` – pass C: exact (``orderstats``) or approximate
  quantiles per column.

All results are DataFrames with one row per column (or per column value),
so the driver never holds data proportional to rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import CATEGORICAL, NUMERIC, as_text, column_kinds, q
from ..functions.patterns import PLACEHOLDER_NULLS
from ..functions.stats import sample_kurtosis, sample_skewness
from .orderstats import approx_quantiles_long, quantiles_long, typed_quantiles


def column_moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: ``column, ordinal, kind, dtype, n_rows, missing,
    placeholders, n, min, max, mean, std, skew, kurtosis, zeros, negatives``
    (numeric fields null for other kinds; ``placeholders`` counts non-null
    text values that trimmed and lower-cased are a placeholder null).

    The table is unpivoted to ``(column, value, flags)`` and aggregated per
    column, so the aggregate stays narrow (and code-generated) however wide
    the table is; map-side combine leaves one partial row per column per task.
    """
    kinds = column_kinds(df)
    fields = {f.name: f for f in df.schema.fields}
    cols = list(df.columns) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame(
            [],
            "column string, ordinal int, kind string, dtype string, n_rows long, missing long, placeholders long, n long, "
            "min double, max double, mean double, std double, skew double, kurtosis double, zeros long, negatives long",
        )
    null_d = F.lit(None).cast("double")
    items = []
    for i, c in enumerate(cols):
        x = F.col(q(c))
        ph = F.lit(False)
        if kinds[c] == CATEGORICAL:
            ph = F.coalesce(F.lower(F.trim(as_text(x, fields[c].dataType))).isin(*PLACEHOLDER_NULLS), F.lit(False))
        items.append(
            F.struct(
                F.lit(i).alias("i"),
                x.isNull().alias("isnull"),
                ph.alias("ph"),
                (x.cast("double") if kinds[c] == NUMERIC else null_d).alias("v"),
            )
        )
    long = df.select(F.explode(F.array(*items)).alias("s")).select("s.i", "s.isnull", "s.ph", "s.v")
    v = F.col("v")
    n = F.count(v)
    agg = long.groupBy("i").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("isnull")).alias("missing"),
        F.count_if(F.col("ph")).alias("placeholders"),
        n.alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias("std"),
        sample_skewness(v, n).alias("skew"),
        sample_kurtosis(v, n).alias("kurtosis"),
        F.count_if(v == 0).alias("zeros"),
        F.count_if(v < 0).alias("negatives"),
    )
    meta = spark.createDataFrame(
        [(i, c, kinds[c], fields[c].dataType.simpleString()) for i, c in enumerate(cols)],
        "i int, column string, kind string, dtype string",
    )
    numeric = F.col("kind") == NUMERIC
    keep = lambda c: F.when(numeric, F.col(c))
    out = F.broadcast(meta).join(agg, "i", "left")
    return out.select(
        "column",
        F.col("i").alias("ordinal"),
        "kind",
        "dtype",
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.col("missing"), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.col("placeholders"), F.lit(0)).cast("long").alias("placeholders"),
        keep("n").alias("n"),
        keep("min").alias("min"),
        keep("max").alias("max"),
        keep("mean").alias("mean"),
        keep("std").alias("std"),
        keep("skew").alias("skew"),
        keep("kurtosis").alias("kurtosis"),
        keep("zeros").alias("zeros"),
        keep("negatives").alias("negatives"),
    )


def unpivot_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) with every value rendered as text; nulls kept."""
    fields = {f.name: f for f in df.schema.fields}
    arr = F.array(*[F.struct(F.lit(c).alias("column"), as_text(F.col(q(c)), fields[c].dataType).alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("s")).select("s.column", "s.value")


def unpivot_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) with a 128-bit digest of every typed value; null for nulls."""
    def digest(c: str):
        x = F.col(q(c))
        if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)):  # have no hash
            x = F.to_json(x)
        return F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))

    arr = F.array(*[F.struct(F.lit(c).alias("column"), digest(c).alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("s")).select("s.column", "s.value")


def value_counts(df: DataFrame, cols: list[str] | None = None, *, digest: bool = False) -> DataFrame:
    """``(column, value, count)`` for every value of every column, nulls included
    as a null ``value``.  With ``digest`` values are keyed by 128-bit digests
    (for distinct counts only: the keys are not the values)."""
    cols = list(df.columns) if cols is None else cols
    u = unpivot_digest(df, cols) if digest else unpivot_text(df, cols)
    return u.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """From a value-count table: ``column, distinct, distinct_with_null, nulls``."""
    return counts.groupBy("column").agg(
        F.count("value").alias("distinct"),
        F.count(F.lit(1)).alias("distinct_with_null"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).cast("long").alias("nulls"),
    )


def top_k(counts: DataFrame, k: int, *, with_nulls: bool = False) -> DataFrame:
    """Top-k values per column by count desc, then value asc: ``column, rank, value, count``.

    ``row_number() <= k`` is planned as a window group limit, so each map
    task forwards at most k rows per column before the shuffle.
    """
    c = counts if with_nulls else counts.where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", "rank", "value", "count")


def _beyond_double(df: DataFrame, cols: list[str]) -> list[str]:
    """Integer and decimal columns with values of more than 53 bits."""
    kinds = {c: df.schema[c].dataType for c in cols}
    wide = [c for c, k in kinds.items() if isinstance(k, T.LongType) or isinstance(k, T.DecimalType) and k.precision > 15]
    if not wide:
        return []
    units = lambda c: F.max(F.abs(F.col(q(c)).cast("double")) * float(10 ** getattr(kinds[c], "scale", 0)))
    most = df.agg(*[units(c).alias(f"m{i}") for i, c in enumerate(wide)]).first()
    return [c for c, m in zip(wide, most, strict=True) if m is not None and m >= 2.0**53]


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], *, approx: bool = False) -> DataFrame:
    """``(column, p, value)`` for each numeric column and probability.

    Exact quantiles of integers beyond 2^53 and of decimals that a double
    can't hold are found among the values themselves; only the result is
    rounded to a double.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, p double, value double")
    if not approx and (exact := _beyond_double(df, cols)):
        out = column_quantiles(df, [c for c in cols if c not in exact], probs)
        for c in exact:
            own = typed_quantiles(df, c, probs)
            out = out.unionByName(own.select(F.lit(c).alias("column"), "p", F.col("value").cast("double").alias("value")))
        return out
    arr = F.array(*[F.struct(F.lit(c).alias("g"), F.col(q(c)).cast("double").alias("v")) for c in cols])
    long = df.select(F.explode(arr).alias("s")).select("s.g", "s.v")
    fn = approx_quantiles_long if approx else quantiles_long
    return fn(long, probs).withColumnRenamed("g", "column")


def quantile_wide(qs: DataFrame, probs: list[float], names: list[str]) -> DataFrame:
    """Pivot ``(column, p, value)`` to one row per column with named columns."""
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(nm) for p, nm in zip(probs, names)]
    return qs.groupBy("column").agg(*aggs)


def count_outside(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(column, outside)``: values of each column below ``lower`` or above
    ``upper`` of the ``bounds`` table (one row per column)."""
    cols = [r for r in df.columns]
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("double").alias("v")) for c in cols])
    long = df.select(F.explode(arr).alias("s")).select("s.column", "s.v").where(F.col("v").isNotNull())
    j = long.join(F.broadcast(bounds.select("column", "lower", "upper")), "column")
    return j.groupBy("column").agg(F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("outside"))


def materialize_small(df: DataFrame) -> DataFrame:
    """Compute a per-column table (one row per column, never per data row)
    once and return it as a local relation, so later rules and joins do not
    re-run the passes behind it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side (their values are scalars)."""
    spark = frames[0].sparkSession
    values, fields = [], []
    for f in frames:
        row = f.first()
        values += list(row) if row is not None else [None] * len(f.columns)
        fields += f.schema.fields
    from pyspark.sql.types import StructType

    return spark.createDataFrame([tuple(values)], StructType(fields))


@contextmanager
def persisted(df: DataFrame):
    """Keep ``df`` (memory, spilling to disk) while a multi-pass fit reads it."""
    d = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield d
    finally:
        d.unpersist()
