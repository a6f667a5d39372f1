"""Exploratory statistics (E1–E13): the aggregate tables behind the charts
and the insights.  Drawing is not done; each chart's numbers are.

Column choice follows the charts: numeric = numeric class (booleans are in
neither list), categorical = categorical class, first N columns in table
order (the chart's limit, a parameter); a list given by the caller is used
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.kinds import CATEGORICAL, NUMERIC, columns_of, normalize_missing, q
from .orderstats import quantiles_long
from .pairwise import pair_sums, pearson_from_sums
from .scan import column_moments, materialize_small, top_k, value_counts


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("double").alias("v")) for c in cols])
    return df.select(F.explode(arr).alias("s")).select("s.column", "s.v").where(F.col("v").isNotNull())


def histogram(df: DataFrame, cols: list[str] | None = None, *, bins: int = P.HIST_BINS, max_cols: int = P.HIST_MAX_COLUMNS) -> DataFrame:
    """Equal-width histogram over [min, max] per column.

    ``column, bin, lo, hi, count, density`` for every bin (empty bins
    included); the last bin is closed on the right; a column with one value
    uses [x − 0.5, x + 0.5].  density = count / (n · width).
    """
    d = normalize_missing(df)
    cols = cols or columns_of(d, NUMERIC)[:max_cols]
    spark = d.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, count long, density double")
    m = materialize_small(column_moments(d, cols).where(F.col("n") > 0).select("column", "n", "min", "max"))
    edges = m.select(
        "column", "n",
        F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min")).alias("e0"),
        F.when(F.col("min") == F.col("max"), F.col("max") + 0.5).otherwise(F.col("max")).alias("e1"),
    ).withColumn("w", (F.col("e1") - F.col("e0")) / bins)
    long = _long(d, cols).join(F.broadcast(edges), "column")
    b = F.least(F.floor((F.col("v") - F.col("e0")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counts = long.groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = edges.select("column", "n", "e0", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (
        grid.join(counts, ["column", "bin"], "left")
        .select(
            "column", "bin",
            (F.col("e0") + F.col("bin") * F.col("w")).alias("lo"),
            (F.col("e0") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
            (F.coalesce(F.col("count"), F.lit(0)) / (F.col("n") * F.col("w"))).alias("density"),
        )
    )


def category_frequencies(df: DataFrame, *, max_cols: int = P.CAT_MAX_COLUMNS, top_n: int = P.CAT_TOP_N) -> DataFrame:
    """Top-n values of the first categorical columns."""
    cols = columns_of(df, CATEGORICAL)[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count long")
    return top_k(value_counts(normalize_missing(df), cols), top_n)


def correlations(df: DataFrame, cols: list[str] | None = None, *, max_cols: int = P.CORR_MAX_COLUMNS, fill: float | None = 0.0) -> DataFrame:
    """Pearson matrix in long form ``col_a, col_b, i, j, r`` (E4); pairwise
    complete rows; an undefined r is ``fill`` (0 in the charts)."""
    d = normalize_missing(df)
    cols = cols or columns_of(d, NUMERIC)[:max_cols]
    spark = d.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "col_a string, col_b string, i int, j int, r double")
    means = {row["column"]: row["mean"] for row in column_moments(d, cols).select("column", "mean").collect()}
    sums = pair_sums(d, cols, [means.get(c) for c in cols])
    r = pearson_from_sums()
    r = F.when(F.col("a") == F.col("b"), F.when(r.isNotNull(), F.lit(1.0))).otherwise(r)
    if fill is not None:
        r = F.coalesce(r, F.lit(float(fill)))
    return sums.select("col_a", "col_b", F.col("a").alias("i"), F.col("b").alias("j"), r.alias("r"))


def box_stats(df: DataFrame, cols: list[str] | None = None, *, max_cols: int = P.BOX_MAX_COLUMNS,
              min_values: int = P.BOX_MIN_VALUES, whisker: float = P.BOX_WHISKER) -> DataFrame:
    """Box statistics per column (E5): quartiles, whiskers at the furthest data
    point within ``whisker``·IQR of the box, number of fliers."""
    d = normalize_missing(df)
    cols = cols or columns_of(d, NUMERIC)[:max_cols]
    if not cols:
        return d.sparkSession.createDataFrame(
            [], "group string, n long, q1 double, median double, q3 double, whislo double, whishi double, fliers long")
    return grouped_box_stats(_long(d, cols).withColumnRenamed("column", "group"), "group", "v", min_values=min_values, whisker=whisker)


def grouped_box_stats(long: DataFrame, group: str, value: str, *, min_values: int = P.BOX_MIN_VALUES,
                      whisker: float = P.BOX_WHISKER) -> DataFrame:
    """Box statistics of ``value`` per ``group`` of a long table."""
    d = long.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    qs = quantiles_long(d, [0.25, 0.5, 0.75])
    wide = materialize_small(
        qs.groupBy("g").agg(
            F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
        )
    )
    fence = wide.select(
        "g", "q1", "median", "q3",
        (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("flo"),
        (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("fhi"),
    )
    j = d.join(F.broadcast(fence), "g")
    inside = (F.col("v") >= F.col("flo")) & (F.col("v") <= F.col("fhi"))
    # the whiskers are the extreme values inside the fences, so the values beyond
    # the whiskers (fliers) are exactly those outside the fences: one pass
    agg = j.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whislo"),
        F.max(F.when(inside, F.col("v"))).alias("whishi"),
        F.count_if(~inside).alias("fliers"),
    )
    return agg.join(F.broadcast(fence), "g").where(F.col("n") >= min_values).select(
        F.col("g").alias(group), "n", "q1", "median", "q3", "whislo", "whishi", "fliers"
    )


def target_kind(df: DataFrame, target: str) -> str:
    """``categorical`` when the target is not numeric or has at most 5 distinct values."""
    kinds = dict((f.name, f) for f in df.schema.fields)
    from ..functions.kinds import kind_of

    if kind_of(kinds[target].dataType) != NUMERIC:
        return CATEGORICAL
    n = df.agg(F.count_distinct(F.col(q(target)))).first()[0]
    return CATEGORICAL if n <= P.TARGET_CAT_MAX_DISTINCT else NUMERIC


def box_by_class(df: DataFrame, target: str, features: list[str] | None = None, *, max_features: int = P.TARGET_MAX_FEATURES) -> DataFrame:
    """Categorical target vs numeric features (E6): box statistics of each
    feature per target class; rows with either value null are dropped and a
    feature needs ≥5 rows."""
    d = normalize_missing(df)
    feats = [c for c in features or columns_of(d, NUMERIC) if c != target][: None if features else max_features]
    parts = []
    for f in feats:
        sub = d.select(F.col(q(f)).cast("double").alias("v"), F.col(q(target)).cast("string").alias("t")).dropna()
        parts.append(sub.select(F.lit(f).alias("feature"), "t", "v"))
    if not parts:
        return d.sparkSession.createDataFrame([], "feature string, class string, n long, q1 double, median double, q3 double, whislo double, whishi double, fliers long")
    long = parts[0]
    for p_ in parts[1:]:
        long = long.unionByName(p_)
    enough = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= P.BOX_MIN_VALUES)
    long = long.join(F.broadcast(enough.select("feature")), "feature").select(F.to_json(F.struct("feature", "t")).alias("key"), "v")
    bs = grouped_box_stats(long, "key", "v", min_values=1)
    parsed = F.from_json("key", "feature string, t string")
    return bs.select(parsed["feature"].alias("feature"), parsed["t"].alias("class"), "n", "q1", "median", "q3", "whislo", "whishi", "fliers")


def trend_lines(df: DataFrame, target: str, features: list[str] | None = None, *, max_features: int = P.TARGET_MAX_FEATURES) -> DataFrame:
    """Continuous target vs numeric features (E7): least-squares line
    ``target = slope·feature + intercept`` over rows where both are present,
    when there are more than 2 such rows."""
    d = normalize_missing(df)
    feats = [c for c in features or columns_of(d, NUMERIC) if c != target][: None if features else max_features]
    y = F.col(q(target)).cast("double")
    aggs = []
    for i, f in enumerate(feats):
        x = F.col(q(f)).cast("double")
        aggs += [F.regr_count(y, x).alias(f"n{i}"), F.regr_slope(y, x).alias(f"s{i}"), F.regr_intercept(y, x).alias(f"b{i}")]
    if not aggs:
        return d.sparkSession.createDataFrame([], "feature string, n long, slope double, intercept double")
    wide = d.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("slope"), F.col(f"b{i}").alias("intercept")) for i, f in enumerate(feats)]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*").where(F.col("n") > 2)


def target_points(df: DataFrame, target: str, features: list[str] | None = None, *, max_features: int = P.TARGET_MAX_FEATURES) -> DataFrame:
    """The points behind the trend lines (E7): ``feature, x, y`` of all rows where both are present."""
    d = normalize_missing(df)
    feats = [c for c in features or columns_of(d, NUMERIC) if c != target][: None if features else max_features]
    if not feats:
        return d.sparkSession.createDataFrame([], "feature string, x double, y double")
    y = F.col(q(target)).cast("double").alias("y")
    points = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(q(f)).cast("double").alias("x"), y) for f in feats])
    return d.select(F.explode(points).alias("s")).select("s.*").where("x IS NOT NULL AND y IS NOT NULL")


def target_by_category(df: DataFrame, target: str, features: list[str] | None = None, *, top: int = P.TARGET_TOP_CATEGORIES,
                       max_features: int = P.TARGET_MAX_FEATURES) -> DataFrame:
    """Continuous target vs categorical features (E8): box statistics of the
    target within each of the ``top`` most frequent categories."""
    d = normalize_missing(df)
    feats = [c for c in features or columns_of(d, CATEGORICAL) if c != target][: None if features else max_features]
    if not feats:
        return d.sparkSession.createDataFrame([], "feature string, category string, n long, q1 double, median double, q3 double, whislo double, whishi double, fliers long")
    tops = top_k(value_counts(d, feats), top).select(F.col("column").alias("feature"), F.col("value").alias("category"))
    long = None
    for f in feats:
        part = d.select(F.lit(f).alias("feature"), F.col(q(f)).cast("string").alias("category"), F.col(q(target)).cast("double").alias("v")).dropna()
        long = part if long is None else long.unionByName(part)
    long = long.join(F.broadcast(tops), ["feature", "category"]).select(F.to_json(F.struct("feature", "category")).alias("key"), "v")
    bs = grouped_box_stats(long, "key", "v", min_values=1)
    parsed = F.from_json("key", "feature string, category string")
    return bs.select(parsed["feature"].alias("feature"), parsed["category"].alias("category"), "n", "q1", "median", "q3", "whislo", "whishi", "fliers")


def crosstab(df: DataFrame, target: str, features: list[str] | None = None, *, top: int = P.TARGET_TOP_CATEGORIES,
             max_features: int = P.TARGET_MAX_FEATURES) -> DataFrame:
    """Categorical target vs categorical features (E9): counts of (category,
    class) for the ``top`` most frequent categories, long form."""
    d = normalize_missing(df)
    feats = [c for c in features or columns_of(d, CATEGORICAL) if c != target][: None if features else max_features]
    if not feats:
        return d.sparkSession.createDataFrame([], "feature string, category string, class string, count long")
    tops = top_k(value_counts(d, feats), top).select(F.col("column").alias("feature"), F.col("value").alias("category"))
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(q(f)).cast("string").alias("category")) for f in feats])
    long = d.select(F.explode(arr).alias("s"), F.col(q(target)).cast("string").alias("class")).select("s.feature", "s.category", "class").dropna()
    return long.join(F.broadcast(tops), ["feature", "category"]).groupBy("feature", "category", "class").agg(F.count(F.lit(1)).alias("count"))


def skew_insights(df: DataFrame) -> DataFrame:
    """Numeric columns with n > 5, std > 0 and |skew| > 1.5."""
    m = column_moments(normalize_missing(df), columns_of(df, NUMERIC))
    return m.where((F.col("n") > P.SKEW_INSIGHT_MIN_N) & (F.col("std") > 0) & (F.abs(F.col("skew")) > P.SKEW_INSIGHT_ABS)).select(
        "column", "ordinal", "skew"
    )


def collinear_pairs(df: DataFrame, *, threshold: float = P.COLLINEAR_ABS_R, top: int = P.COLLINEAR_TOP) -> DataFrame:
    """Pairs of all numeric columns with |r| ≥ threshold, upper triangle in column order, first ``top``."""
    c = correlations(df, columns_of(df, NUMERIC))
    return c.where((F.col("i") < F.col("j")) & (F.abs(F.col("r")) >= threshold)).orderBy("i", "j").limit(top)


def target_correlations(df: DataFrame, target: str, *, top: int = P.TARGET_CORR_TOP) -> DataFrame:
    """Top features by |r| with a numeric target, nulls skipped."""
    nums = columns_of(df, NUMERIC)
    if target not in nums:
        return df.sparkSession.createDataFrame([], "feature string, r double")
    c = correlations(df, nums, fill=None)
    return (
        c.where((F.col("col_b") == target) & (F.col("col_a") != target) & F.col("r").isNotNull())
        .orderBy(F.abs(F.col("r")).desc(), F.col("i"))
        .limit(top)
        .select(F.col("col_a").alias("feature"), "r")
    )


def eda_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and categorical counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.lit(len(columns_of(df, NUMERIC))).cast("long").alias("n_numeric"),
        F.lit(len(columns_of(df, CATEGORICAL))).cast("long").alias("n_categorical"),
    )
