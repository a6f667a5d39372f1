"""Candidate feature generation (F1–F7), decided on train, applied to any split.

``fit_features(x_train)`` looks at the training rows only (skew for log
transforms, the numeric columns for pairs, datetime columns for parts) and
returns a ``FeaturePlan``; ``plan.transform(df)`` is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.kinds import DATETIME, NUMERIC, columns_of, normalize_missing, q
from .scan import column_moments


@dataclass
class FeaturePlan:
    log_columns: list[str] = field(default_factory=list)
    pair_columns: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    max_new_features: int = P.MAX_NEW_FEATURES

    def created(self) -> list[tuple[str, str, str]]:
        out = [(f"log_{c}", "log_transform", c) for c in self.log_columns]
        pc = self.pair_columns
        for i in range(len(pc)):
            for j in range(i + 1, len(pc)):
                out.append((f"diff_{pc[i]}_{pc[j]}", "difference", f"{pc[i]},{pc[j]}"))
                out.append((f"ratio_{pc[i]}_{pc[j]}", "ratio", f"{pc[i]},{pc[j]}"))
        for c in self.date_columns:
            out += [(f"{c}_{p}", "datetime_part", c) for p in ("month", "day", "dayofweek")]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        cols = []
        for c in self.log_columns:
            cols.append(F.log1p(F.greatest(F.col(q(c)).cast("double"), F.lit(0.0))).alias(f"log_{c}"))
        pc = self.pair_columns
        for i in range(len(pc)):
            for j in range(i + 1, len(pc)):
                a, b = F.col(q(pc[i])).cast("double"), F.col(q(pc[j])).cast("double")
                cols.append((a - b).alias(f"diff_{pc[i]}_{pc[j]}"))
                cols.append((a / (F.abs(b) + P.RATIO_EPSILON)).alias(f"ratio_{pc[i]}_{pc[j]}"))
        for c in self.date_columns:
            t = F.col(q(c))
            cols += [F.month(t).alias(f"{c}_month"), F.dayofmonth(t).alias(f"{c}_day"), F.weekday(t).alias(f"{c}_dayofweek")]
        return df.select("*", *cols)

    def log(self, spark) -> DataFrame:
        """Feature catalog (F5): name, type, source, retained (first N; nothing is dropped)."""
        rows = [(n, t, s, i < self.max_new_features) for i, (n, t, s) in enumerate(self.created())]
        return spark.createDataFrame(rows, "name string, type string, source string, retained boolean")


def fit_features(x_train: DataFrame, *, max_new_features: int = P.MAX_NEW_FEATURES, pair_columns: list[str] | None = None,
                 max_pair_columns: int | None = P.PAIR_MAX_COLUMNS) -> FeaturePlan:
    """``pair_columns`` names the columns to pair; by default the first ``max_pair_columns`` numeric ones (None: all)."""
    d = normalize_missing(x_train)
    nums = columns_of(d, NUMERIC)
    plan = FeaturePlan(max_new_features=max_new_features)
    if nums:
        m = {r_["column"]: r_ for r_ in column_moments(d, nums).collect()}
        for c in nums:
            s = m[c]
            if (s["n"] or 0) > P.LOG_MIN_VALUES and s["min"] >= 0 and (s["std"] or 0) > 0 and s["skew"] is not None and s["skew"] > P.LOG_MIN_SKEW:
                plan.log_columns.append(c)
    if pair_columns or len(nums) >= 2:
        plan.pair_columns = pair_columns or nums[:max_pair_columns]
    plan.date_columns = columns_of(d, DATETIME)
    return plan


def product_feature(df: DataFrame) -> DataFrame:
    """Notebook product feature (F7): ``<a>_x_<b>`` for the first two numeric columns."""
    nums = columns_of(df, NUMERIC)
    if len(nums) < 2:
        return df
    a, b = nums[0], nums[1]
    return df.withColumn(f"{a}_x_{b}", F.col(q(a)).cast("double") * F.col(q(b)).cast("double"))
