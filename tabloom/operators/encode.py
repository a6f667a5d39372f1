"""Train-only encoding and scaling.

``fit_encoder(x_train)`` splits columns into numeric / low-cardinality
(distinct values counting null ≤ 12) / high-cardinality, and learns median,
mean and population std (numeric), sorted categories (one-hot) and value
shares (frequency encoding).  The frequency dictionaries grow with the data,
so they stay a DataFrame (``freq``), keyed by 128-bit digests of the texts.
``transform`` looks up the frequent values (and the null) in a list of at
most ``HOT_VALUES`` digests a column; all others meet the dictionary in a
join that Spark plans by the table's measured bytes.  Rows that the list
has answered carry keys of their own there, so neither a null nor any
other value with a large share of the rows is one join key.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.kinds import NUMERIC, as_text, column_kinds, q
from ..session import cut_lineage
from .scan import column_quantiles, distinct_counts, persisted, quantile_wide, value_counts

#: Values with at least this share of the training rows are answered from a list: there are no more than its inverse.
HOT_SHARE = 1e-3
HOT_VALUES = round(1 / HOT_SHARE)


def _digest(text):
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _text(df: DataFrame, c: str, null_as: str):
    dt = {f.name: f.dataType for f in df.schema.fields}[c]
    x = F.col(q(c))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        x = F.when(F.isnan(x), None).otherwise(x)
    return F.coalesce(as_text(x, dt), F.lit(null_as))


def _no_inf(c):
    return F.when(F.abs(c) == float("inf"), F.lit(None).cast("double")).otherwise(c)


@dataclass
class EncoderModel:
    num_cols: list[str] = field(default_factory=list)
    low_card: dict[str, list[str]] = field(default_factory=dict)
    high_card: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    scale_numeric: bool = True
    freq: DataFrame | None = None  # (column, value, freq)

    @property
    def feature_names(self) -> list[str]:
        names = list(self.num_cols) + [f"freq_{c}" for c in self.high_card]
        for c, cats in self.low_card.items():
            names += [f"{c}_{v}" for v in cats]
        return names

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Encoded features in the fitted order; absent inputs give 0.0; ``keep``
        columns are passed through in front (row keys)."""
        keep = keep or []
        d = df
        for i, c in enumerate(self.high_card):
            if c not in d.columns:
                continue
            own = self.freq.where(F.col("column") == c).select(_digest(F.col("value")).alias(f"_hk{i}"), F.col("freq").alias("f"))
            hot = own.where(F.col("f") >= HOT_SHARE).select(f"_hk{i}", F.col("f").alias(f"_fh{i}"))  # at most HOT_VALUES rows of 24 bytes
            rest = own.where(F.col("f") < HOT_SHARE).select(F.col(f"_hk{i}.a").alias(f"_fa{i}"), F.col(f"_hk{i}.b").alias(f"_fb{i}"), F.col("f").alias(f"_ff{i}"))
            d = d.withColumn(f"_fk{i}", _digest(_text(d, c, P.FREQ_NULL_TEXT))).join(F.broadcast(hot), F.col(f"_fk{i}") == F.col(f"_hk{i}"), "left").drop(f"_hk{i}")
            # an answered row has a random key, marked so that it meets nothing
            known = F.col(f"_fh{i}").isNotNull()
            d = d.withColumns({
                f"_fx{i}": F.when(known, (F.rand(7) * (1 << 62)).cast("long")).otherwise(F.col(f"_fk{i}.a")), f"_fy{i}": F.when(~known, F.col(f"_fk{i}.b")),
            })
            d = d.join(rest, (F.col(f"_fx{i}") == F.col(f"_fa{i}")) & (F.col(f"_fy{i}").eqNullSafe(F.col(f"_fb{i}"))), "left")
        out = [F.col(q(k)) for k in keep]
        for c in self.num_cols:
            if c not in df.columns:
                out.append(F.lit(0.0).alias(c))
                continue
            x = F.coalesce(_no_inf(F.col(q(c)).cast("double")), F.lit(self.medians.get(c)))
            if self.scale_numeric:
                x = (x - F.lit(self.means[c])) / F.lit(self.scales[c])
            out.append(F.coalesce(_no_inf(x), F.lit(0.0)).alias(c))
        for i, c in enumerate(self.high_card):
            out.append((F.coalesce(F.col(f"_fh{i}"), F.col(f"_ff{i}"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(f"freq_{c}"))
        for c, cats in self.low_card.items():
            for v in cats:
                if c in df.columns:
                    out.append(F.when(_text(df, c, P.ONEHOT_MISSING) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}"))
                else:
                    out.append(F.lit(0.0).alias(f"{c}_{v}"))
        return d.select(*out)

    # R9 save / load
    def save(self, path: str) -> None:
        meta = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "freq"}
        self.freq.write.mode("overwrite").parquet(os.path.join(path, "freq"))
        spark = self.freq.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(os.path.join(path, "meta"))

    @staticmethod
    def load(spark, path: str) -> "EncoderModel":
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        m = EncoderModel(**{k: v for k, v in meta.items() if k != "freq_rows"})
        m.freq = spark.read.parquet(os.path.join(path, "freq"))
        return m


def fit_encoder(x_train: DataFrame, *, scale_numeric: bool = True, max_low_cardinality: int = P.MAX_LOW_CARDINALITY) -> EncoderModel:
    with persisted(x_train) as x:
        return _fit_encoder(x, scale_numeric, max_low_cardinality)


def _fit_encoder(x_train: DataFrame, scale_numeric: bool, max_low_cardinality: int) -> EncoderModel:
    spark = x_train.sparkSession
    kinds = column_kinds(x_train)
    num = [c for c in x_train.columns if kinds[c] == NUMERIC]
    cat = [c for c in x_train.columns if kinds[c] != NUMERIC]
    m = EncoderModel(num_cols=num, scale_numeric=scale_numeric)
    if cat:
        text = x_train.select(*[_text(x_train, c, P.FREQ_NULL_TEXT).alias(c) for c in cat])
        counts = value_counts(text, cat).cache()
        card = {r_["column"]: r_["distinct_with_null"] for r_ in distinct_counts(counts).collect()}
        low = [c for c in cat if card.get(c, 0) <= max_low_cardinality]
        m.high_card = [c for c in cat if c not in low]
        # one-hot categories, sorted; a null is "missing", the text "nan" itself
        if low:
            sets = x_train.agg(*[F.collect_set(_text(x_train, c, P.ONEHOT_MISSING)).alias(c) for c in low]).first()
            m.low_card = {c: sorted(sets[c]) for c in low if sets[c]}
        m.low_card = {c: m.low_card[c] for c in low if c in m.low_card}
        n = x_train.count()
        m.freq = cut_lineage(counts.where(F.col("column").isin(*m.high_card)).select("column", "value", (F.col("count") / F.lit(n)).alias("freq")))
        counts.unpersist()
    else:
        m.freq = spark.createDataFrame([], "column string, value string, freq double")
    if num:
        clean = x_train.select(*[_no_inf(F.col(q(c)).cast("double")).alias(c) for c in num])
        med = {r_["column"]: r_["median"] for r_ in quantile_wide(column_quantiles(clean, num, [0.5]), [0.5], ["median"]).collect()}
        m.medians = {c: (med.get(c) if med.get(c) is not None else 0.0) for c in num}
        imputed = clean.select(*[F.coalesce(F.col(q(c)), F.lit(m.medians[c])).alias(c) for c in num])
        aggs = []
        for i, c in enumerate(num):
            aggs += [F.avg(F.col(q(c))).alias(f"m{i}"), F.stddev_pop(F.col(q(c))).alias(f"s{i}")]
        row = imputed.agg(*aggs).first()
        for i, c in enumerate(num):
            m.means[c] = row[f"m{i}"] if row[f"m{i}"] is not None else 0.0
            s = row[f"s{i}"]
            m.scales[c] = s if s else 1.0
    return m
