"""Pairwise-complete sufficient statistics for correlations and line fits.

For columns ``a`` and ``b`` the statistics are taken over the rows where
both are non-null: ``n, Σa, Σb, Σa², Σb², Σab`` (values shifted by a
per-column constant for numerical stability).  Each task reduces its rows
to these sums with one small matrix product per batch (numpy inside
``mapInPandas``), so only ``k²`` numbers per task cross the shuffle; Spark
then adds them up per pair.  No pair of rows is ever formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import q

_OUT = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"


def _partial(cols_n: int, shifts: list[float]):
    shift = np.asarray(shifts, dtype="float64")

    def fn(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            a = np.where(m, x - shift, 0.0)
            mf = m.astype("float64")
            a2 = a * a
            n = mf.T @ mf  # n[i, j]  rows with both i and j present
            sa = a.T @ mf  # Σ a_i over rows where j present
            saa = a2.T @ mf  # Σ a_i² over rows where j present
            sab = a.T @ a  # Σ a_i a_j (zero where either missing)
            part = (n, sa, saa, sab)
            acc = part if acc is None else tuple(p + q_ for p, q_ in zip(acc, part))
        if acc is None:
            return
        n, sa, saa, sab = acc
        i, j = np.meshgrid(np.arange(cols_n), np.arange(cols_n), indexing="ij")
        yield pd.DataFrame(
            {
                "a": i.ravel().astype("int32"),
                "b": j.ravel().astype("int32"),
                "n": n.ravel(),
                "sa": sa.ravel(),
                "sb": sa.T.ravel(),
                "saa": saa.ravel(),
                "sbb": saa.T.ravel(),
                "sab": sab.ravel(),
            }
        )

    return fn


def pair_sums(df: DataFrame, cols: list[str], shifts: list[float] | None = None) -> DataFrame:
    """``(a, b, n, sa, sb, saa, sbb, sab)`` for every ordered pair of ``cols``
    (column names in ``a``/``b``)."""
    spark = df.sparkSession
    shifts = shifts or [0.0] * len(cols)
    shifts = [0.0 if s is None or not np.isfinite(s) else float(s) for s in shifts]
    num = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = num.mapInPandas(_partial(len(cols), shifts), _OUT)
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ["n", "sa", "sb", "saa", "sbb", "sab"]])
    names = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "i int, name string")
    return (
        sums.join(F.broadcast(names.withColumnRenamed("i", "a").withColumnRenamed("name", "col_a")), "a")
        .join(F.broadcast(names.withColumnRenamed("i", "b").withColumnRenamed("name", "col_b")), "b")
    )


def pearson_from_sums() -> F.Column:
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ["n", "sa", "sb", "saa", "sbb", "sab"])
    cov = sab - sa * sb / n
    va = saa - sa * sa / n
    vb = sbb - sb * sb / n
    den = F.sqrt(va * vb)
    # A side without spread has no correlation (null), as in pandas.
    return F.when((n > 1) & (va > 0) & (vb > 0), cov / den)


def slope_from_sums() -> tuple[F.Column, F.Column]:
    """Least-squares line of b on a: (slope, intercept) in the shifted frame
    is corrected by the caller with the shifts."""
    n, sa, sb, saa, sab = (F.col(c) for c in ["n", "sa", "sb", "saa", "sab"])
    va = saa - sa * sa / n
    slope = F.when(va > 0, (sab - sa * sb / n) / va)
    return slope, (sb - slope * sa) / n
