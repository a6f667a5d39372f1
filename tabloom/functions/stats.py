"""Column expressions for statistics Spark computes differently from the
sample-statistics convention (bias-corrected skewness and kurtosis, Pearson
correlation that tolerates constant columns under ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column, n: Column) -> Column:
    """Adjusted Fisher–Pearson skewness G1 from Spark's population ``skewness``.

    Null unless n > 2 and the sample standard deviation is non-zero.
    """
    g1 = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n > 2) & (F.stddev_samp(x) != 0), g1)


def sample_kurtosis(x: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population ``kurtosis``.

    Null unless n > 3 and the sample standard deviation is non-zero.
    """
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when((n > 3) & (F.stddev_samp(x) != 0), g2)


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over pairwise-complete rows; null when either side is constant.

    Built from covariance and standard deviations so a constant column gives
    null instead of a DIVIDE_BY_ZERO error.
    """
    both = a.isNotNull() & b.isNotNull()
    aa = F.when(both, a).cast("double")
    bb = F.when(both, b).cast("double")
    den = F.stddev_samp(aa) * F.stddev_samp(bb)
    return F.covar_samp(aa, bb) / F.when(den != 0, den)


def round_half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)
