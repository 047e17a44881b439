"""Scalar expressions: guarded ratios, rounding and small-sample moment corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as a double; NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded(value: Column, digits: int = 4) -> Column:
    """Round and turn -0.0 into 0.0, so equal results compare equal."""
    return F.round(value, digits) + F.lit(0.0)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return rounded(ratio(part, whole) * 100, digits)


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, NULL below three values."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(corrected, F.lit(0.0)))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, NULL below four values."""
    n = F.count(value).cast("double")
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson correlation; NULL when either side is constant.

    ``covar_pop`` skips incomplete pairs and ``stddev_pop`` does not, so each side
    is masked by the other. ``corr`` is not used: it raises on a constant column
    in ANSI mode.
    """
    xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(xm) * F.stddev_pop(ym))
    return clipped(value, -1.0, 1.0)


def clipped(value: Column, low: float, high: float) -> Column:
    """Limit a value to a range; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)
