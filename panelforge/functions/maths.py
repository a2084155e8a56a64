"""Numeric column expressions with defined results on constant and missing input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this standard deviation a series counts as constant.
CONSTANT = 1e-10
WINTER, SUMMER = (12, 1, 2), (6, 7, 8)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs without nulls; null if either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    varies = F.when((sx >= CONSTANT) & (sy >= CONSTANT), sx * sy)
    return F.covar_pop(x, y) / varies


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x; 0 for a constant y."""
    return F.when(F.stddev_pop(y) < CONSTANT, 0.0).otherwise(F.regr_slope(y, x))


def isclose(a: Column, b: Column) -> Column:
    """Equality up to 1e-8 plus 1e-5 of b."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the non-null columns; null if all are."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(n > 0, total / n)


def array_mean(a: Column) -> Column:
    """Mean of the non-null elements."""
    kept = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda t, x: t + x) / F.size(kept))


def array_std(a: Column) -> Column:
    """Sample standard deviation of the non-null elements; null for fewer than two."""
    kept = F.filter(a, lambda x: x.isNotNull())
    mean = array_mean(a)
    square = F.aggregate(F.transform(kept, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(kept) > 1, F.sqrt(square / (F.size(kept) - 1)))


def array_sum(a: Column) -> Column:
    return F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda t, x: t + x)


def array_diff(a: Column, n: int) -> Column:
    """Differences of neighbours of an array of n elements."""
    return F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda x, y: x - y)


def entropy(shares: Column) -> Column:
    """-sum s ln(s + 1e-10) over the non-null shares."""
    return -F.aggregate(F.filter(shares, lambda s: s.isNotNull()), F.lit(0.0), lambda t, s: t + s * F.ln(s + 1e-10))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
