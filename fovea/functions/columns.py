"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for reports, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def pixel(d1: Column, d2: Column, height: int) -> Column:
    """Column-major pixel number from zero-based places."""
    return (d1 + d2 * height).cast("int")


def row_of(px: Column, height: int) -> Column:
    return (px % height).cast("int")


def column_of(px: Column, height: int) -> Column:
    return F.floor(px / height).cast("int")


def clamped(c: Column) -> Column:
    """The positive part; null and NaN give zero."""
    return F.when(F.isnan(c) | c.isNull() | (c <= 0), 0.0).otherwise(c)


def excess_moments(x1: Column, x2: Column, x3: Column, x4: Column) -> tuple[Column, Column]:
    """(squared skewness, kurtosis) from raw moments; null where the variance is zero."""
    var = x2 - x1 * x1
    m3 = x3 - 3 * x1 * x2 + 2 * x1 * x1 * x1
    m4 = x4 - 4 * x1 * x3 + 6 * x1 * x1 * x2 - 3 * x1 * x1 * x1 * x1
    return F.try_divide(m3 * m3, var * var * var), F.try_divide(m4, var * var)


def image_negentropy(x1: Column, x2: Column, x3: Column, x4: Column) -> Column:
    """Approximate negentropy of a pixel, with the excess kurtosis as it is."""
    skew2, kurt = excess_moments(x1, x2, x3, x4)
    return skew2 / 12 + (kurt - 3) / 48


def raw_negentropy(x2: Column, x3: Column, x4: Column) -> Column:
    """The form for values taken as centred: raw moments, nothing subtracted."""
    return F.try_divide(x3 * x3, x2 * x2 * x2) / 12 + F.try_divide(x4, x2 * x2) / 48


def trace_negentropy(values: Column | str) -> Column:
    """Approximate negentropy of a trace (an aggregate), with the excess kurtosis squared."""
    return F.pow(F.skewness(values), 2) / 12 + F.pow(F.kurtosis(values), 2) / 48
