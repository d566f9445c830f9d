"""Null, NaN and division rules shared by every operator.

Missing values are NULL inside the library: NaN input is mapped to NULL on entry, an undefined
answer is NULL, and an unbounded answer stays an IEEE infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def missing_as_null(column: Column) -> Column:
    """Double with NaN turned into NULL; infinities pass."""
    number = column.cast("double")
    return F.when(~F.isnan(number), number)


def finite_or_null(column: Column) -> Column:
    """Double with NaN and both infinities turned into NULL."""
    number = column.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(INF)), number)


def is_finite(column: Column) -> Column:
    """True or False, never NULL."""
    return finite_or_null(column).isNotNull()


def ieee_divide(numerator: Column, denominator: Column) -> Column:
    """Division that answers x/0 with a signed infinity and 0/0 with NULL (ANSI mode would raise)."""
    at_zero = F.when(numerator > 0, F.lit(INF)).when(numerator < 0, F.lit(-INF))
    return F.when(denominator == 0, at_zero).otherwise(F.try_divide(numerator, denominator))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate, NULL when a side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
