"""Signal expressions that work on plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantframe.functions.columns import as_column, missing_as_null

MIN_FIXED_SD = 1e-10


def threshold_signal(score: Column, threshold: float = 0.5) -> Column:
    """+1 above the threshold, -1 below its negative, 0 on the boundary, inside it or when missing."""
    value = missing_as_null(score)
    return F.when(value > threshold, 1).when(value < -threshold, -1).otherwise(0)


def zscore_fixed(value: Column, mu: Column | float, sd: Column | float) -> Column:
    """Z-score against outside statistics, NULL when the deviation is too small to divide by."""
    mean, deviation = as_column(mu), as_column(sd)
    return F.when(deviation >= MIN_FIXED_SD, (missing_as_null(value) - mean) / deviation)
