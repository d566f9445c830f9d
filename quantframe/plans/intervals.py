"""Rows matched to the date ranges that contain them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "_day"


def join_ranges(rows: DataFrame, ranges: DataFrame, start: str, end: str, ts: str = "ts",
                on: Sequence[str] = ()) -> DataFrame:
    """Inner join on ``start <= ts <= end``, both ends inclusive.

    Each range is listed once per calendar day it touches, which makes the match an equi-join on the
    day followed by a filter. The listed side grows with ranges and days, never with the rows; Spark
    broadcasts it only while its measured size is under the session's threshold.
    """
    days = F.sequence(F.to_date(start), F.to_date(end))
    listed = ranges.withColumn(DAY, F.explode(days))
    dated = rows.withColumn(DAY, F.to_date(ts))
    inside: Column = F.col(ts).between(F.col(start), F.col(end))
    return dated.join(listed, [*on, DAY]).filter(inside).drop(DAY)
