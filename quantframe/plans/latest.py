"""Keep the last record of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order_by``.

    A maximum over structs is combined map-side, so many copies of one key never meet in a window.
    Remaining columns break ties, which makes the result repeatable.
    """
    rest = [c for c in df.columns if c not in key and c not in order_by]
    best = F.max(F.struct(*order_by, *rest)).alias("_best")
    picked = df.groupBy(*key).agg(best)
    return picked.select(*(c if c in key else F.col(f"_best.{c}").alias(c) for c in df.columns))
