"""Joins of rows with a table of few rows per key, where one key may dominate the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.plans.layout import DEFAULT_LAYOUT, Layout

SALT = "_salt"
SALTS = 64


def join_by_key(rows: DataFrame, table: DataFrame, on: Sequence[str], spread: str, how: str = "inner",
                layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Join ``rows`` with a per-key ``table``, the rows of each key spread over ``SALTS`` partitions.

    ``spread`` is a column of ``rows`` that varies inside a key. The table is copied per salt, which
    is cheap for one or a few rows per key; where its measured size allows, Spark broadcasts it
    instead. Nothing is salted when every key is known to fit one task.
    """
    keys = list(on)
    if layout.fits_one_task:
        return rows.join(table, keys, how)
    salted = rows.withColumn(SALT, F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = table.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, SALT], how).drop(SALT)
