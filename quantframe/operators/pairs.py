"""Pair spreads, rolling hedge ratios, mean-reversion half-life and cointegration screening."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.columns import INF, as_column, missing_as_null
from quantframe.operators.features import SERIES
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.rolling import MOMENTS, rolling_moments
from quantframe.plans.scan import previous_row
from quantframe.plans.skew import join_by_key

PAIR = ("a_id", "b_id")
MIN_SXX = 1e-10
MIN_HALF_LIFE_ROWS = 20


def align_pairs(panel: DataFrame, pairs: DataFrame, series: str = "series_id", ts: str = "ts",
                value: str = "value", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Common timestamps of each listed pair: ``a_id, b_id, ts, a, b``.

    Both joins are equi-joins. The first fans a series out to its pairs, salted by timestamp; the
    second matches timestamps, and its key (b_id, ts) spreads even one dominant series.
    """
    left = panel.select(F.col(series).alias("a_id"), ts, F.col(value).alias("a"))
    right = panel.select(F.col(series).alias("b_id"), ts, F.col(value).alias("b"))
    listed = pairs.select("a_id", "b_id").distinct()
    fanned = join_by_key(left, listed, ["a_id"], ts, layout=layout)
    return fanned.join(right, ["b_id", ts]).select("a_id", "b_id", ts, "a", "b")


def build_spread(aligned: DataFrame, hedge_ratio: Column | float = 1.0, name: str = "spread",
                 a: str = "a", b: str = "b") -> DataFrame:
    """Add ``a - hedge_ratio * b``; the ratio is a number or a column such as a rolling ratio."""
    return aligned.withColumn(name, F.col(a) - as_column(hedge_ratio) * F.col(b))


def rolling_hedge_ratio(aligned: DataFrame, window: int = 60, keys: Sequence[str] = PAIR,
                        ts: str = "ts", a: str = "a", b: str = "b", name: str = "hedge_ratio",
                        layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add the slope of a on b over the ``window`` rows before the current one.

    NULL on the first ``window`` rows, with a gap in the frame, or when b hardly varies.
    """
    y, x = missing_as_null(F.col(a)), missing_as_null(F.col(b))
    rows = rolling_moments(aligned, keys, ts, window, x, y, shift=1, layout=layout)
    m = F.col(MOMENTS)
    usable = (m["n"] == window) & (m["square"] >= MIN_SXX)
    return rows.withColumn(name, F.when(usable, m["cross"] / m["square"])).drop(MOMENTS)


def half_life(spread: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value",
              layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Half-life from the regression of the change on the previous value.

    Infinite under 20 present rows, for a constant series, or when the slope is not negative.
    """
    present = spread.select(*keys, ts, missing_as_null(F.col(value)).alias("_s"))
    lagged = previous_row(present, keys, "_s", "_before", ts, layout, skip_missing=True)
    # rows without a value keep their series in the result and count in no sum
    groups = lagged.groupBy(*keys).agg(
        F.count("_s").alias("_n"), F.regr_slope(F.col("_s") - F.col("_before"), F.col("_before")).alias("_slope"))
    n = F.col("_n")
    reverting = (n >= MIN_HALF_LIFE_ROWS) & (F.col("_slope") < 0)
    life = F.when(reverting, F.lit(-math.log(2)) / F.col("_slope")).otherwise(F.lit(INF))
    return groups.select(*keys, life.alias("half_life"), n.alias("n_obs"))
