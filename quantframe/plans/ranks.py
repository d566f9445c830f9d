"""Exact ranks and order statistics of groups of any size.

Equal values are counted first (combined map-side), then the distinct values of a large group are
cut into ranges so that the cumulative count never runs through a whole group in one task. Split
points are those distinct values whose hash falls into a fixed class: a pure function of the data,
so that every evaluation of the plan cuts at the same places. They only steer the work; the counts
are exact for any choice of split points.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.skew import join_by_key
from quantframe.session import materialize

MAX_SPLITS_LOG2 = 12
RANGE = "_range"


def _with_range(df: DataFrame, splits: str, value: str) -> DataFrame:
    """Number of split points below the value, by halving steps. Each step is its own projection:
    compiled code with two array reads, where one expression for all would be a slow lambda."""
    found = df.withColumn(RANGE, F.lit(0))
    for step in (1 << k for k in reversed(range(MAX_SPLITS_LOG2 + 1))):
        probe = F.get(F.col(splits), F.col(RANGE) + (step - 1))
        found = found.withColumn(RANGE, F.when(probe < F.col(value), F.col(RANGE) + step).otherwise(F.col(RANGE)))
    return found


def _thin(sorted_values: Column) -> Column:
    stride = F.ceil(F.size(sorted_values) / F.lit(float(1 << MAX_SPLITS_LOG2)))
    return F.filter(sorted_values, lambda _, i: i % stride == 0)


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str,
                   layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """One row per distinct value with its count ``n``, the count ``below`` it, and per group the
    number of rows ``total`` and of distinct values ``distinct_total``. Values must not be NULL."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)
    unbounded = (Window.unboundedPreceding, Window.currentRow)
    if layout.fits_one_task:
        upto = F.sum("n").over(whole.orderBy(value).rowsBetween(*unbounded))
        return counts.select(*keys, value, "n", (upto - F.col("n")).alias("below"),
                             F.sum("n").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("distinct_total"))
    splits = (
        df.filter(F.pmod(F.xxhash64(value), F.lit(layout.block_rows)) == 0)
        .groupBy(*keys).agg(_thin(F.sort_array(F.collect_set(value))).alias("_splits"))
    )
    # used twice below, and its many projections would be optimised again with everything on top
    ranged = materialize(
        _with_range(join_by_key(counts, splits, keys, value, "left", layout), "_splits", value).drop("_splits"))
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*keys, RANGE).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    offsets = ranges.select(
        *keys, RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("total"), F.sum("_d").over(whole).alias("distinct_total"))
    upto = F.sum("n").over(Window.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(*unbounded))
    return ranged.join(offsets, [*keys, RANGE]).select(
        *keys, value, "n", (F.col("_offset") + upto - F.col("n")).alias("below"),
        "total", "distinct_total")


def average_ranks(df: DataFrame, keys: Sequence[str], values: Mapping[str, str],
                  layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add the rank of each column of ``values`` inside its group, under the name mapped to it; tied
    rows share the mean of their ranks.

    Groups that fit one task are ranked by windows, all columns over one shuffle and one sort each. Otherwise the counts
    of distinct values are joined back on (keys, value): a value shared by very many rows makes one
    large probe partition, which adaptive execution splits, against a single row on the other side.
    """
    if layout.fits_one_task:
        def rank_of(value: str) -> Column:
            ordered = Window.partitionBy(*keys).orderBy(value)
            tied = ordered.rangeBetween(Window.currentRow, Window.currentRow)
            return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2

        return df.withColumns({name: rank_of(value) for value, name in values.items()})
    ranked = df
    for value, name in values.items():
        ranks = ordered_counts(df, keys, value, layout).select(
            *keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(name))
        ranked = ranked.join(ranks, [*keys, value])
    return ranked
