"""Running computations over series of any length.

Level one works inside (series, chunk). Level two is a table with one row per (series, chunk); its
prefix values are joined back as carries. The join and the windows that follow use the same hash
partitioning, so the panel itself is shuffled once. A series that fits one task is one chunk without
carries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantframe.plans.layout import DEFAULT_LAYOUT, Layout, with_chunk_column

CHUNK = "_chunk"
ROW_INDEX = "row_index"
SERIES_ROWS = "series_rows"


def with_chunk(df: DataFrame, ts: str, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    return with_chunk_column(df, ts, layout, CHUNK)


def in_chunk(keys: Sequence[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(ts)


def running_in_chunk(keys: Sequence[str], ts: str) -> WindowSpec:
    return in_chunk(keys, ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier_chunks(keys: Sequence[str]) -> WindowSpec:
    """Window for the chunk table only: every chunk of the series before the current one."""
    ordered = Window.partitionBy(*keys).orderBy(CHUNK)
    return ordered.rowsBetween(Window.unboundedPreceding, -1)


def carry_in(chunked: DataFrame, keys: Sequence[str], totals: Mapping[str, Column],
             carries: Mapping[str, Column]) -> DataFrame:
    """Attach carries, computed over the chunk table, to the rows of each chunk."""
    table = chunked.groupBy(*keys, CHUNK).agg(*(c.alias(name) for name, c in totals.items()))
    carried = table.select(*keys, CHUNK, *(c.alias(name) for name, c in carries.items()))
    return chunked.join(carried, [*keys, CHUNK])


def index_rows(df: DataFrame, keys: Sequence[str], ts: str = "ts",
               layout: Layout = DEFAULT_LAYOUT, series_rows: bool = False) -> DataFrame:
    """Number the rows of each series from 0 in time order.

    A panel that already carries ``row_index`` is returned as it is, so several operators can share
    one numbering. ``series_rows`` adds the length of the series.
    """
    if ROW_INDEX in df.columns and (not series_rows or SERIES_ROWS in df.columns):
        return df
    bare = df.drop(ROW_INDEX, SERIES_ROWS)
    whole = Window.partitionBy(*keys)
    if layout.fits_one_task:
        columns = {ROW_INDEX: (F.row_number().over(whole.orderBy(ts)) - 1).cast("long")}
        if series_rows:
            columns[SERIES_ROWS] = F.count(F.lit(1)).over(whole)
        return bare.withColumns(columns)
    carries = {"_before": F.coalesce(F.sum("_n").over(earlier_chunks(keys)), F.lit(0))}
    if series_rows:
        carries[SERIES_ROWS] = F.sum("_n").over(whole)
    counted = carry_in(with_chunk(bare, ts, layout), keys, {"_n": F.count(F.lit(1))}, carries)
    position = F.col("_before") + F.row_number().over(in_chunk(keys, ts)) - 1
    return counted.withColumn(ROW_INDEX, position.cast("long")).drop(CHUNK, "_before")


def _running(df: DataFrame, keys: Sequence[str], value: Column, name: str, ts: str, layout: Layout,
             aggregate, combine) -> DataFrame:
    """``aggregate`` folds the rows of a chunk as well as the chunks; ``combine`` adds the carry."""
    staged = with_chunk(df.withColumn("_step", value), ts, layout)
    inside = aggregate("_step").over(running_in_chunk(keys, ts))
    if layout.fits_one_task:
        return staged.withColumn(name, inside).drop(CHUNK, "_step")
    carried = carry_in(staged, keys, {"_total": aggregate("_step")},
                       {"_carry": aggregate("_total").over(earlier_chunks(keys))})
    return carried.withColumn(name, combine(F.col("_carry"), inside)).drop(CHUNK, "_step", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, name: str, ts: str = "ts",
                layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Cumulative sum of ``value`` per series."""
    return _running(df, keys, value, name, ts, layout, F.sum,
                    lambda carry, inside: F.coalesce(carry, F.lit(0.0)) + inside)


def running_product(df: DataFrame, keys: Sequence[str], value: Column, name: str, ts: str = "ts",
                    layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Cumulative product of ``value`` per series."""
    return _running(df, keys, value, name, ts, layout, F.product,
                    lambda carry, inside: F.coalesce(carry, F.lit(1.0)) * inside)


def running_max(df: DataFrame, keys: Sequence[str], value: Column, name: str, ts: str = "ts",
                layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Cumulative maximum of ``value`` per series."""
    return _running(df, keys, value, name, ts, layout, F.max, F.greatest)


def previous_row(df: DataFrame, keys: Sequence[str], value: str, name: str, ts: str = "ts",
                 layout: Layout = DEFAULT_LAYOUT, skip_missing: bool = False) -> DataFrame:
    """Value of the row before, across chunk borders; NULL on the first row of a series. With ``skip_missing`` rows
    without a value are passed over."""
    earlier = (Window.unboundedPreceding, -1)
    if layout.fits_one_task:
        ordered = Window.partitionBy(*keys).orderBy(ts)
        before = F.last(value, ignorenulls=True).over(ordered.rowsBetween(*earlier)) if skip_missing else F.lag(value).over(ordered)
        return df.withColumn(name, before)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts)) if skip_missing else F.col(ts))
    carry = F.last("_last", ignorenulls=True).over(earlier_chunks(keys)) if skip_missing else \
        F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK))
    carried = carry_in(with_chunk(df, ts, layout), keys, {"_last": last}, {"_carry": carry})
    inside = in_chunk(keys, ts)
    if skip_missing:
        prior = F.coalesce(F.last(value, ignorenulls=True).over(inside.rowsBetween(*earlier)), F.col("_carry"))
    else:
        prior = F.when(F.row_number().over(inside) == 1, F.col("_carry")).otherwise(F.lag(value).over(inside))
    return carried.withColumn(name, prior).drop(CHUNK, "_carry")
