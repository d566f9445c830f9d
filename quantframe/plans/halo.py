"""Bounded frames (rolling windows, lags, leads) over series of any length.

Rows are grouped into blocks of fixed length by row index. A row is copied into each neighbouring
block whose rows look at it, so every frame is complete inside its block; the copies (the halo) are
dropped after the window. Copies per block are at most ``before + after`` rows. A series that fits one
task is one block without copies.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantframe.functions.columns import as_column
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.scan import ROW_INDEX, index_rows

BLOCK = "_block"


def home_block(layout: Layout, index: str = ROW_INDEX) -> Column:
    if layout.fits_one_task:
        return F.lit(0).cast("long")
    return F.floor(F.col(index) / layout.block_rows)


def with_halo(df: DataFrame, before: int | Column = 0, after: int | Column = 0,
              layout: Layout = DEFAULT_LAYOUT, index: str = ROW_INDEX) -> DataFrame:
    """Place each row in its own block and in those that see it ``before`` or ``after`` rows away."""
    if layout.fits_one_task:
        return df.withColumn(BLOCK, home_block(layout, index))
    size = layout.block_rows
    first = F.greatest(F.lit(0), F.floor((F.col(index) - as_column(after)) / size))
    last = F.floor((F.col(index) + as_column(before)) / size)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def drop_halo(df: DataFrame, layout: Layout = DEFAULT_LAYOUT, index: str = ROW_INDEX,
              keep_block: bool = False) -> DataFrame:
    kept = df if layout.fits_one_task else df.filter(F.col(BLOCK) == home_block(layout, index))
    return kept if keep_block else kept.drop(BLOCK)


def in_block(keys: Sequence[str], index: str = ROW_INDEX) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(index)


def over_rows(df: DataFrame, keys: Sequence[str], ts: str, columns: Callable[[WindowSpec], Mapping[str, Column]],
              before: int = 0, after: int = 0, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add ``columns(window)``, whose frames reach at most ``before`` rows back and ``after`` ahead."""
    if layout.fits_one_task:
        return df.withColumns(dict(columns(Window.partitionBy(*keys).orderBy(ts))))
    blocks = with_halo(index_rows(df, keys, ts, layout), before, after, layout)
    added = drop_halo(blocks.withColumns(dict(columns(in_block(keys)))), layout)
    return added if ROW_INDEX in df.columns else added.drop(ROW_INDEX)
