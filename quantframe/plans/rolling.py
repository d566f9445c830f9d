"""Moments of sliding windows in time that does not depend on the window's length.

Rows are cut into segments as long as the window. A window then is the end of one segment and the beginning of the
next, so its moments are those of one row's running segment from behind and of another's from the front, merged.
Running moments cost one step per row and nothing is ever subtracted, so a calm stretch after a wild one loses no
digits. The two running frames sort the rows of a block in place; there is one shuffle, as for any keyed window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.plans.halo import BLOCK, drop_halo, in_block, with_halo
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.scan import ROW_INDEX, index_rows

SEGMENT, MOMENTS = "_segment", "_moments"
_SUMS = ("n", "mean", "square", "mean_y", "cross")


def merged_moments(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets of rows together: counts, means, sums of squared deviations and of products of
    deviations. A side without rows or NULL adds nothing."""
    def of(side: Column, name: str) -> Column:
        return F.coalesce(side[name], F.lit(0.0))

    n_a, n_b = of(a, "n"), of(b, "n")
    n = n_a + n_b
    weight = F.coalesce(F.try_divide(n_b, n), F.lit(0.0))
    gap, gap_y = of(b, "mean") - of(a, "mean"), of(b, "mean_y") - of(a, "mean_y")
    return F.struct(
        n.alias("n"), (of(a, "mean") + gap * weight).alias("mean"),
        (of(a, "square") + of(b, "square") + gap * gap * n_a * weight).alias("square"),
        (of(a, "mean_y") + gap_y * weight).alias("mean_y"),
        (of(a, "cross") + of(b, "cross") + gap * gap_y * n_a * weight).alias("cross"))


def rolling_moments(df: DataFrame, keys: Sequence[str], ts: str, window: int, x: Column, y: Column | None = None,
                    shift: int = 0, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add a struct ``_moments`` (n, mean, square, mean_y, cross) of the ``window`` rows that end ``shift`` rows before
    each row. Rows where ``x`` (or ``y``) is NULL count in no moment."""
    both = x if y is None else F.when(y.isNotNull(), x)
    staged = index_rows(df, keys, ts, layout).withColumns({
        "_x": both, "_y": F.lit(0.0) if y is None else F.when(x.isNotNull(), y)})
    back = window - 1 + shift
    placed = with_halo(staged, before=back, layout=layout).withColumn(SEGMENT, F.floor(F.col(ROW_INDEX) / window))
    inside = Window.partitionBy(*keys, BLOCK, SEGMENT)

    def running(order: Column) -> Column:
        frame = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = F.count("_x").over(frame).cast("double")
        products = F.lit(0.0) if y is None else F.covar_pop("_x", "_y").over(frame) * n
        mean_y = F.lit(0.0) if y is None else F.avg("_y").over(frame)
        return F.struct(n.alias("n"), F.avg("_x").over(frame).alias("mean"), (F.var_pop("_x").over(frame) * n).alias("square"),
                        mean_y.alias("mean_y"), products.alias("cross"))

    ran = placed.withColumns({"_front": running(F.asc(ROW_INDEX)), "_behind": running(F.desc(ROW_INDEX))})
    by = in_block(keys)
    # a window that is exactly one segment is all in front
    apart = (F.col(ROW_INDEX) - shift + 1) % window != 0
    front = F.lag("_front", shift).over(by) if shift else F.col("_front")
    met = ran.withColumns({"_front": front, "_behind": F.when(apart, F.lag("_behind", back).over(by))})
    added = drop_halo(met.withColumn(MOMENTS, merged_moments(F.col("_behind"), F.col("_front"))), layout)
    extra = ["_x", "_y", SEGMENT, "_front", "_behind", *([] if ROW_INDEX in df.columns else [ROW_INDEX])]
    return added.drop(*extra)
