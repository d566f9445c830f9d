"""How one long series is cut into bounded pieces, and when it does not have to be.

A window keyed by series alone sorts a whole series in one task. That is the cheapest plan while every
series is known to fit, and no plan at all when one series holds a third of all rows. ``measure_layout``
counts the longest series with one small aggregate. Up to ``task_rows`` operators use plain keyed
windows; beyond it, or when nothing was measured, they key their windows by (series, piece):

* ``chunk``: a span of time between two cuts of a table, or of a fixed number of calendar hours without one;
* ``block``: a fixed number of rows, a pure function of the row index inside the series.

Cuts are placed by counts: no series has more than ``block_rows`` rows between two of them, whether they lie
hours or milliseconds apart. They depend on time alone, so they hold for every table derived from the panel.
Pieces are deterministic, so a task that is run again after a lost executor builds the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.session import materialize

HOUR_MICROS, SECOND_MICROS = 3_600_000_000, 1_000_000


@dataclass(frozen=True)
class Cuts:
    """``table`` has, per hour between the first and the last measured one, the chunk it starts in and the moments
    inside it where the next ones start."""

    table: DataFrame
    first_hour: int
    last_chunk: int


@dataclass(frozen=True)
class Layout:
    """``longest_series`` is the measured row count of the longest series, None if unknown."""

    chunk_hours: int = 90 * 24
    block_rows: int = 65_536
    longest_series: int | None = None
    task_rows: int = 1_000_000
    cuts: Cuts | None = field(default=None, compare=False)

    @property
    def fits_one_task(self) -> bool:
        return self.longest_series is not None and self.longest_series <= self.task_rows


DEFAULT_LAYOUT = Layout()


def hours_since_epoch(ts: Column) -> Column:
    return F.datediff(ts, F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def _is_integer(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def chunk_of(df: DataFrame, ts: str, layout: Layout) -> Column:
    """Chunk number of a row. An integer order column is cut by value instead of by hours."""
    if layout.fits_one_task:
        return F.lit(0).cast("long")
    if _is_integer(df, ts):
        return F.floor(F.col(ts) / layout.block_rows)
    return F.floor(hours_since_epoch(F.col(ts)) / layout.chunk_hours)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_chunk_column(df: DataFrame, ts: str, layout: Layout, name: str) -> DataFrame:
    """``df`` with the chunk of each row. Rows before or behind what was measured have chunks of their own."""
    if layout.cuts is None or layout.fits_one_task or _is_integer(df, ts):
        return df.withColumn(name, chunk_of(df, ts, layout))
    cuts = layout.cuts
    outside = F.when(F.col("_hour") < cuts.first_hour, F.lit(-1)).otherwise(F.lit(cuts.last_chunk + 1))
    passed = F.size(F.filter("_starts", lambda start: start <= micros(F.col(ts))))
    joined = df.withColumn("_hour", hours_since_epoch(F.col(ts))).join(cuts.table, "_hour", "left")
    return joined.withColumn(name, F.coalesce(F.col("_first") + passed, outside).cast("long")).drop("_hour", "_first", "_starts")


def _most_rows(panel: DataFrame, keys: Sequence[str], start: Column, most: int | None) -> DataFrame:
    """(start, n): per piece of time the largest number of rows that a series has in it."""
    counts = panel.groupBy(*keys, start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    n = F.max("n") if most is None else F.least(F.max("n"), F.lit(most))
    return counts.groupBy("start").agg(n.alias("n"))


def place_cuts(panel: DataFrame, keys: Sequence[str], ts: str, hours: DataFrame, block_rows: int,
               most_per_second: int | None = None) -> Cuts:
    """Cuts between which no series has more than ``block_rows`` rows.

    ``hours`` has (start, n) per hour. An hour with too many rows is counted again by seconds, and a second with too
    many by spans of as many microseconds as rows are allowed. The table has a row per hour and a number per
    cut inside an hour; the sums run over days first, then inside a day.
    """
    half = max(1, block_rows // 2)
    wide = hours.filter(F.col("n") <= half)
    dense = materialize(hours.filter(F.col("n") > half).select(F.col("start").alias("_dense")), "dense_hours")
    inside = panel.withColumn("_dense", _hour_start(F.col(ts))).join(dense, "_dense")
    seconds = materialize(_most_rows(inside, keys, F.floor(micros(F.col(ts)) / SECOND_MICROS) * SECOND_MICROS, most_per_second), "seconds")
    crowded = materialize(seconds.filter(F.col("n") > half).select(F.col("start").alias("_second")), "crowded_seconds")
    span = min(half, SECOND_MICROS)
    at = micros(F.col(ts))
    inside = inside.withColumn("_second", F.floor(at / SECOND_MICROS) * SECOND_MICROS).join(crowded, "_second")
    narrow = _most_rows(inside, keys, F.floor(at / span) * span, None)
    pieces = wide.unionByName(seconds.filter(F.col("n") <= half)).unionByName(narrow)
    pieces = pieces.select(F.col("start").cast("long").alias("start"), "n", F.floor(F.col("start") / (24 * HOUR_MICROS)).alias("day"))
    earlier = (Window.unboundedPreceding, -1)
    days = pieces.groupBy("day").agg(F.sum("n").alias("total"))
    days = days.select("day", F.coalesce(F.sum("total").over(Window.orderBy("day").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("start").rowsBetween(*earlier)), F.lit(0))
    placed = pieces.withColumn("within", within).join(days, "day").withColumn(
        "chunk", F.floor((F.col("before") + F.col("within")) / half)).withColumn("hour", F.floor(F.col("start") / HOUR_MICROS))
    changed = F.col("chunk") != F.lag("chunk").over(Window.partitionBy("hour").orderBy("start"))
    by_hour = placed.withColumn("changed", changed).groupBy("hour").agg(
        F.min("chunk").alias("first"), F.max("chunk").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("changed"), F.col("start")))).alias("starts"))
    by_hour = materialize(by_hour, "cut_hours")
    # hours without rows belong to the chunk before
    until = F.coalesce(F.lead("hour").over(Window.orderBy("hour")) - 1, F.col("hour"))
    filled = by_hour.withColumn("until", until).withColumn("each", F.explode(F.sequence("hour", "until")))
    own = F.col("each") == F.col("hour")
    table = materialize(filled.select(
        F.col("each").alias("_hour"), F.when(own, F.col("first")).otherwise(F.col("last")).alias("_first"),
        F.when(own, F.col("starts")).otherwise(F.array().cast("array<bigint>")).alias("_starts")), "cuts")
    span = by_hour.agg(F.min("hour"), F.max("last")).first()
    return Cuts(table, int(span[0] or 0), int(span[1] or 0))


def _hour_start(ts: Column) -> Column:
    return hours_since_epoch(ts).cast("long") * HOUR_MICROS


def measure_layout(panel: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts",
                   bar_hours: float | None = None, task_rows: int = Layout.task_rows) -> Layout:
    """Layout for a panel, and for whatever is derived from it without adding rows to a series.

    One aggregate of count, first and last hour per key, combined map-side, of which one number reaches
    the driver. ``bar_hours`` states the width of the panel's time grid; a series is then no longer than
    its span in bars, so the rows a panel is built from may be measured instead of the panel. If a
    series is too long for one task, a second aggregate places the cuts between chunks.
    """
    dated = not _is_integer(panel, ts)
    hour = hours_since_epoch(F.col(ts)) if dated else F.lit(0)
    rows = F.count(F.lit(1))
    if dated and bar_hours is not None:
        rows = F.least(rows, F.floor((F.max(hour) - F.min(hour) + 1) / bar_hours) + 1)
    longest = panel.groupBy(*keys).agg(rows.alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    layout = Layout(longest_series=longest, task_rows=task_rows, block_rows=min(Layout.block_rows, task_rows))
    if layout.fits_one_task or not dated:
        return layout
    per_hour = None if bar_hours is None else max(1, round(1 / bar_hours))
    hours = materialize(_most_rows(panel, keys, _hour_start(F.col(ts)), per_hour), "hours")
    densest = hours.agg(F.max("n")).first()[0]
    per_second = None if per_hour is None else max(1, round(per_hour / 3600))
    cuts = place_cuts(panel, keys, ts, hours, layout.block_rows, per_second)
    return replace(layout, chunk_hours=max(1, task_rows // densest), cuts=cuts)
