"""What is stored, what is missing, and from where to continue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.columns import as_column

BAR_MINUTES = 15
TAIL_DAYS_WHEN_EMPTY = 2


def _minutes(count: int) -> Column:
    return F.make_dt_interval(mins=F.lit(count))


def _days(count: int) -> Column:
    return F.make_dt_interval(days=F.lit(count))


def coverage_summary(df: DataFrame, keys: Sequence[str] = ("symbol",), expected: DataFrame | None = None,
                     ts: str | None = "ts") -> DataFrame:
    """``rows, start, end`` per key. Keys listed in ``expected`` without data show 0 rows.

    Undated records (``ts=None``) have no start or end.
    """
    first, last = (F.min(ts), F.max(ts)) if ts else (F.lit(None).cast("timestamp"),) * 2
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), first.alias("start"), last.alias("end"))
    if expected is None:
        return found
    listed = expected.select(*keys).distinct()
    return listed.join(found, list(keys), "full").withColumn("rows", F.coalesce("rows", F.lit(0)))


def roll_up_manifest(summary: DataFrame, by: Sequence[str] = ("interval", "endpoint")) -> DataFrame:
    """Total rows and outer bounds per group, sorted; groups with NULL keys are kept."""
    return summary.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.min("start").alias("earliest_start"),
        F.max("end").alias("latest_end")).orderBy(*by)


def available(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("rows") > 0)


def period_grid(symbols: DataFrame, start: Column, end: Column, unit: str,
                bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Every month or day from ``start`` to ``end`` for each symbol: ``period_start`` and
    ``period_end``, the times of its first and last bar, and ``expected`` bars.

    Periods are generated per symbol row, not joined.
    """
    if unit not in ("month", "day"):
        raise ValueError(f"unit must be 'month' or 'day', got {unit!r}")
    step = F.make_ym_interval(months=F.lit(1)) if unit == "month" else _days(1)
    first, last = F.date_trunc(unit, start), F.date_trunc(unit, end)
    starts = F.when(first <= last, F.sequence(first, last, step))
    grid = symbols.select("symbol", F.explode(starts).alias("period_start"))
    following = F.col("period_start") + step
    spans = F.unix_seconds(following) - F.unix_seconds("period_start")
    return grid.select(
        "symbol", F.lit(unit).alias("unit"), "period_start",
        (following - _minutes(bar_minutes)).alias("period_end"),
        (spans / (60 * bar_minutes)).cast("long").alias("expected"))


def missing_periods(bars: DataFrame, grid: DataFrame, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Periods of the grid that hold fewer bars than expected, with ``present``.

    One pass counts bars per symbol and day, for the day's and for the month's end; months are sums of
    days, and only the counts are joined. ``bar_minutes`` is the width that the grid was made with.
    """
    stamp = F.col("ts").cast("timestamp")
    day, month = F.date_trunc("day", stamp), F.date_trunc("month", stamp)
    in_day = stamp <= day + _days(1) - _minutes(bar_minutes)
    in_month = stamp <= month + F.make_ym_interval(months=F.lit(1)) - _minutes(bar_minutes)
    days = bars.groupBy("symbol", day.alias("period_start")).agg(
        F.count_if(in_day).alias("present"), F.count_if(in_month).alias("of_month"))
    months = days.groupBy("symbol", F.date_trunc("month", "period_start").alias("period_start")).agg(
        F.sum("of_month").alias("present"))
    counts = days.select("symbol", F.lit("day").alias("unit"), "period_start", "present").unionByName(
        months.select("symbol", F.lit("month").alias("unit"), "period_start", "present"))
    joined = grid.join(counts, ["symbol", "unit", "period_start"], "left")
    filled = joined.withColumn("present", F.coalesce("present", F.lit(0)))
    return filled.filter(F.col("present") < F.col("expected")).select(
        "symbol", "unit", "period_start", "period_end", "expected", "present")


def history_gaps(bars: DataFrame, symbols: DataFrame, history_start, as_of,
                 bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Incomplete periods up to the day before ``as_of``: whole months before that day's month, and the
    single days of that month."""
    begin, now = as_column(history_start).cast("timestamp"), as_column(as_of).cast("timestamp")
    last_day = F.date_trunc("day", now) - _days(1)
    month = F.date_trunc("month", last_day)
    before = month - _days(1)
    months = period_grid(symbols, begin, before, "month", bar_minutes).filter(begin <= before)
    days = period_grid(symbols, month, last_day, "day", bar_minutes).filter(F.date_trunc("day", begin) <= last_day)
    return missing_periods(bars, months.unionByName(days), bar_minutes)


def fetch_watermark(bars: DataFrame, symbols: DataFrame, as_of, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Next span to load per symbol: ``from_ts`` after the last stored bar, or two days back without
    any, to ``to_ts``, the bar grid time at or before ``as_of``. Symbols that are up to date are left out."""
    now = as_column(as_of).cast("timestamp")
    seconds = F.unix_seconds(now)
    floor = F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * bar_minutes)))
    stored = bars.groupBy("symbol").agg(F.max(F.col("ts").cast("timestamp")).alias("last_ts"))
    plan = symbols.select("symbol").distinct().join(stored, "symbol", "left").select(
        "symbol", "last_ts",
        F.coalesce(F.col("last_ts") + _minutes(bar_minutes), floor - _days(TAIL_DAYS_WHEN_EMPTY)).alias("from_ts"),
        floor.alias("to_ts"))
    return plan.filter(F.col("from_ts") <= F.col("to_ts"))
