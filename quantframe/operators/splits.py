"""Walk-forward folds and the selection of rows by fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.columns import finite_or_null
from quantframe.functions.signals import zscore_fixed
from quantframe.operators.features import SERIES
from quantframe.plans.intervals import DAY, join_ranges
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.rolling import merged_moments
from quantframe.plans.skew import join_by_key
from quantframe.session import materialize

MIN_TRAIN_DATES = 10
MIN_TEST_DATES = 5
DAY_MICROS = 86_400_000_000
FOLD_COLUMNS = ("fold_idx", "train_start", "train_end", "test_start", "test_end")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _floor_div(number: Column, divisor: int) -> Column:
    """Exact floor division of longs, negative numbers included."""
    return ((number - F.pmod(number, F.lit(divisor))) / divisor).cast("long")


def _ceil_div(number: Column, divisor: int) -> Column:
    return -_floor_div(-number, divisor)


def walk_forward_splits(panel: DataFrame, train_days: int, test_days: int, embargo_days: int = 0,
                        step_days: int | None = None, ts: str = "ts", keys: Sequence[str] = (),
                        strict: bool = True) -> DataFrame:
    """Folds over the distinct dates of the panel (or of each group of ``keys``).

    Periods are calendar days from the first date; a period's bounds are then moved to dates that
    exist. A candidate with under 10 training or 5 test dates is left out and takes no number. On
    intraday data a period keeps the first date's time of day, so its last day is cut there.

    Each date names the candidates it belongs to by arithmetic, so no join of dates with candidates
    is needed. A span shorter than one fold raises when the plan runs; ``strict=False`` gives no folds.
    """
    step = test_days if step_days is None else step_days
    if min(train_days, test_days, step) <= 0 or embargo_days < 0:
        raise ValueError("train_days, test_days and step_days must be positive, embargo_days not negative")
    group = [*keys]
    dates = panel.select(*group, F.col(ts).alias("_date")).dropna(subset=["_date"]).distinct()
    bounds = [F.min(ts).alias("_first"), F.max(ts).alias("_last")]
    if group:
        spanned = dates.join(panel.groupBy(*group).agg(*bounds), group)
    else:
        edge = panel.agg(F.struct(*bounds)).scalar()
        spanned = dates.select("_date", edge["_first"].alias("_first"), edge["_last"].alias("_last"))

    need = train_days + embargo_days + test_days
    reach = _micros(F.col("_last")) - _micros(F.col("_first"))
    span = _floor_div(reach, DAY_MICROS)
    if strict:
        message = F.format_string(
            f"one fold takes {train_days} + {embargo_days} + {test_days} days of training, embargo and test: "
            f"need at least {need}, the dates cover %d", span + 1)
        spanned = spanned.filter(F.when(span + 1 >= need, True).otherwise(
            F.raise_error(message).cast("boolean")))

    offset = _micros(F.col("_date")) - _micros(F.col("_first"))
    step_micros = step * DAY_MICROS
    last_candidate = _floor_div(reach - (need - 1) * DAY_MICROS, step_micros)

    def candidates(period_start: int, period_days: int) -> Column:
        """Numbers k with period start <= date - first - k*step <= period start + days - 1."""
        low = _ceil_div(offset - (period_start + period_days - 1) * DAY_MICROS, step_micros)
        high = _floor_div(offset - period_start * DAY_MICROS, step_micros)
        low, high = F.greatest(low, F.lit(0)), F.least(high, last_candidate)
        return F.when(low <= high, F.sequence(low, high))

    def listed(name: str, period_start: int, period_days: int) -> DataFrame:
        numbered = F.explode(candidates(period_start, period_days)).alias("_k")
        return spanned.select(*group, "_date", numbered).withColumn("_part", F.lit(name))

    placed = listed("train", 0, train_days).unionByName(
        listed("test", train_days + embargo_days, test_days))

    def part(name: str) -> Column:
        return F.when(F.col("_part") == name, F.col("_date"))

    folds = placed.groupBy(*group, "_k").agg(
        F.count(part("train")).alias("_train"), F.count(part("test")).alias("_test"),
        F.min(part("train")).alias("train_start"), F.max(part("train")).alias("train_end"),
        F.min(part("test")).alias("test_start"), F.max(part("test")).alias("test_end"),
    ).filter((F.col("_train") >= MIN_TRAIN_DATES) & (F.col("_test") >= MIN_TEST_DATES))
    # one row per fold: at most (calendar span / step) rows reach this window
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_k")
    return folds.withColumn("fold_idx", F.row_number().over(order) - 1).select(*group, *FOLD_COLUMNS)


def _check_split(split: str) -> None:
    if split not in ("train", "test"):
        raise ValueError(f"no split is named {split!r}: use train or test")


def select_dates(data: DataFrame, fold, split: str = "train", ts: str = "ts") -> DataFrame:
    """Rows inside one fold's period, ends included. ``fold`` is a Row or mapping with the bounds."""
    _check_split(split)
    return data.filter(F.col(ts).between(F.lit(fold[f"{split}_start"]), F.lit(fold[f"{split}_end"])))


def rows_in_folds(data: DataFrame, folds: DataFrame, split: str | None = None, ts: str = "ts",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Rows of every fold at once, with ``fold_idx`` and ``split``; both splits unless one is named."""
    names = ["train", "test"]
    if split is not None:
        _check_split(split)
        names = [split]
    periods = F.explode(F.array(*(
        F.struct(F.lit(n).alias("split"), F.col(f"{n}_start").alias("_start"), F.col(f"{n}_end").alias("_end"))
        for n in names))).alias("_period")
    ranges = folds.select(*keys, "fold_idx", periods).select(*keys, "fold_idx", "_period.*")
    joined = join_ranges(data, ranges, "_start", "_end", ts, keys)
    return joined.select(*data.columns, "fold_idx", "split")


def zscore_by_fold(panel: DataFrame, folds: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts",
                   value: str = "value", name: str = "zscore",
                   fold_keys: Sequence[str] = (), layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Test rows scored with the mean and deviation of their own fold's training rows.

    Training rows are summed once, per series and day, and the days' moments are merged per fold, so an overlap of
    folds multiplies days and not rows. Of a day that a fold's training period cuts, the rows inside it are summed
    for that fold.
    """
    grouped = [*keys, "fold_idx"]
    number = finite_or_null(F.col(value))
    train = fold_moments(panel, folds, keys, ts, number, fold_keys)
    mean, deviation = F.col("_m")["mean"], F.sqrt(F.try_divide(F.col("_m")["square"], F.col("_m")["n"] - 1))
    known = F.col("_m")["n"] > 0
    train = train.select(*grouped, F.when(known, mean).alias("_mu"), deviation.alias("_sd"))
    test = rows_in_folds(panel, folds, "test", ts, fold_keys)
    scored = join_by_key(test, train, grouped, ts, "left", layout)
    return scored.withColumn(name, zscore_fixed(F.col(value), F.col("_mu"), F.col("_sd"))).select(
        *test.columns, name)


def fold_moments(panel: DataFrame, folds: DataFrame, keys: Sequence[str], ts: str, number: Column,
                 fold_keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold_idx, _m): count, mean and sum of squared deviations of ``number`` over each fold's training rows."""
    by = [*keys, *(k for k in fold_keys if k not in keys)]
    moments = (F.count("_x").cast("double").alias("n"), F.avg("_x").alias("mean"),
               (F.var_pop("_x") * F.count("_x")).alias("square"))
    dated = panel.select(*by, F.col(ts).alias("_ts"), number.alias("_x"), F.to_date(ts).alias(DAY))
    days = materialize(dated.groupBy(*by, DAY).agg(*moments, F.min("_ts").alias("_from"), F.max("_ts").alias("_to")), "days")
    periods = folds.select(*fold_keys, "fold_idx", "train_start", "train_end").withColumn(
        DAY, F.explode(F.sequence(F.to_date("train_start"), F.to_date("train_end"))))
    met = days.join(periods, [*fold_keys, DAY]).filter("_to >= train_start AND _from <= train_end")
    whole = (F.col("_from") >= F.col("train_start")) & (F.col("_to") <= F.col("train_end"))
    cut = materialize(met.filter(~whole).select(*by, DAY, "fold_idx", "train_start", "train_end"), "cut_days")
    inside = dated.join(cut, [*by, DAY]).filter(F.col("_ts").between(F.col("train_start"), F.col("train_end")))
    parts = met.filter(whole).select(*by, "fold_idx", DAY, "n", "mean", "square").union(
        inside.groupBy(*by, "fold_idx", DAY).agg(*moments).select(*by, "fold_idx", DAY, "n", "mean", "square"))
    state = F.struct("n", "mean", "square", F.lit(0.0).alias("mean_y"), F.lit(0.0).alias("cross"))
    none = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "mean", "square", "mean_y", "cross")))
    listed = F.sort_array(F.collect_list(F.struct(DAY, state.alias("m"))))
    return parts.groupBy(*by, "fold_idx").agg(listed.alias("_days")).select(
        *keys, "fold_idx", F.aggregate("_days", none, lambda done, d: merged_moments(done, d["m"])).alias("_m"))
