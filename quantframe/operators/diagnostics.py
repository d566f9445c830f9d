"""Rank information coefficients, their decay over horizons, and returns by factor quantile."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.columns import is_finite, missing_as_null, safe_corr
from quantframe.operators.features import SERIES, check_horizons, forward_returns
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.ranks import average_ranks, ordered_counts
from quantframe.plans.skew import join_by_key
from quantframe.session import materialize

MIN_IC_ROWS = 10


def rank_ic(pairs: DataFrame, factor: str = "factor", forward: str = "fwd_ret",
            keys: Sequence[str] = SERIES, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Spearman correlation per group, with columns ``ic``, ``n_finite`` and ``n_obs``.

    Only rows finite on both sides count; under ten of them, or with a constant side, ``ic`` is
    NULL. ``n_obs`` counts the rows present on both sides, infinities included. The groups may be
    series, dates, folds or horizons; each has a row, whatever its rows hold.
    """
    groups = list(keys)
    x, y = missing_as_null(F.col(factor)), missing_as_null(F.col(forward))
    present = (x.isNotNull() & y.isNotNull()).alias("_present")
    rows = pairs.select(*groups, x.alias("_x"), y.alias("_y"), present,
                        (is_finite(x) & is_finite(y)).alias("_finite"))
    ranks = {"_x": "_rx", "_y": "_ry"}
    finite = F.col("_finite")
    sizes = [F.count(F.when(F.col("_present"), 1)).alias("n_obs"), F.count(F.when(finite, 1)).alias("n_finite")]
    if layout.fits_one_task:
        ranked = average_ranks(rows, [*groups, "_finite"], ranks, layout)
        both = (F.when(finite, F.col(r)) for r in ranks.values())
        scored = ranked.groupBy(*groups).agg(*sizes, safe_corr(*both).alias("_corr"))
    else:
        rows = materialize(rows)
        ranked = average_ranks(rows.filter(finite), groups, ranks, layout)
        scored = rows.groupBy(*groups).agg(*sizes).join(
            ranked.groupBy(*groups).agg(safe_corr(F.col("_rx"), F.col("_ry")).alias("_corr")), groups, "left")
    ic = F.when(F.col("n_finite") >= MIN_IC_ROWS, F.col("_corr"))
    return scored.select(*groups, ic.alias("ic"), "n_finite", "n_obs")


def ic_sign(ic: Column, min_abs_ic: float = 0.005) -> Column:
    return F.when(ic > min_abs_ic, 1).when(ic < -min_abs_ic, -1).otherwise(0)


def ic_direction(train_pairs: DataFrame, factor: str = "factor", forward: str = "fwd_ret",
                 min_abs_ic: float = 0.005, keys: Sequence[str] = SERIES,
                 layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Sign of the IC per group, 0 inside the dead band or without a valid IC.

    Give it training rows only; ``splits.rows_in_folds(..., split="train")`` selects them.
    """
    scored = rank_ic(train_pairs, factor, forward, keys, layout)
    return scored.select(*keys, "ic", ic_sign(F.col("ic"), min_abs_ic).alias("direction"))


def horizon_of(column: str | None) -> int | None:
    """Horizon named by a ``fwd_{h}`` column, or None."""
    prefix, _, suffix = (column or "").partition("_")
    try:
        return int(suffix) if prefix == "fwd" else None
    except ValueError:
        return None


def _returns_of(prices: DataFrame | None, forward_ret: DataFrame | None, horizons: Iterable[int] | None,
                columns: Sequence[str] | None, keys: Sequence[str], ts: str, value: str,
                layout: Layout) -> tuple[DataFrame, dict[str, int]]:
    """The table of forward returns and the horizon of each column to read, from prices or as given.

    Given returns are read in ``columns`` (all but keys and time by default), or in those that the
    horizons name when no columns are asked for.
    """
    if sum(x is not None for x in (prices, forward_ret)) != 1:
        raise ValueError("exactly one of prices and forward_ret is needed")
    if prices is not None:
        wanted = {f"fwd_{h}": h for h in check_horizons(horizons)}
        return forward_returns(prices, wanted.values(), keys, ts, value, layout), wanted
    if columns is None and horizons is not None:
        wanted = {f"fwd_{h}": h for h in check_horizons(horizons)}
    else:
        names = columns or [c for c in forward_ret.columns if c not in (*keys, ts)]
        given = check_horizons(horizons) if horizons is not None else map(horizon_of, names)
        wanted = dict(zip(names, given, strict=True))
    unnamed = sorted(c for c, h in wanted.items() if h is None)
    if unnamed:
        raise ValueError(f"cannot infer horizon of {unnamed}: give horizons, or names such as fwd_5")
    if not wanted.keys() <= {*forward_ret.columns}:
        raise ValueError(f"missing requested columns {sorted(wanted.keys() - {*forward_ret.columns})} in forward_ret")
    return forward_ret, wanted


def _factor_rows(factor: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return factor.select(*keys, ts, missing_as_null(F.col(value)).alias("factor"))


def ic_decay(factor: DataFrame, horizons: Iterable[int] | None = None,
             prices: DataFrame | None = None, forward_ret: DataFrame | None = None,
             keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value",
             layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """IC per series and horizon: columns ``horizon, column, ic, n_obs`` after the keys.

    ``n_obs`` counts rows where both sides are present, infinities included; the IC itself uses
    the finite ones. Ranks are taken after each horizon's own rows are dropped.
    """
    returns, columns = _returns_of(prices, forward_ret, horizons, None, keys, ts, value, layout)
    wide = returns.select(*keys, ts, *(F.col(c).cast("double").alias(c) for c in columns))
    joined = _factor_rows(factor, keys, ts, value).join(wide, [*keys, ts])
    pairs = joined.unpivot([*keys, "factor"], list(columns), "column", "fwd_ret")
    scored = rank_ic(pairs, "factor", "fwd_ret", [*keys, "column"], layout)
    horizon = F.split_part(F.col("column"), F.lit("_"), F.lit(2)).cast("int")
    return scored.select(
        *keys, horizon.alias("horizon"), "column", "ic", "n_obs")


def _edge_fractions(n_quantiles: int) -> list[float]:
    """Evenly spaced fractions, taken through percent as array quantile routines do; the last bit
    of a fraction decides which side of an edge a tied value falls on."""
    return [float(q) for q in np.linspace(0, 1, n_quantiles + 1) * 100 / 100]


def quantile_edges(rows: DataFrame, keys: Sequence[str], value: str, n_quantiles: int,
                   layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Exact linearly interpolated quantile edges per group, with ``total`` and ``distinct_total``.

    The order statistics are looked up in the counts of distinct values, so no group is gathered.
    """
    counts = ordered_counts(rows, keys, value, layout)
    fractions = F.array(*(F.lit(q) for q in _edge_fractions(n_quantiles)))
    last = F.col("total") - 1
    spots = F.transform(fractions, lambda q: q * last)
    wanted = F.array_distinct(F.flatten(F.transform(
        spots, lambda p: F.array(F.floor(p), F.least(F.floor(p) + 1, last)))))
    here = F.filter(wanted, lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n")))
    picked = counts.withColumn("_at", F.explode(here)).groupBy(*keys, "total", "distinct_total").agg(
        F.map_from_entries(F.collect_list(F.struct("_at", value))).alias("_stat"))

    def edge(spot: Column) -> Column:
        low = F.col("_stat")[F.floor(spot)]
        high = F.col("_stat")[F.least(F.floor(spot) + 1, last)]
        part = spot - F.floor(spot)
        return F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))

    return picked.select(*keys, "total", "distinct_total", F.transform(spots, edge).alias("edges"))


def quantile_returns(factor: DataFrame, n_quantiles: int = 5, horizon: int | None = None,
                     prices: DataFrame | None = None, forward_ret: DataFrame | None = None,
                     forward_column: str | None = None, keys: Sequence[str] = SERIES,
                     ts: str = "ts", value: str = "value", strict: bool = False,
                     layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Mean forward return and row count per factor quantile and series.

    A series that cannot be cut has one row with NULL quantile and a ``status`` other than ``ok``:
    ``too_few_rows``, ``too_few_values`` or ``duplicate_edges``. ``strict`` raises instead.
    """
    if n_quantiles < 2:
        raise ValueError(f"a split needs at least 2 quantiles, got {n_quantiles}")
    if forward_ret is None and prices is not None and horizon is None:
        raise ValueError("with prices, the horizon must be provided")
    columns = None if forward_ret is None else [forward_column] if forward_column else [
        c for c in forward_ret.columns if c not in (*keys, ts)]
    if prices is None and columns is not None and len(columns) != 1:
        raise ValueError(f"name the one return column to use among {columns}")
    returns, found = _returns_of(prices, forward_ret, None if horizon is None else [horizon], columns, keys, ts, value, layout)
    (column, horizon), = found.items()

    series = factor.select(*keys).distinct()
    forward = returns.select(*keys, ts, missing_as_null(F.col(column)).alias("fwd_ret"))
    rows = _factor_rows(factor, keys, ts, value).join(forward, [*keys, ts]).dropna(
        subset=["factor", "fwd_ret"])
    if not layout.fits_one_task:
        rows = materialize(rows)
    edges = quantile_edges(rows, keys, "factor", n_quantiles, layout)
    status = (
        F.when(F.coalesce(F.col("total"), F.lit(0)) < n_quantiles, "too_few_rows")
        .when(F.col("distinct_total") < n_quantiles, "too_few_values")
        .when(F.size(F.array_distinct("edges")) <= n_quantiles, "duplicate_edges")
        .otherwise("ok"))
    checked = series.join(edges, list(keys), "left").select(*keys, "edges", status.alias("status"))
    if strict:
        message = F.concat(F.lit("quantile_returns: "), F.col("status"))
        checked = checked.withColumn("status", F.when(F.col("status") == "ok", F.col("status"))
                                     .otherwise(F.raise_error(message)))
    interior = F.slice("edges", 2, n_quantiles - 1)
    bucket = 1 + F.size(F.filter(interior, lambda e: e < F.col("factor")))
    usable = checked.filter(F.col("status") == "ok").select(*keys, "edges")
    buckets = join_by_key(rows, usable, keys, ts, layout=layout).groupBy(*keys, bucket.alias("quantile")).agg(
        F.avg("fwd_ret").alias("mean_return"), F.count(F.lit(1)).alias("count"))
    return checked.select(*keys, "status").join(buckets, list(keys), "left").select(
        *keys, F.lit(horizon).alias("horizon"), "quantile", "mean_return", "count", "status")
