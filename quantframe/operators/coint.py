"""Engle-Granger cointegration of many pairs.

The test needs two regressions per pair. The first is an aggregate. The second, the augmented
Dickey-Fuller regression of the residuals on their own lags, only needs the cross products of its
design columns. These columns are one series of changes shifted against itself, so a product of two of
them depends on their distance alone, but for a few rows at both ends. Every row is met with the changes
before it, its products are added up by pair and distance, and the first and last residuals correct the
ends: a row gives as many products as there are lags, not their square, all of it in built-in functions.
The regressions of all lag orders are then solved from one row of sums per pair. No pair is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.columns import missing_as_null
from quantframe.operators.pairs import PAIR
from quantframe.plans.halo import drop_halo, in_block, with_halo
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.skew import join_by_key
from quantframe.plans.scan import ROW_INDEX, SERIES_ROWS, index_rows
from quantframe.session import ship_package

# Published response surfaces for two series and a constant -------------------------

# critical value = b0 + b1/T + b2/T^2 at 1, 5 and 10 percent
CRITICAL_1 = (-3.89644, -10.9519, -22.527)
CRITICAL_5 = (-3.33613, -6.1101, -6.823)
CRITICAL_10 = (-3.04445, -4.2412, -2.720)

# p value = normal cdf of a polynomial in the statistic, lowest power first
P_SPLIT, P_MIN, P_MAX = -2.62, -18.86, 0.92
P_SMALL = (2.92, 1.5012, 0.039796)
P_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)

# End of fixed values -----------------------------------------------------------------------------

COLLINEAR_R2 = 1 - 100 * math.sqrt(np.finfo(float).eps)
RESULT_SCHEMA = "adf_stat double, used_lag int"


def critical_value(coefficients: Sequence[float], rows: Column) -> Column:
    b0, b1, b2 = coefficients
    return F.lit(b0) + F.try_divide(F.lit(b1), rows) + F.try_divide(F.lit(b2), rows * rows)


def p_value(statistic: float) -> float:
    """Asymptotic p value of the statistic."""
    if statistic > P_MAX:
        return 1.0
    if statistic < P_MIN:
        return 0.0
    powers = P_SMALL if statistic <= P_SPLIT else P_LARGE
    return 0.5 * math.erfc(-sum(c * statistic ** k for k, c in enumerate(powers)) / math.sqrt(2))


def _design(residuals: np.ndarray, first: int, last: int, lags: int) -> np.ndarray:
    """Rows ``first..last`` of [change, level before, change 1 back, ..., change ``lags`` back]."""
    changes = np.diff(residuals)
    columns = [changes[first - 1: last], residuals[first - 1: last]]
    columns += [changes[first - 1 - k: last - k] for k in range(1, lags + 1)]
    return np.column_stack(columns)


def cross_products(changes: np.ndarray, levels: np.ndarray, squares: float, head: np.ndarray,
                   tail: np.ndarray) -> np.ndarray:
    """Cross products of the design columns over all rows that have ``lags`` changes before them.

    ``changes[d]`` and ``levels[d]`` sum, over all rows, the change and the residual times the change d rows back;
    ``squares`` sums the squared residuals; ``head`` and ``tail`` are the first and last ``lags + 1`` residuals. Row s
    of the sums for distance d serves design columns i and i + d in row s + i, so sums lose what lies outside.
    """
    lags = len(changes) - 1
    gram = np.empty((lags + 2, lags + 2))
    first, last = np.diff(head, prepend=np.nan), np.diff(tail, prepend=np.nan)  # changes 1..lags and the last ones
    at = np.r_[0, np.arange(2, lags + 2)]  # column of each shifted change
    for i in range(lags + 1):
        for j in range(i, lags + 1):
            d = j - i
            early = first[d + 1:lags - i + 1] @ first[1:lags - i + 1 - d]
            late = last[len(last) - i:] @ last[len(last) - i - d:len(last) - d] if i else 0.0
            gram[at[i], at[j]] = gram[at[j], at[i]] = changes[d] - early - late
    gram[1, 1] = squares - head[:lags] @ head[:lags] - tail[-1] ** 2
    for j in range(1, lags + 1):
        e = j - 1
        early = head[e + 1:lags] @ first[1:lags - e]
        gram[1, at[j]] = gram[at[j], 1] = levels[e] - early - tail[-1] * last[len(last) - 1 - e]
    # the level before a change is the level behind it less the change
    early = head[1:] @ first[1:] - first[1:] @ first[1:]
    gram[0, 1] = gram[1, 0] = levels[0] - changes[0] - early
    return gram


def _solve(gram: np.ndarray, lags: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse cross products of one regression."""
    used = slice(1, lags + 2)
    inverse = np.linalg.pinv(gram[used, used])
    beta = inverse @ gram[used, 0]
    return beta, float(gram[0, 0] - beta @ gram[used, 0]), inverse


def adf_statistic(gram: np.ndarray, head: np.ndarray, rows: int, max_lag: int) -> tuple[float, int]:
    """Statistic without constant, with the lag order of least AIC over a common sample.

    ``rows`` is the number of residuals. The chosen order is fitted again on all rows it can use: the
    common sample plus the first rows, which have fewer changes before them.
    """
    common = rows - 1 - max_lag

    def aic(lags: int) -> float:
        rest = max(_solve(gram, lags)[1], np.finfo(float).tiny)
        return common * (math.log(2 * math.pi * rest / common) + 1) + 2 * (lags + 1)

    best = min(range(max_lag + 1), key=aic)
    size = best + 2
    final = gram[:size, :size].copy()
    if best < max_lag:
        extra = _design(head, best + 1, max_lag, best)
        final += extra.T @ extra
    beta, rest, inverse = _solve(final, best)
    free = rows - 1 - best - (best + 1)
    error = math.sqrt(max(rest, 0.0) / free * inverse[0, 0]) if free > 0 else 0.0
    return (float(beta[0] / error) if error > 0 else float("nan")), best


def max_lag_of(rows: Column) -> Column:
    """Largest lag order tried for a sample of ``rows``."""
    rule = F.ceil(12 * F.pow(rows / 100, F.lit(0.25)))
    return F.least(F.floor(rows / 2) - 1, rule).cast("int")


def coint_screen(aligned: DataFrame, keys: Sequence[str] = PAIR, ts: str = "ts", a: str = "a", b: str = "b",
                 layout: Layout = DEFAULT_LAYOUT, top: int | None = None) -> DataFrame:
    """Test statistic, p value and critical values per pair: a small p value rejects "no common trend".

    ``t_stat`` is -infinity with ``collinear`` set when one series is a near-exact multiple of the
    other. Pairs of too few rows have NULLs. ``top`` keeps the most significant pairs, sorted.
    """
    groups = list(keys)
    ship_package(aligned.sparkSession)
    present = aligned.select(*groups, ts, missing_as_null(F.col(a)).alias("_a"), missing_as_null(F.col(b)).alias("_b"))
    present = present.dropna(subset=["_a", "_b"])
    y, x = F.col("_a"), F.col("_b")
    fits = present.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_obs"), F.regr_slope(y, x).alias("_slope"),
        F.regr_intercept(y, x).alias("_intercept"), F.regr_r2(y, x).alias("_r2"))
    fits = fits.withColumn("_max_lag", max_lag_of(F.col("n_obs"))).withColumn(
        "collinear", F.coalesce(F.col("_r2") >= COLLINEAR_R2, F.lit(False)))

    usable = fits.filter(F.col("_slope").isNotNull() & ~F.col("collinear") & (F.col("_max_lag") >= 0)
                         & (F.col("n_obs") - 1 - 2 * F.col("_max_lag") > 1))
    indexed = index_rows(present, groups, ts, layout)
    residual = y - F.col("_intercept") - F.col("_slope") * x
    rows = join_by_key(indexed, usable, groups, ROW_INDEX, layout=layout).select(
        *groups, ROW_INDEX, F.col("n_obs").alias(SERIES_ROWS), "_max_lag", residual.alias("residual"))
    # the longest frame is one number; it grows with the fourth root of the longest pair
    most = usable.agg(F.max("_max_lag")).first()[0] or 0
    placed = with_halo(rows, before=most + 1, layout=layout)
    by = in_block(groups)
    changed = placed.withColumn("_change", F.col("residual") - F.lag("residual").over(by))
    recent = F.slice(F.reverse(F.collect_list("_change").over(by.rowsBetween(-most, 0))), 1, F.col("_max_lag") + 1)
    own = drop_halo(changed.withColumn("_recent", recent), layout)
    # the first row of a pair has no change, and its NULL is not collected
    change, level = F.col("_change"), F.col("residual")
    cells = own.filter(change.isNotNull()).select(*groups, change, level, F.posexplode("_recent").alias("_back", "_earlier"))
    sums = cells.groupBy(*groups, "_back").agg(F.sum(change * F.col("_earlier")).alias("c"), F.sum(level * F.col("_earlier")).alias("l"))
    sums = sums.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("_back", "c", "l"))).alias("_sums"))
    place = F.struct(ROW_INDEX, "residual")
    ends = rows.groupBy(*groups).agg(
        F.first(SERIES_ROWS).alias(SERIES_ROWS), F.sum(level * level).alias("_squares"),
        F.sort_array(F.collect_list(F.when(F.col(ROW_INDEX) <= F.col("_max_lag"), place))).alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col(ROW_INDEX) >= F.col(SERIES_ROWS) - 1 - F.col("_max_lag"), place))).alias("_tail"))
    summed = ends.join(sums, groups).select(
        *groups, SERIES_ROWS, "_squares", F.col("_sums.c").alias("_changes"), F.col("_sums.l").alias("_levels"),
        F.col("_head.residual").alias("_head"), F.col("_tail.residual").alias("_tail"))

    def to_statistic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for _, row in batch.iterrows():
                changes, levels, head, tail = (np.asarray(row[c], dtype=float) for c in ("_changes", "_levels", "_head", "_tail"))
                gram = cross_products(changes, levels, row["_squares"], head, tail)
                found.append(adf_statistic(gram, head, int(row[SERIES_ROWS]), len(changes) - 1))
            yield batch[groups].assign(adf_stat=[x for x, _ in found], used_lag=np.array([k for _, k in found], dtype=np.int32))

    schema = T.StructType([summed.schema[c] for c in groups] + T.StructType.fromDDL(RESULT_SCHEMA).fields)
    tested = summed.mapInPandas(to_statistic, schema)

    probability = F.pandas_udf(lambda s: s.map(p_value, na_action="ignore").astype("float64"), "double")
    free = F.col("n_obs") - 1
    joined = fits.join(tested, groups, "left").withColumn(
        "t_stat", F.when(F.col("collinear"), F.lit(float("-inf"))).otherwise(missing_as_null(F.col("adf_stat"))))
    result = joined.withColumn("p_value", missing_as_null(probability("t_stat"))).select(
        *groups, "t_stat", "p_value", "used_lag", "n_obs", "collinear",
        F.col("_slope").alias("hedge_ratio"), critical_value(CRITICAL_1, free).alias("crit_1pct"),
        critical_value(CRITICAL_5, free).alias("crit_5pct"), critical_value(CRITICAL_10, free).alias("crit_10pct"))
    return result if top is None else result.orderBy(F.asc_nulls_last("p_value"), *groups).limit(top)
