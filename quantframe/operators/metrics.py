"""Return metrics per series, annualised by holding period.

Results carry what a warning would say as columns: ``n_obs``, ``small_sample_warning``,
``lag1_autocorr``, ``overlap_warning`` and, where a curve can be invalid, ``status``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.columns import INF, finite_or_null, is_finite, missing_as_null, safe_corr
from quantframe.operators.features import SERIES
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.scan import CHUNK, earlier_chunks, previous_row, running_in_chunk, with_chunk

MIN_DEVIATION = 1e-14
MIN_ROWS = 20
OVERLAP_CORRELATION = 0.3


def period_risk_free(risk_free: float, holding_days: int, trading_days_per_year: int) -> float:
    return (1 + risk_free) ** (holding_days / trading_days_per_year) - 1


def sharpe_agg(returns: Column, holding_days: int | Column = 1, trading_days_per_year: int = 365,
               risk_free_per_period: float = 0.0) -> Column:
    """Annualised Sharpe ratio as an aggregate; NULL under two rows or without dispersion."""
    excess = finite_or_null(returns) - risk_free_per_period
    deviation = F.stddev_samp(excess)
    yearly = F.sqrt(F.lit(float(trading_days_per_year)) / holding_days)
    return F.when(deviation >= MIN_DEVIATION, F.try_divide(F.avg(excess), deviation) * yearly)


def sortino_agg(returns: Column, holding_days: int | Column = 1, trading_days_per_year: int = 365,
                risk_free_per_period: float = 0.0) -> Column:
    """Annualised Sortino ratio as an aggregate, with the downside averaged over all periods."""
    excess = finite_or_null(returns) - risk_free_per_period
    squares = F.pow(F.least(excess, F.lit(0.0)), 2)
    deviation = F.sqrt(F.avg(F.when(excess.isNotNull(), squares)))
    yearly = F.sqrt(F.lit(float(trading_days_per_year)) / holding_days)
    scaled = F.when(deviation >= MIN_DEVIATION, F.try_divide(F.avg(excess), deviation) * yearly)
    downside = F.max(F.when(excess.isNotNull(), squares)) > 0
    return F.when(F.count(excess) >= 2, F.when(downside, scaled).otherwise(F.lit(INF)))


def win_rate_agg(returns: Column) -> Column:
    number = finite_or_null(returns)
    return F.avg(F.when(number > 0, 1.0).when(number < 0, 0.0))


def profit_factor_agg(returns: Column) -> Column:
    number = finite_or_null(returns)
    gains = F.coalesce(F.sum(F.when(number > 0, number)), F.lit(0.0))
    losses = F.coalesce(F.sum(F.when(number < 0, -number)), F.lit(0.0))
    return F.when(losses > 0, F.try_divide(gains, losses)).when(gains > 0, F.lit(INF))


def _sized(returns: Column) -> list[Column]:
    n = F.count(finite_or_null(returns))
    return [n.alias("n_obs"), (n < MIN_ROWS).alias("small_sample_warning")]


def sharpe(returns: DataFrame, holding_days: int = 1, trading_days_per_year: int = 365,
           risk_free: float = 0.0, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    rate = period_risk_free(risk_free, holding_days, trading_days_per_year)
    ratio = sharpe_agg(F.col(value), holding_days, trading_days_per_year, rate)
    return returns.groupBy(*keys).agg(ratio.alias("sharpe"), *_sized(F.col(value)))


def sortino(returns: DataFrame, holding_days: int = 1, trading_days_per_year: int = 365,
            risk_free: float = 0.0, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    rate = period_risk_free(risk_free, holding_days, trading_days_per_year)
    ratio = sortino_agg(F.col(value), holding_days, trading_days_per_year, rate)
    return returns.groupBy(*keys).agg(ratio.alias("sortino"), *_sized(F.col(value)))


def win_rate(returns: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    return returns.groupBy(*keys).agg(win_rate_agg(F.col(value)).alias("win_rate"))


def profit_factor(returns: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    return returns.groupBy(*keys).agg(profit_factor_agg(F.col(value)).alias("profit_factor"))


def metric_flags(returns: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts",
                 value: str = "value", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Sample size and lag-1 autocorrelation, the two signs that a Sharpe ratio is not to be trusted."""
    valid = returns.select(*keys, ts, finite_or_null(F.col(value)).alias("_r"))
    lagged = previous_row(valid, keys, "_r", "_before", ts, layout, skip_missing=True)
    both = F.col("_r").isNotNull() & F.col("_before").isNotNull()
    # rows without a value keep their series in the result and count in no sum
    groups = lagged.groupBy(*keys).agg(
        F.count("_r").alias("_n"),
        safe_corr(F.when(both, F.col("_before")), F.when(both, F.col("_r"))).alias("_corr"))
    n = F.col("_n")
    correlation = F.when(n >= MIN_ROWS, F.col("_corr"))
    return groups.select(
        *keys, n.alias("n_obs"), (n < MIN_ROWS).alias("small_sample_warning"),
        correlation.alias("lag1_autocorr"),
        F.coalesce(F.abs(correlation) > OVERLAP_CORRELATION, F.lit(False)).alias("overlap_warning"))


def _drawdown_table(rows: DataFrame, keys: Sequence[str], ts: str, level: Column,
                    compounded: bool, layout: Layout, skip_missing: bool = False) -> DataFrame:
    """One row per chunk: the depth reached inside it and what later chunks need to know.

    ``level`` is an equity curve, or a growth factor per row when ``compounded``. Depth is relative,
    so a compounded curve may start each chunk from 1 and be scaled by the product of earlier chunks
    afterwards; only chunk rows take part in that second step. With ``skip_missing`` rows without a level change
    nothing, but keep their series in the table.
    """
    def counted(column: Column) -> Column:
        return F.when(F.col("_level").isNotNull(), column) if skip_missing else column

    running = running_in_chunk(keys, ts)
    curve = with_chunk(rows.withColumn("_level", level), ts, layout)
    path = F.product("_level").over(running) if compounded else F.col("_level")
    curve = curve.withColumn("_path", path).withColumn("_peak", F.max("_path").over(running))
    depth = F.try_divide(F.col("_path") - F.col("_peak"), F.col("_peak"))
    chunks = curve.groupBy(*keys, CHUNK).agg(
        F.count(counted(F.lit(1))).alias("_n"), F.min(depth).alias("_depth"),
        F.max("_path").alias("_high"), F.min("_path").alias("_low"),
        F.product("_level").alias("_growth"),
        F.max(counted(F.coalesce(~is_finite(F.col("_path")), F.lit(True)))).alias("_not_finite"),
        F.max(counted(F.coalesce(F.col("_level") <= 0, F.lit(True)))).alias("_not_positive"))
    earlier = earlier_chunks(keys)
    scale = F.coalesce(F.product("_growth").over(earlier), F.lit(1.0)) if compounded else F.lit(1.0)
    scaled = chunks.withColumn("_scale", scale).withColumn("_top", F.col("_scale") * F.col("_high"))
    before = F.max("_top").over(earlier)
    bottom = F.col("_scale") * F.col("_low")
    from_before = F.try_divide(bottom - before, before)
    # what matters is the whole curve: it may overflow or vanish where no chunk of it does
    any_rows = F.col("_n") > 0
    return scaled.withColumns({
        "_depth": F.least(F.col("_depth"), from_before),
        "_not_finite": any_rows & (F.col("_not_finite") | ~is_finite(F.col("_top")) | ~is_finite(bottom)),
        "_not_positive": any_rows & (F.col("_not_positive") | (bottom <= 0))})


def _drawdown_columns() -> list[Column]:
    status = (F.when(F.max("_not_finite"), "non_finite_equity")
              .when(F.max("_not_positive"), "non_positive_equity").otherwise("ok"))
    depth = F.when(F.sum("_n") < 2, 0.0).when(status == "ok", F.min("_depth"))
    return [depth.alias("max_drawdown"),
            F.when(F.sum("_n") < 2, "ok").otherwise(status).alias("status"),
            F.sum("_n").alias("n_obs")]


def _raise_bad_status(df: DataFrame, name: str) -> DataFrame:
    message = F.concat(F.lit(f"{name}: equity must be finite and strictly positive, got "), F.col("status"))
    return df.withColumn("status", F.when(F.col("status") == "ok", F.col("status"))
                         .otherwise(F.raise_error(message)))


def max_drawdown(equity: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value",
                 strict: bool = False, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Deepest relative fall below the running peak of a strictly positive curve.

    An invalid curve gives NULL and says why in ``status``; ``strict`` raises instead.
    """
    level = missing_as_null(F.col(value))
    table = _drawdown_table(equity.select(*keys, ts, value), keys, ts, level, False, layout)
    result = table.groupBy(*keys).agg(*_drawdown_columns())
    return _raise_bad_status(result, "max_drawdown") if strict else result


def compounded_drawdown(returns: DataFrame, keys: Sequence[str], ts: str, value: str,
                        layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Drawdown, total growth and row count of the curve compounded from finite returns."""
    valid = returns.filter(is_finite(F.col(value))).select(*keys, ts, value)
    table = _drawdown_table(valid, keys, ts, F.col(value).cast("double") + 1.0, True, layout)
    return table.groupBy(*keys).agg(*_drawdown_columns(), F.product("_growth").alias("growth"))


def calmar(returns: DataFrame, holding_days: int = 1, trading_days_per_year: int = 365,
           keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value", strict: bool = False,
           layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Compound annual growth over the absolute drawdown of the same curve."""
    level = finite_or_null(F.col(value)) + 1.0
    table = _drawdown_table(returns.select(*keys, ts, value), keys, ts, level, True, layout, skip_missing=True)
    groups = table.groupBy(*keys).agg(*_drawdown_columns(), F.product("_growth").alias("growth"))
    n = F.col("n_obs")
    groups = groups.withColumn("max_drawdown", F.when(n > 0, F.col("max_drawdown")))
    yearly = trading_days_per_year / holding_days
    annual = F.pow(F.col("growth"), F.try_divide(F.lit(yearly), n)) - 1
    ratio = F.when((n >= 2) & (F.col("max_drawdown") < 0), F.try_divide(annual, F.abs("max_drawdown")))
    result = groups.select(
        *keys, ratio.alias("calmar"), "max_drawdown", n.alias("n_obs"),
        (n < MIN_ROWS).alias("small_sample_warning"),
        F.coalesce("status", F.lit("ok")).alias("status"))
    return _raise_bad_status(result, "calmar") if strict else result
