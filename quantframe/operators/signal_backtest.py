"""Backtest of a signal held for a fixed number of rows, without overlapping trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.functions.columns import missing_as_null
from quantframe.functions.costs import BPS
from quantframe.operators.features import SERIES
from quantframe.operators.metrics import (
    compounded_drawdown, profit_factor_agg, sharpe_agg, win_rate_agg)
from quantframe.plans.halo import over_rows
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.scan import ROW_INDEX, index_rows

PARAMS = ("param_id", "holding_days", "cost_bps")
TRADE_COLUMNS = ("entry_date", "exit_date", "position", "entry_price", "exit_price",
                 "gross_return", "net_return")


def _with_params(rows: DataFrame, params: Sequence[Mapping]) -> DataFrame:
    """Every row once per parameter set. The sets are literals of the plan."""
    structs = F.array(*(
        F.struct(F.lit(i).alias("param_id"), F.lit(int(p["holding_days"])).alias("holding_days"),
                 F.lit(float(p["cost_bps"])).alias("cost_bps")) for i, p in enumerate(params)))
    return rows.withColumn("_param", F.explode(structs)).select(*rows.columns, "_param.*")


def signal_trade_grid(signals: DataFrame, prices: DataFrame, params: Sequence[Mapping],
                      keys: Sequence[str] = SERIES, ts: str = "ts", signal: str = "signal",
                      price: str = "value", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Trades of every series and parameter set ``{"holding_days", "cost_bps"}``.

    Rows present on both sides are numbered once. Every ``holding_days``-th row may open a trade and
    closes at the next such row, so only those rows, a small share, are shuffled for the lookup.
    """
    left = signals.select(*keys, ts, missing_as_null(F.col(signal)).alias("_signal")).dropna(subset=["_signal"])
    right = prices.select(*keys, ts, missing_as_null(F.col(price)).alias("_price")).dropna(subset=["_price"])
    indexed = index_rows(left.join(right, [*keys, ts]), keys, ts, layout)
    sampled = _with_params(indexed, params).filter(F.col(ROW_INDEX) % F.col("holding_days") == 0)
    numbered = sampled.withColumn(
        ROW_INDEX, (F.col(ROW_INDEX) / F.col("holding_days")).cast("long"))
    groups = [*keys, *PARAMS]
    paired = over_rows(numbered, groups, ts, lambda rows: {
        "exit_date": F.lead(ts).over(rows), "exit_price": F.lead("_price").over(rows)}, after=1, layout=layout)
    opened = paired.withColumn("position", F.col("_signal").cast("int")).filter(
        F.col("exit_date").isNotNull() & (F.col("position") != 0) & (F.col("_price") > 0))
    gross = F.col("position") * (F.col("exit_price") / F.col("_price") - 1)
    return opened.withColumn("gross_return", gross).select(
        *groups, F.col(ts).alias("entry_date"), "exit_date", "position",
        F.col("_price").alias("entry_price"), "exit_price", "gross_return",
        (F.col("gross_return") - 2 * F.col("cost_bps") / F.lit(BPS)).alias("net_return"))


def signal_trades(signals: DataFrame, prices: DataFrame, holding_days: int = 14, cost_bps: float = 5.0,
                  keys: Sequence[str] = SERIES, ts: str = "ts", signal: str = "signal",
                  price: str = "value", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Trades for one parameter set."""
    params = [{"holding_days": holding_days, "cost_bps": cost_bps}]
    return signal_trade_grid(signals, prices, params, keys, ts, signal, price, layout).select(
        *keys, *TRADE_COLUMNS)


def signal_summary(trades: DataFrame, series: DataFrame, holding_days: int | None = 14,
                   trading_days_per_year: int = 365, keys: Sequence[str] = SERIES,
                   layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """One row per entry of ``series``, also for those without trades.

    With ``holding_days=None`` the annualisation reads the trades' own ``holding_days`` column.
    ``status`` tells when a loss of the whole capital leaves the drawdown undefined.
    """
    net = F.col("net_return")
    held = F.max("holding_days") if holding_days is None else F.lit(holding_days)
    stats = trades.groupBy(*keys).agg(
        sharpe_agg(net, held, trading_days_per_year).alias("sharpe"),
        win_rate_agg(net).alias("win_rate"), profit_factor_agg(net).alias("profit_factor"),
        F.count(F.lit(1)).alias("n_trades"), (F.avg(net) * 100).alias("avg_return_pct"))
    curve = compounded_drawdown(trades, keys, "exit_date", "net_return", layout).select(
        *keys, "max_drawdown", "status")
    both = stats.join(curve, list(keys), "left")
    empty = F.col("n_trades").isNull()
    return series.select(*keys).distinct().join(both, list(keys), "left").select(
        *keys, "sharpe", F.when(empty, 0.0).otherwise(F.col("max_drawdown")).alias("max_drawdown"),
        "win_rate", "profit_factor", F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        F.coalesce("avg_return_pct", F.lit(0.0)).alias("avg_return_pct"),
        F.coalesce("status", F.lit("ok")).alias("status"))


def run_signal_backtest(signals: DataFrame, prices: DataFrame, holding_days: int = 14,
                        cost_bps: float = 5.0, trading_days_per_year: int = 365,
                        keys: Sequence[str] = SERIES, ts: str = "ts", signal: str = "signal",
                        price: str = "value", layout: Layout = DEFAULT_LAYOUT) -> dict[str, DataFrame]:
    """``trades`` and ``summary`` of a non-overlapping fixed-holding backtest."""
    trades = signal_trades(signals, prices, holding_days, cost_bps, keys, ts, signal, price, layout)
    series = prices.select(*keys).distinct()
    return {"trades": trades, "summary": signal_summary(
        trades, series, holding_days, trading_days_per_year, keys, layout)}


def sweep_signal_backtest(signals: DataFrame, prices: DataFrame, params: Sequence[Mapping],
                          trading_days_per_year: int = 365, keys: Sequence[str] = SERIES,
                          ts: str = "ts", signal: str = "signal", price: str = "value",
                          layout: Layout = DEFAULT_LAYOUT) -> dict[str, DataFrame]:
    """The same for many parameter sets in one job; results carry the parameters as columns."""
    trades = signal_trade_grid(signals, prices, params, keys, ts, signal, price, layout)
    series = _with_params(prices.select(*keys).distinct(), params)
    return {"trades": trades, "summary": signal_summary(
        trades, series, None, trading_days_per_year, [*keys, *PARAMS], layout)}
