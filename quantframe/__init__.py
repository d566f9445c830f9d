"""Quantitative research on large panels of time series, as Spark DataFrame operators."""

from quantframe.functions import (
    CostModel, CryptoCost, FxCost, finite_or_null, is_finite, missing_as_null, safe_corr,
    threshold_signal, zscore_fixed)
from quantframe.operators.coint import coint_screen
from quantframe.operators.costs import with_costs, with_instrument_costs
from quantframe.operators.diagnostics import ic_decay, ic_direction, quantile_returns, rank_ic
from quantframe.operators.features import add_threshold_signal, forward_returns, zscore
from quantframe.operators.metrics import (
    calmar, max_drawdown, metric_flags, profit_factor, sharpe, sortino, win_rate)
from quantframe.operators.pairs import align_pairs, build_spread, half_life, rolling_hedge_ratio
from quantframe.operators.signal_backtest import run_signal_backtest, sweep_signal_backtest
from quantframe.operators.splits import rows_in_folds, select_dates, walk_forward_splits, zscore_by_fold
from quantframe.operators.spread_backtest import SpreadRules, run_spread_backtest, sweep_spread_backtest
from quantframe.plans import (
    DEFAULT_LAYOUT, Layout, index_rows, keep_last, measure_layout, running_max, running_product,
    running_sum)

__all__ = [
    "CostModel", "CryptoCost", "DEFAULT_LAYOUT", "FxCost", "Layout", "SpreadRules",
    "add_threshold_signal", "align_pairs", "build_spread", "calmar", "coint_screen",
    "finite_or_null", "forward_returns", "half_life", "ic_decay", "ic_direction", "index_rows",
    "is_finite", "keep_last", "max_drawdown", "measure_layout", "metric_flags", "missing_as_null", "profit_factor",
    "quantile_returns", "rank_ic", "rolling_hedge_ratio", "rows_in_folds", "run_signal_backtest",
    "run_spread_backtest", "running_max", "running_product", "running_sum", "safe_corr",
    "select_dates", "sharpe", "sortino", "sweep_signal_backtest",
    "sweep_spread_backtest", "threshold_signal", "walk_forward_splits", "win_rate",
    "with_costs", "with_instrument_costs", "zscore", "zscore_by_fold", "zscore_fixed",
]
