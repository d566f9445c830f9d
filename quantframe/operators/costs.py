"""Costs attached to a trades table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions.columns import as_column
from quantframe.functions.costs import CostModel, CryptoCost, FxCost
from quantframe.operators.features import SERIES


def with_costs(trades: DataFrame, model: CostModel | Callable[[Column, Column], Column],
               notional: Column | float = 1.0, holding_days: Column | float = 0,
               name: str = "cost") -> DataFrame:
    """Add the cost of each trade. ``model`` is a cost model, or a function from the notional and
    holding-days columns to a cost column, so a user's own formula stays inside the plan."""
    size, held = as_column(notional), as_column(holding_days)
    cost = model.total_cost(size, held) if isinstance(model, CostModel) else model(size, held)
    return trades.withColumn(name, cost)


def with_instrument_costs(trades: DataFrame, costs: DataFrame, notional: Column | float = 1.0,
                          holding_days: Column | float = 0, keys: Sequence[str] = SERIES,
                          name: str = "cost") -> DataFrame:
    """Add costs from a table with one row per instrument: ``kind`` is ``crypto`` or ``fx``, next to
    ``taker_bps, spread_pips, pip_value, swap_per_day``. Spark broadcasts the table if it is small."""
    size, held = as_column(notional), as_column(holding_days)
    fields = ["kind", "taker_bps", "spread_pips", "pip_value", "swap_per_day"]
    per_trade = trades.join(costs.select(*keys, *fields), list(keys), "left")
    crypto = CryptoCost(F.col("taker_bps")).total_cost(size, held)
    fx = FxCost(F.col("spread_pips"), F.col("pip_value"), F.col("swap_per_day")).total_cost(size, held)
    cost = F.when(F.col("kind") == "crypto", crypto).when(F.col("kind") == "fx", fx)
    return per_trade.withColumn(name, cost).select(*trades.columns, name)
