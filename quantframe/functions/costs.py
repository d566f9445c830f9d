"""Trade cost models as column formulas.

Parameters may be numbers or columns, so a cost table joined per instrument feeds the same models.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantframe.functions.columns import as_column

BPS = 10_000


class CostModel:
    """Base of user-defined models: override ``round_trip_cost`` with a column formula."""

    def round_trip_cost(self, notional: Column | float = 1.0) -> Column:
        raise NotImplementedError

    def total_cost(self, notional: Column | float, holding_days: Column | float) -> Column:
        return self.round_trip_cost(notional)


@dataclass(frozen=True)
class CryptoCost(CostModel):
    """Taker fee in basis points, paid on entry and again on exit."""

    taker_bps: Column | float = 5.0

    def round_trip_cost(self, notional: Column | float = 1.0) -> Column:
        return as_column(notional) * as_column(self.taker_bps) * 2 / F.lit(BPS)


@dataclass(frozen=True)
class FxCost(CostModel):
    """Bid-ask spread in pips plus a swap charge for every day held."""

    spread_pips: Column | float = 1.5
    pip_value: Column | float = 0.0001
    swap_per_day: Column | float = 0.0

    def round_trip_cost(self, notional: Column | float = 1.0) -> Column:
        return as_column(notional) * as_column(self.spread_pips) * as_column(self.pip_value)

    def swap_cost(self, notional: Column | float, holding_days: Column | float) -> Column:
        return as_column(notional) * F.abs(as_column(self.swap_per_day)) * as_column(holding_days)

    def total_cost(self, notional: Column | float, holding_days: Column | float) -> Column:
        return self.round_trip_cost(notional) + self.swap_cost(notional, holding_days)
