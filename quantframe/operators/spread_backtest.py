"""Mean-reversion backtest of spreads: enter on a wide z-score, leave on reversion, stop or age."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.columns import INF, is_finite, missing_as_null
from quantframe.operators import positions
from quantframe.operators.features import SERIES, rolling_zscore_column
from quantframe.operators.metrics import max_drawdown, sharpe_agg
from quantframe.plans.halo import BLOCK, drop_halo, in_block, with_halo
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout
from quantframe.plans.scan import ROW_INDEX, SERIES_ROWS, index_rows, running_sum
from quantframe.plans.skew import join_by_key
from quantframe.session import materialize, ship_package

PARAM = "param_id"
MIN_ROWS_AFTER_LOOKBACK = 10


@dataclass(frozen=True)
class SpreadRules:
    """One parameter set. ``exit_z`` 0 leaves at the mean; ``cost_per_trade`` is in spread units."""

    entry_z: float = 2.0
    exit_z: float = 0.0
    stop_z: float = 4.0
    lookback: int = 60
    cost_per_trade: float = 0.0
    capital_base: float = 1.0
    max_holding_bars: int | None = None


def _rule_literals(rules: Sequence[SpreadRules]) -> Column:
    return F.array(*(F.struct(
        F.lit(i).alias(PARAM), F.lit(float(r.entry_z)).alias("entry_z"),
        F.lit(float(r.exit_z)).alias("exit_z"), F.lit(float(r.stop_z)).alias("stop_z"),
        F.lit(int(r.lookback)).alias("lookback"), F.lit(float(r.cost_per_trade)).alias("cost_per_trade"),
        F.lit(float(r.capital_base)).alias("capital_base"),
        F.lit(r.max_holding_bars).cast("long").alias("max_hold")) for i, r in enumerate(rules)))


def _scored_bars(spread: DataFrame, rules: Sequence[SpreadRules], keys: Sequence[str], ts: str,
                 value: str, layout: Layout) -> DataFrame:
    """Bars that take part, once per rule set, with what each may trigger as small codes.

    Every different lookback is one more window column over the same blocks.
    """
    present = spread.select(*keys, ts, missing_as_null(F.col(value)).alias("spread")).dropna(subset=["spread"])
    indexed = index_rows(present, keys, ts, layout, series_rows=True)
    lookbacks = sorted({r.lookback for r in rules})
    blocks = with_halo(indexed, before=max(max(lookbacks) - 1, 1), layout=layout)
    rows = in_block(keys)
    columns = {f"_z{n}": n for n in lookbacks}
    scored = blocks.withColumns({
        **{c: rolling_zscore_column(rows, "spread", n) for c, n in columns.items()},
        "change": F.col("spread") - F.lag("spread").over(rows)})
    bars = drop_halo(scored, layout, keep_block=True).withColumn("_rule", F.explode(_rule_literals(rules)))
    bars = bars.select(*[c for c in bars.columns if c != "_rule"], "_rule.*")
    z = F.coalesce(*(F.when(F.col("lookback") == n, F.col(c)) for c, n in columns.items()))
    bars = bars.withColumn("z", z).filter(
        (F.col(SERIES_ROWS) >= F.col("lookback") + MIN_ROWS_AFTER_LOOKBACK)
        & (F.col(ROW_INDEX) >= F.col("lookback")))
    zc, live = F.col("z"), is_finite(F.col("z"))
    entry = F.when(live & (zc > F.col("entry_z")), -1).when(live & (zc < -F.col("entry_z")), 1).otherwise(0)
    exit_long = (F.when(live & (zc < -F.col("stop_z")), positions.STOP)
                 .when(live & (zc >= -F.col("exit_z")), positions.REVERSION).otherwise(0))
    exit_short = (F.when(live & (zc > F.col("stop_z")), positions.STOP)
                  .when(live & (zc <= F.col("exit_z")), positions.REVERSION).otherwise(0))
    return bars.select(
        *keys, PARAM, BLOCK, ROW_INDEX, SERIES_ROWS, F.col(ts).alias("ts"), "spread", "change", "z",
        "cost_per_trade", "capital_base", "max_hold", live.alias("live"), entry.alias("entry"),
        exit_long.alias("exit_long"), exit_short.alias("exit_short"))


def _schema_of(df: DataFrame, columns: Sequence[str], extra: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + T.StructType.fromDDL(extra).fields)


def _marked_bars(bars: DataFrame, keys: Sequence[str], layout: Layout) -> DataFrame:
    """Bars with the position held into them and the trades they open or close."""
    groups = [*keys, PARAM]
    ship_package(bars.sparkSession)

    def to_map(block: pd.DataFrame) -> pd.DataFrame:
        row = positions.block_map(block.sort_values(ROW_INDEX))
        head = {c: block[c].iloc[0] for c in (*groups, BLOCK)}
        return pd.DataFrame([{**head, **row}])

    def to_states(maps: pd.DataFrame) -> pd.DataFrame:
        ordered = maps.sort_values(BLOCK)
        return ordered[[*groups, BLOCK]].assign(state=positions.entering(ordered))

    def to_marks(block: pd.DataFrame) -> pd.DataFrame:
        ordered = block.sort_values(ROW_INDEX)
        last = int(ordered[ROW_INDEX].iloc[-1]) == int(ordered[SERIES_ROWS].iloc[0]) - 1
        marked = positions.mark_bars(ordered, int(ordered["state"].iloc[0]), last)
        return marked.drop(columns=["state"])

    if layout.fits_one_task:
        entered = bars.withColumn("state", F.lit(0).cast("long"))
    else:
        map_schema = _schema_of(bars, [*groups, BLOCK], positions.MAP_SCHEMA)
        maps = bars.groupBy(*groups, BLOCK).applyInPandas(to_map, map_schema)
        # one map per block: a group here holds (rows of the series / block_rows) rows
        states = maps.groupBy(*groups).applyInPandas(
            to_states, _schema_of(bars, [*groups, BLOCK], "state long"))
        entered = bars.join(states, [*groups, BLOCK])
    return entered.select(*bars.columns, "state").groupBy(*groups, BLOCK).applyInPandas(
        to_marks, _schema_of(bars, bars.columns, positions.MARK_SCHEMA))


def _trades(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closing bars matched to the bars that opened them."""
    groups = [*keys, PARAM]
    opened = marked.filter("opened").select(
        *groups, F.col(ROW_INDEX).alias("entry_index"), F.col("ts").alias("entry_date"),
        F.col("spread").alias("entry_price"), F.col("z").alias("entry_z"), F.col("entry").alias("position"))
    closed = marked.filter("exit_code > 0").select(
        *groups, "entry_index", F.col("ts").alias("exit_date"), F.col("spread").alias("exit_price"),
        F.col("z").alias("exit_z"), (F.col(ROW_INDEX) - F.col("entry_index")).cast("int").alias("holding_bars"),
        "exit_code", "cost_per_trade", "capital_base")
    reasons = F.create_map(*(F.lit(x) for pair in positions.EXIT_REASONS.items() for x in pair))
    pnl = F.col("position") * (F.col("exit_price") - F.col("entry_price")) - F.col("cost_per_trade")
    return closed.join(opened, [*groups, "entry_index"]).withColumn("pnl", pnl).select(
        *groups, "entry_date", "exit_date", "position", "entry_price", "exit_price", "entry_z", "exit_z",
        "pnl", (F.col("pnl") / F.col("capital_base")).alias("return"), "holding_bars",
        reasons[F.col("exit_code")].alias("exit_reason"))


def _equity(marked: DataFrame, trades: DataFrame, keys: Sequence[str], layout: Layout) -> DataFrame:
    """Profit, return and additive equity per bar, for series that traded."""
    groups = [*keys, PARAM]
    traded = trades.select(*groups).distinct()
    booked = F.when(F.col("live"), F.col("held") * F.col("change")).otherwise(0.0)
    charged = F.when(F.col("exit_code") > 0, F.col("cost_per_trade")).otherwise(0.0)
    pnl = join_by_key(marked, traded, groups, "ts", "left_semi", layout).select(
        *groups, "ts", (booked - charged).alias("daily_pnl"),
        ((booked - charged) / F.col("capital_base")).alias("daily_returns"))
    summed = running_sum(pnl, groups, F.col("daily_returns"), "_sum", "ts", layout)
    return summed.select(*pnl.columns, (F.lit(1.0) + F.col("_sum")).alias("equity"))


def spread_summary(trades: DataFrame, equity: DataFrame, series: DataFrame,
                   trading_days_per_year: int = 252, keys: Sequence[str] = (*SERIES, PARAM),
                   layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """One row per entry of ``series`` (which lists ``keys`` and ``capital_base``), traded or not.

    ``win_rate`` counts a trade without profit as lost. Where equity touches zero the drawdown is
    NULL and ``equity_warning`` is set.
    """
    group = list(keys)
    pnl = F.col("pnl")
    gains = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    losses = F.coalesce(F.sum(F.when(pnl < 0, -pnl)), F.lit(0.0))
    per_trade = trades.groupBy(*group).agg(
        F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.when(losses > 0, F.try_divide(gains, losses)).when(gains > 0, F.lit(INF)).alias("profit_factor"),
        F.count(F.lit(1)).alias("n_trades"), F.avg("holding_bars").alias("avg_holding"),
        F.avg(pnl).alias("avg_pnl"))
    per_bar = equity.groupBy(*group).agg(
        sharpe_agg(F.col("daily_returns"), 1, trading_days_per_year).alias("sharpe"),
        (F.min("equity") <= 0).alias("equity_warning"))
    depth = max_drawdown(equity, group, "ts", "equity", layout=layout).select(
        *group, F.col("max_drawdown").alias("_depth"))
    joined = (series.select(*group, "capital_base").distinct().join(per_trade, group, "left")
              .join(per_bar, group, "left").join(depth, group, "left"))
    idle = F.col("n_trades").isNull()
    return joined.select(
        *group, "sharpe",
        F.when(idle, 0.0).when(~F.col("equity_warning"), F.col("_depth")).alias("max_drawdown"),
        "win_rate", "profit_factor", F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        F.coalesce("avg_holding", F.lit(0.0)).alias("avg_holding"),
        F.coalesce("avg_pnl", F.lit(0.0)).alias("avg_pnl"),
        F.when(~idle, F.col("capital_base")).alias("capital_base"),
        F.coalesce("equity_warning", F.lit(False)).alias("equity_warning"))


def sweep_spread_backtest(spread: DataFrame, rules: Sequence[SpreadRules], trading_days_per_year: int = 252,
                          keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value",
                          layout: Layout = DEFAULT_LAYOUT) -> dict[str, DataFrame]:
    """``trades``, ``equity`` and ``summary`` of every series under every rule set, in one job.

    The marked bars feed all three results and are computed once, into the shared folder.
    """
    if any(r.capital_base <= 0 for r in rules):
        raise ValueError("capital_base must be positive")
    marked = materialize(_marked_bars(_scored_bars(spread, rules, keys, ts, value, layout), keys, layout))
    trades = _trades(marked, keys)
    equity = _equity(marked, trades, keys, layout)
    series = spread.select(*keys).distinct().withColumn("_rule", F.explode(_rule_literals(rules)))
    series = series.select(*keys, F.col(f"_rule.{PARAM}").alias(PARAM), "_rule.capital_base")
    summary = spread_summary(trades, equity, series, trading_days_per_year, [*keys, PARAM], layout)
    return {"trades": trades, "equity": equity, "summary": summary}


def run_spread_backtest(spread: DataFrame, entry_z: float = 2.0, exit_z: float = 0.0, stop_z: float = 4.0,
                        lookback: int = 60, cost_per_trade: float = 0.0, capital_base: float = 1.0,
                        max_holding_bars: int | None = None, trading_days_per_year: int = 252,
                        keys: Sequence[str] = SERIES, ts: str = "ts", value: str = "value",
                        layout: Layout = DEFAULT_LAYOUT) -> dict[str, DataFrame]:
    """The same for one rule set, without the ``param_id`` column."""
    rules = SpreadRules(entry_z, exit_z, stop_z, lookback, cost_per_trade, capital_base, max_holding_bars)
    results = sweep_spread_backtest(spread, [rules], trading_days_per_year, keys, ts, value, layout)
    return {name: frame.drop(PARAM) for name, frame in results.items()}
