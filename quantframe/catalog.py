"""Registered queries: every operator over panels that Spark derives from the given tables.

``prices`` holds the mean order price per priority and day, in whole cents so that any engine gets the
same doubles; ``bars`` holds 15-minute candles of event values per event type.
"""

from __future__ import annotations

import functools
import io
import itertools
import zipfile
from collections.abc import Callable, Sequence
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.costs import CryptoCost, FxCost
from quantframe.operators import coint, costs, diagnostics, features, metrics, pairs, splits
from quantframe.operators import signal_backtest as signal_bt
from quantframe.operators import spread_backtest as spread_bt
from quantframe.plans import Layout, keep_last, measure_layout, running_max, running_product, running_sum
from quantframe.session import materialize, scratch_path, ship_package
from quantframe.sources import coverage, history, klines, payloads, refresh, universe
from quantframe.sources.upsert_log import UpsertLog
from quantframe.sources.specs import BAR_FIELDS, SNAPSHOT_SPECS, SPECS, spec_for
from quantframe.streaming import log_batches, run_available, snapshot_batches, upsert_batches

Query = Callable[[SparkSession, str], DataFrame]

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HORIZONS = (1, 5, 20)
ZSCORE_WINDOW = 30
FOLD = {"train_days": 365, "test_days": 90, "embargo_days": 14}
SPREAD_RULES = spread_bt.SpreadRules(
    entry_z=1.5, exit_z=0.0, stop_z=3.0, lookback=20, cost_per_trade=100.0, capital_base=1e7,
    max_holding_bars=20)
AS_OF = "2024-02-02 10:07:00"
HISTORY_START = "2023-12-01 00:00:00"
TAIL_FROM = "2024-01-15"
REFRESH_AS_OF = "2024-01-30 12:07:00"
PLACES = 6


_limit: ContextVar[int] = ContextVar("rows a task may hold", default=Layout.task_rows)


def layout_of(panel: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts", **options) -> Layout:
    return measure_layout(panel, keys, ts, task_rows=_limit.get(), **options)


@functools.cache
def _schema(spark: SparkSession, path: str) -> T.StructType:
    """Read off the file once per session instead of once per use."""
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def _cents(amount: str) -> Column:
    return F.sum(F.round(F.col(amount) * 100).cast("long")).cast("double")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")).agg(
        (_cents("o_totalprice") / F.count(F.lit(1)) / 100.0).alias("value"),
        F.count(F.lit(1)).cast("double").alias("n_orders"))


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).select("series_id", "ts", "value")


def order_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day: a factor with many ties."""
    return prices(spark, sf_dir).select("series_id", "ts", F.col("n_orders").alias("value"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and dates of the price panel, before orders of a day are averaged."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))


def price_layout(spark: SparkSession, sf_dir: str) -> Layout:
    """Measured once per query; pairs, folds and horizons of the panel have no longer series."""
    return layout_of(order_dates(spark, sf_dir), bar_hours=24)


def returns(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    wide = features.forward_returns(price_panel(spark, sf_dir), [1], layout=layout)
    return wide.select("series_id", "ts", F.col("fwd_1").alias("value"))


def aligned(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """The pairs to screen are named by the caller, here all of the five priorities."""
    named = spark.createDataFrame(list(itertools.combinations(PRIORITIES, 2)), "a_id string, b_id string")
    return pairs.align_pairs(price_panel(spark, sf_dir), named, layout=layout)


def spreads(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    built = pairs.build_spread(aligned(spark, sf_dir, layout), 1.0)
    return built.select(F.concat_ws("|", "a_id", "b_id").alias("series_id"), "ts", F.col("spread").alias("value"))


def candles(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    events = table(spark, sf_dir, "events")
    start = F.date_trunc("hour", "ts") + F.make_dt_interval(
        mins=(F.floor(F.minute("ts") / minutes) * minutes).cast("int"))
    return events.groupBy(F.col("event_type").alias("symbol"), start.cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"),
        F.max_by("value", "event_id").alias("c"), F.count(F.lit(1)).cast("double").alias("v"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types, and one symbol without any data."""
    known = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    return known.unionByName(spark.createDataFrame([("refund",)], "symbol string"))


# diagnostics -------------------------------------------------------------------------------------

def q_forward_returns(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    wide = features.forward_returns(price_panel(spark, sf_dir), HORIZONS, layout=layout)
    return rounded(wide.select("series_id", "ts", *(f"fwd_{h}" for h in HORIZONS)), *(f"fwd_{h}" for h in HORIZONS))


def q_ic_decay(spark, sf_dir):
    panel = price_panel(spark, sf_dir)
    return rounded(diagnostics.ic_decay(panel, HORIZONS, prices=panel, layout=price_layout(spark, sf_dir)), "ic")


def q_ic_decay_wide(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    wide = features.forward_returns(price_panel(spark, sf_dir), HORIZONS, layout=layout)
    forward = wide.select("series_id", "ts", *(f"fwd_{h}" for h in HORIZONS))
    return rounded(diagnostics.ic_decay(order_factor(spark, sf_dir), forward_ret=forward, layout=layout), "ic")


def _factor_pairs(spark, sf_dir, layout):
    wide = features.forward_returns(prices(spark, sf_dir), [5], layout=layout)
    return wide.select("series_id", "ts", F.col("n_orders").alias("factor"), F.col("fwd_5").alias("fwd_ret"))


def q_rank_ic(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    return rounded(diagnostics.rank_ic(_factor_pairs(spark, sf_dir, layout), layout=layout), "ic").drop("n_obs")


def q_rank_ic_by_date(spark, sf_dir):
    """Cross-section: the groups are months instead of series."""
    pairs_of_day = _factor_pairs(spark, sf_dir, price_layout(spark, sf_dir))
    monthly = pairs_of_day.withColumn("month", F.date_format("ts", "yyyy-MM"))
    by_month = layout_of(order_dates(spark, sf_dir).select(F.date_format("ts", "yyyy-MM").alias("month"), "ts"), ["month"])
    return rounded(diagnostics.rank_ic(monthly, keys=["month"], layout=by_month), "ic").drop("n_obs")


def q_ic_direction(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    folds = splits.walk_forward_splits(order_dates(spark, sf_dir), **FOLD)
    train = splits.rows_in_folds(_factor_pairs(spark, sf_dir, layout), folds, "train")
    return rounded(diagnostics.ic_direction(train, keys=["series_id", "fold_idx"], layout=layout), "ic")


def q_quantile_returns(spark, sf_dir):
    panel = price_panel(spark, sf_dir)
    return rounded(diagnostics.quantile_returns(
        panel, 5, horizon=5, prices=panel, layout=price_layout(spark, sf_dir)), "mean_return")


def q_quantile_returns_wide(spark, sf_dir):
    """Precomputed returns and a coarse factor, whose tied edges some series cannot be cut at."""
    layout = price_layout(spark, sf_dir)
    wide = features.forward_returns(price_panel(spark, sf_dir), [5], layout=layout).select("series_id", "ts", "fwd_5")
    coarse = price_panel(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20000).cast("double"))
    return rounded(diagnostics.quantile_returns(coarse, 4, forward_ret=wide, layout=layout), "mean_return")


# features ----------------------------------------------------------------------------------------

def q_zscore_rolling(spark, sf_dir):
    scored = features.zscore(price_panel(spark, sf_dir), "rolling", ZSCORE_WINDOW, layout=price_layout(spark, sf_dir))
    return rounded(scored.select("series_id", "ts", "zscore"), "zscore")


def q_zscore_expanding(spark, sf_dir):
    scored = features.zscore(price_panel(spark, sf_dir), "expanding", ZSCORE_WINDOW, layout=price_layout(spark, sf_dir))
    return rounded(scored.select("series_id", "ts", "zscore"), "zscore")


def q_zscore_fixed(spark, sf_dir):
    panel = price_panel(spark, sf_dir)
    folds = splits.walk_forward_splits(order_dates(spark, sf_dir), **FOLD)
    scored = splits.zscore_by_fold(panel, folds, layout=price_layout(spark, sf_dir))
    return rounded(scored.select("series_id", "ts", "fold_idx", "zscore"), "zscore")


def _signals(spark, sf_dir, layout):
    scored = features.zscore(price_panel(spark, sf_dir), "rolling", ZSCORE_WINDOW, layout=layout)
    return features.add_threshold_signal(scored, "zscore", 0.5).select("series_id", "ts", "signal")


def q_threshold_signal(spark, sf_dir):
    return _signals(spark, sf_dir, price_layout(spark, sf_dir))


# splits ------------------------------------------------------------------------------------------

def q_walk_forward_folds(spark, sf_dir):
    return splits.walk_forward_splits(order_dates(spark, sf_dir), **FOLD)


def q_walk_forward_overlapping(spark, sf_dir):
    """Folds per series that step by less than the test period."""
    return splits.walk_forward_splits(order_dates(spark, sf_dir), 200, 50, 5, step_days=20, keys=["series_id"])


def q_fold_rows(spark, sf_dir):
    panel = price_panel(spark, sf_dir)
    rows = splits.rows_in_folds(panel, splits.walk_forward_splits(order_dates(spark, sf_dir), **FOLD))
    return rows.groupBy("series_id", "fold_idx", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def q_select_dates(spark, sf_dir):
    fold = {"train_start": pd.Timestamp("1996-01-01"), "train_end": pd.Timestamp("1996-12-31"),
            "test_start": pd.Timestamp("1997-01-15"), "test_end": pd.Timestamp("1997-04-14")}
    return rounded(splits.select_dates(price_panel(spark, sf_dir), fold, "test"), "value")


# metrics -----------------------------------------------------------------------------------------

def _returns(spark, sf_dir):
    return returns(spark, sf_dir, price_layout(spark, sf_dir))



def q_sharpe(spark, sf_dir):
    return rounded(metrics.sharpe(_returns(spark, sf_dir), 1, 252, risk_free=0.03), "sharpe")


def q_sortino(spark, sf_dir):
    return rounded(metrics.sortino(_returns(spark, sf_dir), 1, 252, risk_free=0.03), "sortino")


def q_max_drawdown(spark, sf_dir):
    return rounded(metrics.max_drawdown(price_panel(spark, sf_dir), layout=price_layout(spark, sf_dir)), "max_drawdown")


def q_calmar(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    return rounded(metrics.calmar(returns(spark, sf_dir, layout), 1, 252, layout=layout), "calmar", "max_drawdown")


def q_win_rate(spark, sf_dir):
    return rounded(metrics.win_rate(_returns(spark, sf_dir)), "win_rate")


def q_profit_factor(spark, sf_dir):
    return rounded(metrics.profit_factor(_returns(spark, sf_dir)), "profit_factor")


def q_metric_flags(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    return rounded(metrics.metric_flags(returns(spark, sf_dir, layout), layout=layout), "lag1_autocorr")


def q_equity_curves(spark, sf_dir):
    """Compounded and additive equity and the drawdown below the running peak."""
    layout = price_layout(spark, sf_dir)
    daily = returns(spark, sf_dir, layout).dropna()
    keys = ["series_id"]
    compounded = running_product(daily, keys, F.col("value") + 1.0, "equity", layout=layout)
    peaked = running_max(compounded, keys, F.col("equity"), "peak", layout=layout)
    both = running_sum(peaked, keys, F.col("value"), "total", layout=layout)
    return rounded(both.select("series_id", "ts", "equity", (F.col("total") + 1.0).alias("additive_equity"),
                               (F.col("equity") / F.col("peak") - 1.0).alias("drawdown")),
                   "equity", "additive_equity", "drawdown")


# pairs -------------------------------------------------------------------------------------------

def q_build_spread(spark, sf_dir):
    built = pairs.build_spread(aligned(spark, sf_dir, price_layout(spark, sf_dir)), 0.5)
    return rounded(built.select("a_id", "b_id", "ts", "spread"), "spread")


def q_hedge_ratio(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    rolled = pairs.rolling_hedge_ratio(aligned(spark, sf_dir, layout), 60, layout=layout)
    hedged = pairs.build_spread(rolled, F.col("hedge_ratio"))
    return hedged.select("a_id", "b_id", "ts", F.round("hedge_ratio", PLACES).alias("hedge_ratio"),
                         F.round("spread", 4).alias("spread"))


def q_half_life(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    return rounded(pairs.half_life(spreads(spark, sf_dir, layout), layout=layout), "half_life")


def q_coint_screen(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    screened = coint.coint_screen(aligned(spark, sf_dir, layout), layout=layout)
    numbers = [f.name for f in screened.schema if f.dataType.typeName() == "double"]
    return rounded(screened, *numbers)


# backtests ---------------------------------------------------------------------------------------

_TRADE_NUMBERS = ("entry_price", "exit_price", "gross_return", "net_return")


def _trades(spark, sf_dir, cost_bps):
    layout = price_layout(spark, sf_dir)
    return signal_bt.signal_trades(
        _signals(spark, sf_dir, layout), price_panel(spark, sf_dir), 14, cost_bps, layout=layout)


def q_signal_trades(spark, sf_dir):
    return rounded(_trades(spark, sf_dir, 5.0), *_TRADE_NUMBERS)


def q_signal_summary(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    summary = signal_bt.run_signal_backtest(
        _signals(spark, sf_dir, layout), price_panel(spark, sf_dir), 14, 5.0, layout=layout)["summary"]
    return rounded(summary, "sharpe", "max_drawdown", "win_rate", "profit_factor", "avg_return_pct")


def q_signal_sweep(spark, sf_dir):
    params = [{"holding_days": h, "cost_bps": c} for h in (5, 14, 30) for c in (0.0, 10.0)]
    layout = price_layout(spark, sf_dir)
    summary = signal_bt.sweep_signal_backtest(
        _signals(spark, sf_dir, layout), price_panel(spark, sf_dir), params, layout=layout)["summary"]
    return rounded(summary, "sharpe", "max_drawdown", "win_rate", "profit_factor", "avg_return_pct").drop("param_id")


def q_walk_forward_backtest(spark, sf_dir):
    """Train statistics to z-scores of the test rows, signals from the training IC's sign, and a backtest
    of every fold."""
    panel = price_panel(spark, sf_dir)
    keys = ["series_id", "fold_idx"]
    layout = price_layout(spark, sf_dir)
    folds = materialize(splits.walk_forward_splits(order_dates(spark, sf_dir), **FOLD))
    direction = diagnostics.ic_direction(
        splits.rows_in_folds(_factor_pairs(spark, sf_dir, layout), folds, "train"), keys=keys, layout=layout)
    scored = splits.zscore_by_fold(order_factor(spark, sf_dir), folds, layout=layout)
    signals = features.add_threshold_signal(scored, "zscore", 0.5).join(direction, keys).select(
        *keys, "ts", (F.col("signal") * F.col("direction")).alias("signal"))
    tests = splits.rows_in_folds(panel, folds, "test")
    summary = signal_bt.run_signal_backtest(signals, tests, 5, 5.0, keys=keys, layout=layout)["summary"]
    return rounded(summary, "sharpe", "max_drawdown", "win_rate", "profit_factor", "avg_return_pct")


def q_trade_costs(spark, sf_dir):
    trades = _trades(spark, sf_dir, 0.0)
    held = F.datediff("exit_date", "entry_date")
    size = F.col("entry_price")
    costed = costs.with_costs(trades, CryptoCost(5.0), size, name="crypto_cost")
    costed = costs.with_costs(costed, FxCost(1.5, 0.0001, -0.00001), size, held, "fx_cost")
    costed = costs.with_costs(costed, lambda notional, days: notional * 0.0002 + days * 0.5, size, held, "own_cost")
    return costed.select("series_id", "entry_date", "crypto_cost", "fx_cost", "own_cost")


def q_instrument_costs(spark, sf_dir):
    """Costs from a table per instrument, here read off the customers of each priority."""
    trades = _trades(spark, sf_dir, 0.0)
    per_series = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(
        (F.countDistinct("o_custkey") / 1000.0).alias("taker_bps"))
    urgent = F.col("series_id").startswith("1")
    priced = per_series.select(
        "series_id", F.when(urgent, "fx").otherwise("crypto").alias("kind"), "taker_bps",
        F.lit(1.5).alias("spread_pips"), F.lit(0.0001).alias("pip_value"), F.lit(0.00002).alias("swap_per_day"))
    costed = costs.with_instrument_costs(trades, priced, F.col("entry_price"), F.datediff("exit_date", "entry_date"))
    return costed.select("series_id", "entry_date", "cost")


def _spread_run(spark, sf_dir):
    layout = price_layout(spark, sf_dir)
    return spread_bt.run_spread_backtest(
        spreads(spark, sf_dir, layout), trading_days_per_year=252, layout=layout, **vars(SPREAD_RULES))


def q_spread_trades(spark, sf_dir):
    return rounded(_spread_run(spark, sf_dir)["trades"], "entry_price", "exit_price", "entry_z", "exit_z", "pnl", "return")


def q_spread_equity(spark, sf_dir):
    return rounded(_spread_run(spark, sf_dir)["equity"], "daily_pnl", "daily_returns", "equity")


def q_spread_summary(spark, sf_dir):
    return rounded(_spread_run(spark, sf_dir)["summary"], "sharpe", "max_drawdown", "win_rate", "profit_factor",
                   "avg_holding", "avg_pnl")


# bars and coverage -------------------------------------------------------------------------------

def q_normalize_bars(spark, sf_dir):
    """Every event as a raw record with text numbers; the last record of each bar wins."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    text = F.when(F.col("value") == 0, "n/a").otherwise(F.col("value").cast("string"))
    raw = events.select(F.col("event_type").alias("symbol"), hour.alias("ts"), "event_id",
                        *(text.alias(c) for c in ("o", "h", "l", "c")), F.get_json_object("props", "$.k").alias("v"))
    return klines.normalize_bars(raw, ["event_id"])


def q_latest_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return keep_last(events, ["user_id", "event_type"], ["ts", "event_id"])


def q_union_batches(spark, sf_dir):
    """Stored hourly and fresh 15-minute counts, of which only one has a high."""
    hourly = candles(spark, sf_dir, 60).select("symbol", "ts", "v")
    quarter = candles(spark, sf_dir, 15).select("symbol", "ts", "v", "h")
    return history.union_batches(hourly, quarter).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count("h").alias("with_high"), F.sum("v").alias("events"))


def q_coverage_summary(spark, sf_dir):
    return coverage.coverage_summary(candles(spark, sf_dir), ["symbol"], symbols(spark, sf_dir))


def _documented(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.concat("event_type", F.lit("_k")).alias("endpoint"), F.col("user_id").alias("symbol"),
                         F.when(F.col("value") < 5, "4h").when(F.col("value") < 50, "1d").alias("interval"), "ts")


def q_manifest(spark, sf_dir):
    """Rows of unknown interval stay, as a group of their own."""
    summary = coverage.coverage_summary(_documented(spark, sf_dir), ["interval", "symbol", "endpoint"])
    return coverage.available(coverage.roll_up_manifest(summary))


def q_missing_periods(spark, sf_dir):
    gaps = coverage.history_gaps(candles(spark, sf_dir), symbols(spark, sf_dir), HISTORY_START, AS_OF)
    return gaps.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})


def q_fetch_watermark(spark, sf_dir):
    plan = coverage.fetch_watermark(candles(spark, sf_dir), symbols(spark, sf_dir), AS_OF)
    return plan.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_ts", "from_ts", "to_ts")})


def q_universe_filter(spark, sf_dir):
    named = universe.parse_symbols("click, view,,PURCHASE ")
    kept = universe.filter_universe(candles(spark, sf_dir).withColumn("symbol", F.upper("symbol")), named)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("events"))


# payloads ----------------------------------------------------------------------------------------

def _payload_documents(spark, sf_dir, spec):
    """One response document per event, with the endpoint's own field names."""
    events = table(spark, sf_dir, "events")
    stamp = F.col("ts").cast("timestamp")
    odd = F.col("event_id") % 2 == 1
    epoch = F.unix_seconds(stamp)
    if spec.epoch == "auto":
        epoch = F.when(odd, F.unix_millis(stamp)).otherwise(epoch)
    number = F.when(odd, F.col("value").cast("string")).otherwise(F.round(F.col("value") * 2, 2).cast("string"))
    values = [number if i == 0 else F.get_json_object("props", "$.k") for i, _ in enumerate(spec.fields)]
    if spec.shape == "parallel":
        data = F.struct(F.array(epoch).alias(spec.time_field), *(F.array(v).alias(f) for v, f in zip(values, spec.fields)))
    else:
        data = F.array(F.struct(epoch.alias(spec.time_field), *(v.alias(f) for v, f in zip(values, spec.fields))))
    body = F.to_json(F.struct(F.lit("0").alias("code"), data.alias("data")))
    return events.select(F.col("event_type").alias("symbol"), "event_id", body.alias("value"))


def _snapshot_documents(spark, sf_dir):
    """One undated list per event, whose record has a symbol of its own."""
    events = table(spark, sf_dir, "events")
    record = F.struct(F.col("event_type").alias("symbol"), F.col("value").alias("oi"))
    body = F.to_json(F.struct(F.lit("0").alias("code"), F.array(record).alias("data")))
    return events.select(F.col("event_type").alias("symbol"), "event_id", body.alias("value"))


def q_read_payload_many(spark, sf_dir):
    """Landed files with up to a hundred records a document; the folder names the symbol."""
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "landed")
    record = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.col("value").alias("taker_buy_volume_usd"),
                      F.col("event_id").cast("string").alias("taker_sell_volume_usd"))
    pages = events.groupBy("event_type", F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(record).alias("data"))
    body = F.to_json(F.struct(F.lit("0").alias("code"), "data"))
    pages.select(F.col("event_type").alias("symbol"), body.alias("value")).write.partitionBy("symbol").text(path)
    read = payloads.read_payload(spark, path, "taker_pair")
    return read.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "buy", "sell")


def _payload_query(spec) -> Query:
    def run(spark, sf_dir):
        parsed = payloads.parse_payload(_payload_documents(spark, sf_dir, spec), spec)
        return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("record_no")
    return run


def q_read_snapshot(spark, sf_dir):
    """Undated records written by Spark and read with the columns they turn out to have."""
    path = scratch_path(spark, "snapshot")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    document = F.to_json(F.struct(F.lit("0").alias("code"), F.array(F.struct(*events.columns)).alias("data")))
    events.select(document.alias("value")).write.text(path)
    return payloads.read_snapshot(spark, path)


def _kline_fields() -> list[Column]:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    zero = F.lit("0")
    return [millis.cast("string"), *(F.col(c).cast("string") for c in ("o", "h", "l", "c", "v")), zero, zero, zero,
            zero, zero, zero]


def _bars_out(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "v")


def q_read_kline_pages(spark, sf_dir):
    pages = candles(spark, sf_dir).select("symbol", F.to_json(F.array(F.array(*_kline_fields()))).alias("value"))
    return _bars_out(klines.parse_kline_pages(pages))


def q_read_kline_csv(spark, sf_dir):
    path = scratch_path(spark, "klines")
    named = candles(spark, sf_dir).select("symbol", *(c.alias(f"_c{i}") for i, c in enumerate(_kline_fields())))
    named.write.partitionBy("symbol").option("compression", "gzip").csv(path)
    return _bars_out(klines.read_kline_csv(spark, path))


def q_read_kline_zips(spark, sf_dir):
    """One archive per symbol and day, as they are landed, each with a header line."""
    def pack(day: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("bars.csv", "open_time,o,h,l,c,v\n" + "\n".join(day["line"]) + "\n")
        symbol = day["symbol"].iloc[0].upper()
        return pd.DataFrame({"path": [f"/landed/{symbol}USDT-15m-{day['day'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    ship_package(spark)
    lines = candles(spark, sf_dir).select("symbol", F.to_date("ts").cast("string").alias("day"),
                                          F.concat_ws(",", *_kline_fields()).alias("line"))
    archives = lines.groupBy("symbol", "day").applyInPandas(pack, "path string, content binary")
    return _bars_out(klines.bars_from_zips(archives))


def q_read_kline_archives(spark, sf_dir):
    """Archives of a symbol's day on disk, a member per half day, the second with a header too."""
    def pack(day: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for late, part in day.groupby("late"):
                archive.writestr(f"half{int(late)}.csv", "open_time,o,h,l,c,v\n" + "\n".join(part["line"]))
        return pd.DataFrame({"name": [f"{day['symbol'].iloc[0].upper()}USDT-15m-{day['day'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    ship_package(spark)
    lines = candles(spark, sf_dir).select("symbol", F.to_date("ts").cast("string").alias("day"), (F.hour("ts") >= 12).alias("late"),
                                          F.concat_ws(",", *_kline_fields()).alias("line"))
    archives = lines.groupBy("symbol", "day").applyInPandas(pack, "name string, content binary")
    path = scratch_path(spark, "archives")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # landing is the one step that is no table: a file at a time passes the driver
    for row in archives.toLocalIterator():
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{row['name']}"))
        out.write(bytearray(row["content"]))
        out.close()
    return _bars_out(klines.read_kline_zips(spark, path, every_member=True))


def q_import_history_csv(spark, sf_dir):
    """Hourly bars kept as CSV with a header, read back with a schema."""
    path = scratch_path(spark, "history-csv")
    hourly = candles(spark, sf_dir, 60).select("symbol", "ts", *BAR_FIELDS)
    hourly.write.option("header", "true").csv(path)
    return history.import_history_csv(spark, path, hourly.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def q_corrupt_documents(spark, sf_dir):
    """Documents of all events, some cut short, some refused, some without data."""
    event = F.col("event_id")
    whole = F.to_json(F.struct(F.lit("0").alias("code"), F.array(F.struct("value")).alias("data")))
    text = (F.when(event % 7 == 0, F.substring(whole, 1, 9)).when(event % 11 == 0, F.lit('{"code":"40001","msg":"no"}'))
            .when(event % 13 == 0, F.lit('{"code":"0"}')).otherwise(whole))
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    return payloads.corrupt_documents(raw).select("event_id", "value")


# history -----------------------------------------------------------------------------------------

_META = {"api_version": "v4", "interval": "1h", "endpoint": "taker_pair"}
_FETCHED = ("2024-02-01 00:00:00", "2024-02-02 00:00:00")


def _history_batches(spark, sf_dir):
    """Every hourly bar, and a later fetch of the recent tail with other values."""
    hourly = candles(spark, sf_dir, 60)
    full = hourly.select("symbol", "ts", F.col("o").alias("buy"), F.col("c").alias("sell"))
    tail = hourly.filter(F.col("ts") >= F.lit(TAIL_FROM).cast("timestamp_ntz")).select(
        "symbol", "ts", F.col("h").alias("buy"), F.col("l").alias("sell"), F.col("v").alias("trades"))
    return full, tail


def _history_out(df: DataFrame) -> DataFrame:
    return df.select("api_version", "interval", "endpoint", "symbol", "ts", "buy", "sell", "trades",
                     F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _upserted(spark, sf_dir) -> str:
    path = scratch_path(spark, "history")
    for batch, fetched in zip(_history_batches(spark, sf_dir), _FETCHED):
        history.upsert_history(batch, path, _META, fetched_at=_stamp(fetched))
    return path


def q_history_upsert(spark, sf_dir):
    return _history_out(history.load_history(spark, _upserted(spark, sf_dir)))


def q_stream_upsert(spark, sf_dir):
    """The same merge fed by a stream of the events file; the last event of an hour wins."""
    path = scratch_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    records = stream.select(F.col("event_type").alias("symbol"), hour.alias("ts"), "event_id", F.col("value").alias("buy"))
    sink = upsert_batches(path, fetched_at=_stamp(_FETCHED[0]), metadata=_META, order_by=["event_id"])
    run_available(records, sink, scratch_path(spark, "stream-checkpoint"))
    return history.load_history(spark, path).select("symbol", "ts", "buy")


def q_stream_upsert_log(spark, sf_dir):
    """Events that land in five files, one micro-batch each, merged into a log; the last batch is handed in twice."""
    events = table(spark, sf_dir, "events")
    landed, path, checkpoint = (scratch_path(spark, n) for n in ("landed", "log", "log-checkpoint"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    key = ["symbol", "ts"]
    sink = log_batches(path, key, ["event_id"], fetched_at=_stamp(_FETCHED[0]))
    bounds = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = (bounds[1] - bounds[0]) // 5 + 1
    for k in range(5):
        part = events.filter(F.floor((F.col("event_id") - bounds[0]) / step) == k)
        part.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(events.schema).parquet(landed)
        records = stream.select(F.col("event_type").alias("symbol"), hour.alias("ts"), "event_id", F.col("value").alias("buy"))
        run_available(records, sink, checkpoint)
    again = part.select(F.col("event_type").alias("symbol"), hour.alias("ts"), "event_id", (F.col("value") + 1).alias("buy"))
    sink(again, 4)
    return UpsertLog(spark, path, key).read().select("symbol", "ts", "buy")


def _append_snapshots(spark, sf_dir) -> str:
    path = scratch_path(spark, "snapshots")
    totals = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    history.append_snapshot(totals.select("event_type", "n"), path, {"endpoint": "oi_exchange"}, _stamp(_FETCHED[0]))
    history.append_snapshot(totals, path, {"endpoint": "oi_exchange"}, _stamp(_FETCHED[1]))
    return path


def q_snapshot_append(spark, sf_dir):
    stored = history.read_table(spark, _append_snapshots(spark, sf_dir))
    return stored.select("event_type", "n", "top", "endpoint", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


def q_stream_snapshots(spark, sf_dir):
    path = scratch_path(spark, "stream-snapshots")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sink = snapshot_batches(path, {"endpoint": "oi_exchange"}, _stamp(_FETCHED[0]))
    run_available(stream.select("event_id", "value"), sink, scratch_path(spark, "stream-checkpoint"))
    return history.read_table(spark, path).select("event_id", "value", "endpoint", "batch_id")


def q_save_bars(spark, sf_dir):
    return history.save_bars(candles(spark, sf_dir), scratch_path(spark, "bars"), scratch_path(spark, "manifest"))


def q_refresh_bars(spark, sf_dir):
    """15-minute archives with a later page of the same bars and bars that are still forming."""
    archives = candles(spark, sf_dir)
    pages = archives.filter(F.col("ts") >= F.lit(TAIL_FROM).cast("timestamp_ntz")).withColumn("c", F.col("h"))
    path = scratch_path(spark, "refresh")
    as_of = F.lit(REFRESH_AS_OF).cast("timestamp_ntz")
    refresh.refresh_bars(archives, pages, path, symbols(spark, sf_dir), as_of)
    return history.read_table(spark, path).select("symbol", "ts", "o", "h", "l", "c", "v")


def q_refresh_endpoints(spark, sf_dir):
    """Documents of five endpoints, a global one and a snapshot among them; the last record of a second wins."""
    names = {"click": "taker_pair", "view": "basis", "error": "fr", "signup": "cgdi", "purchase": "oi_exchange"}
    landed = None
    for event_type, name in names.items():
        spec = spec_for(name)
        documents = _snapshot_documents(spark, sf_dir) if spec.shape == "snapshot" else _payload_documents(spark, sf_dir, spec)
        symbol, interval = F.lit("BTC" if spec.scope != "global" else None), F.lit("4h" if spec.scope == "symbol_interval" else None)
        part = documents.filter(F.col("symbol") == event_type).select(
            symbol.cast("string").alias("symbol"), interval.cast("string").alias("interval"),
            F.lit(name).alias("endpoint"), "value")
        landed = part if landed is None else landed.unionByName(part)
    summary = refresh.refresh_endpoints(landed, [spec_for(n) for n in names.values()], scratch_path(spark, "endpoints"),
                                        _stamp(_FETCHED[0]))
    named = refresh.with_scope_names(summary)
    return named.withColumns({c: F.date_trunc("second", c).cast("timestamp_ntz") for c in ("start", "end")})


def q_document_report(spark, sf_dir):
    """Broken and refused documents, answers without data, foreign symbols and an endpoint nobody asked for."""
    spec, k = spec_for("coinbase_premium"), F.col("event_id") % 7
    landed = _payload_documents(spark, sf_dir, spec).select(
        F.when(k == 0, "ETH").otherwise("BTC").alias("symbol"), F.when(k == 1, "other").otherwise(spec.name).alias("endpoint"),
        F.when(k == 2, "broken {").when(k == 3, '{"code": "1", "data": []}').when(k == 4, '{"code": "0"}').otherwise(
            F.col("value")).alias("value"))
    return refresh.document_report(landed, [spec])


def _endpoint_history(spark, sf_dir) -> DataFrame:
    """Hourly history in which each event type stands for one endpoint."""
    names = {"click": "taker_pair", "view": "taker_agg", "error": "basis", "signup": "fr_oi_weight",
             "purchase": "fear_greed"}
    lookup = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    hourly = candles(spark, sf_dir, 60)
    return hourly.select(
        lookup[F.col("symbol")].alias("endpoint"), F.lit("BTC").alias("symbol"),
        F.when(F.hour("ts") % 2 == 0, "4h").otherwise("1d").alias("interval"), "ts", F.col("c").alias("value"))


def q_export_taker(spark, sf_dir):
    return history.export_taker(_endpoint_history(spark, sf_dir), "4h")


def q_export_daily(spark, sf_dir):
    return history.export_daily(_endpoint_history(spark, sf_dir))


def q_export_global(spark, sf_dir):
    return history.export_global(_endpoint_history(spark, sf_dir)).select("endpoint", "ts", "fear_greed")


# the plans for long series -----------------------------------------------------------------------

#: Rows that a task may hold in the entries below, so that every series of the given tables is cut into pieces.
PIECE_ROWS = 128
IN_BLOCKS = ("forward_returns", "zscore_rolling", "zscore_expanding", "equity_curves", "max_drawdown", "calmar", "metric_flags",
             "hedge_ratio", "half_life", "coint_screen", "ic_decay", "quantile_returns", "signal_sweep", "walk_forward_backtest",
             "spread_trades", "spread_equity")


def _in_blocks(query: Query) -> Query:
    """The same query under a layout measured as if a task could hold only ``PIECE_ROWS`` rows."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _limit.set(PIECE_ROWS)
        try:
            return query(spark, sf_dir)
        finally:
            _limit.reset(before)

    return run


def registered() -> dict[str, Query]:
    named = {name.removeprefix("q_"): function for name, function in globals().items() if name.startswith("q_")}
    snapshots = {s.name for s in SNAPSHOT_SPECS}
    readers = {f"read_payload_{s.name}": _payload_query(s) for s in SPECS.values() if s.name not in snapshots}
    blocks = {f"{name}_blocks": _in_blocks(named[name]) for name in IN_BLOCKS}
    return {**named, **readers, **blocks}
