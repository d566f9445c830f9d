import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe import (
    CostModel, CryptoCost, FxCost, SpreadRules, run_signal_backtest, run_spread_backtest, sweep_signal_backtest,
    sweep_spread_backtest, with_costs, with_instrument_costs)
from support import BOTH, PIECES, PLAIN, frame, one, panel, reverting, series, walk


# costs -------------------------------------------------------------------------------------------

def cost_of(spark, model, notional, days=0):
    return with_costs(spark.range(1), model, float(notional), days).first()["cost"]


def test_cost_models(spark):
    assert cost_of(spark, CryptoCost(5), 10_000) == 10
    assert cost_of(spark, CryptoCost(2.5), 10_000) == 5
    assert cost_of(spark, FxCost(2, 0.0001), 100_000) == pytest.approx(20)
    swap = spark.range(1).select(FxCost(swap_per_day=-0.5).swap_cost(1.0, 10)).first()[0]
    assert swap == 5
    assert cost_of(spark, FxCost(1, 0.0001, 0.0001), 100_000, 5) == pytest.approx(60)


def test_own_cost_models(spark):
    class Flat(CostModel):
        def round_trip_cost(self, notional=1.0):
            return F.lit(7.0)

    assert cost_of(spark, Flat(), 1) == 7
    assert cost_of(spark, lambda notional, days: notional / 2 + days, 10, 3) == 8
    with pytest.raises(NotImplementedError):
        CostModel().round_trip_cost()


def test_costs_from_a_table(spark):
    trades = spark.createDataFrame([("a", 1000.0, 2), ("b", 1000.0, 2), ("c", 1.0, 1)], "series_id string, size double, days int")
    table = spark.createDataFrame([("a", "crypto", 5.0, None, None, None), ("b", "fx", None, 1.0, 0.0001, 0.001)],
                                  "series_id string, kind string, taker_bps double, spread_pips double, pip_value double, swap_per_day double")
    got = one(with_instrument_costs(trades, table, F.col("size"), F.col("days")))
    assert got["a"]["cost"] == pytest.approx(1.0) and got["b"]["cost"] == pytest.approx(2.1) and got["c"]["cost"] is None


# fixed holding -----------------------------------------------------------------------------------

def signals(spark, named):
    return panel(spark, named, "signal")


def brute_signal_trades(signal, price, hold, bps):
    both = pd.concat([signal.rename("s"), price.rename("p")], axis=1).dropna().sort_index()
    rows = []
    for entry, leave in zip(range(0, len(both), hold), range(hold, len(both), hold)):
        side, start, end = int(both["s"].iloc[entry]), both["p"].iloc[entry], both["p"].iloc[leave]
        if side and start > 0:
            rows.append((both.index[entry], both.index[leave], side, side * (end / start - 1) - bps / 5000))
    return rows


@BOTH
def test_trades_equal_brute_force(spark, layout):
    rng = np.random.RandomState(2)
    price, other = walk(200), walk(150, seed=6)
    price.iloc[[14, 50]] = [np.nan, -1.0]
    sides = {"a": series(rng.choice([-1, 0, 1], 200)), "b": series(rng.uniform(-2.9, 2.9, 150))}
    sides["a"].iloc[20:25] = np.nan
    prices = {"a": price, "b": other}
    for hold in (1, 7):
        got = run_signal_backtest(signals(spark, sides), panel(spark, prices), hold, 5.0, layout=layout)["trades"].toPandas()
        for name in prices:
            part = got[got["series_id"] == name].sort_values("entry_date")
            want = brute_signal_trades(sides[name], prices[name], hold, 5.0)
            assert [tuple(r) for r in part[["entry_date", "exit_date", "position"]].itertuples(index=False)] == [w[:3] for w in want]
            np.testing.assert_allclose(part["net_return"], [w[3] for w in want])


@BOTH
def test_summary(spark, layout):
    rising = series(100 * 1.001 ** np.arange(200))
    named = {"up": series([1.0] * 200), "flat": series([0.0] * 200), "short": series([1.0] * 5)}
    prices = panel(spark, {"up": rising, "flat": rising, "short": rising[:5]})
    free = one(run_signal_backtest(signals(spark, named), prices, 14, 0.0, layout=layout)["summary"])
    paid = one(run_signal_backtest(signals(spark, named), prices, 14, 5.0, layout=layout)["summary"])
    assert free["up"]["n_trades"] == 14 and free["up"]["win_rate"] == 1 and free["up"]["profit_factor"] == np.inf
    assert paid["up"]["avg_return_pct"] == pytest.approx(free["up"]["avg_return_pct"] - 0.1)
    for name in ("flat", "short"):
        assert [free[name][c] for c in ("sharpe", "max_drawdown", "win_rate", "profit_factor", "n_trades", "avg_return_pct")] \
            == [None, 0.0, None, None, 0, 0.0]


@BOTH
def test_summary_numbers_and_cost(spark, layout):
    rng = np.random.RandomState(5)
    price, side = walk(500, seed=9, sd=0.02), series(rng.choice([-1, 1], 500))
    trades = [w[3] for w in brute_signal_trades(side, price, 14, 5.0)]
    r = pd.Series(trades)
    got = one(run_signal_backtest(signals(spark, {"a": side}), panel(spark, {"a": price}), 14, 5.0, layout=layout)["summary"])["a"]
    equity = (1 + r).cumprod()
    assert got["sharpe"] == pytest.approx(r.mean() / r.std() * np.sqrt(365 / 14))
    assert got["max_drawdown"] == pytest.approx((equity / equity.cummax() - 1).min())
    assert got["profit_factor"] == pytest.approx(r[r > 0].sum() / -r[r < 0].sum())
    free = one(run_signal_backtest(signals(spark, {"a": side}), panel(spark, {"a": price}), 14, 0.0, layout=layout)["summary"])["a"]
    assert free["sharpe"] > got["sharpe"]


def test_total_loss_is_reported(spark):
    price = series([100, 200, 100, 250, 100, 300.0])
    got = one(run_signal_backtest(signals(spark, {"a": series([-1.0] * 6)}), panel(spark, {"a": price}), 1, layout=PLAIN)["summary"])["a"]
    assert got["status"] == "non_positive_equity" and got["max_drawdown"] is None and got["n_trades"] == 5


@BOTH
def test_sweep_equals_single_runs(spark, layout):
    side, price = {"a": series(np.sign(np.sin(np.arange(120.0)))), "b": series([1.0] * 90)}, {"a": walk(120), "b": walk(90, seed=3)}
    params = [{"holding_days": 3, "cost_bps": 0.0}, {"holding_days": 10, "cost_bps": 8.0}]
    swept = sweep_signal_backtest(signals(spark, side), panel(spark, price), params, layout=layout)["summary"].toPandas()
    for i, p in enumerate(params):
        alone = run_signal_backtest(signals(spark, side), panel(spark, price), p["holding_days"], p["cost_bps"], layout=layout)
        want = alone["summary"].toPandas().sort_values("series_id").reset_index(drop=True)
        got = swept[swept["param_id"] == i].sort_values("series_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(got[want.columns], want)


# spreads -----------------------------------------------------------------------------------------

class Position:
    """One series walked bar by bar: what the rules say, without blocks or maps."""

    def __init__(self, rules):
        self.rules, self.side, self.since, self.done = rules, 0, None, []

    def reason(self, i, z):
        r, away = self.rules, -self.side * z
        if r.max_holding_bars is not None and i - self.since >= r.max_holding_bars:
            return "max_hold"
        if away > r.stop_z:
            return "stop"
        return "reversion" if away <= r.exit_z else None

    def bar(self, i, z):
        if self.side:
            why = self.reason(i, z)
            if why:
                self.close(i, why)
        elif abs(z) > self.rules.entry_z:
            self.side, self.since = (-1 if z > 0 else 1), i

    def close(self, i, why):
        self.done.append((self.since, i, self.side, why))
        self.side = 0


def brute_spread(s, rules):
    s = s.dropna()
    rolling = s.replace([np.inf, -np.inf], np.nan).rolling(rules.lookback)
    z = (s - rolling.mean()) / (rolling.std() + 1e-10)
    walker, pnl = Position(rules), pd.Series(0.0, index=s.index)
    if len(s) < rules.lookback + 10:
        return [], pnl[:0]
    for i in range(rules.lookback, len(s)):
        if not np.isfinite(z.iloc[i]):
            continue
        pnl.iloc[i] += walker.side * (s.iloc[i] - s.iloc[i - 1]) if walker.side else 0
        closed = len(walker.done)
        walker.bar(i, z.iloc[i])
        pnl.iloc[i] -= rules.cost_per_trade * (len(walker.done) - closed)
    if walker.side:
        walker.close(len(s) - 1, "end_of_data")
        pnl.iloc[-1] -= rules.cost_per_trade
    trades = [(s.index[a], s.index[b], side, why, b - a, side * (s.iloc[b] - s.iloc[a]) - rules.cost_per_trade)
              for a, b, side, why in walker.done]
    return trades, pnl.iloc[rules.lookback:] if trades else pnl[:0]


RULES = [
    SpreadRules(lookback=20, capital_base=100.0),
    SpreadRules(entry_z=1.0, exit_z=0.5, stop_z=1.8, lookback=20, cost_per_trade=0.1, capital_base=500.0, max_holding_bars=5),
    SpreadRules(entry_z=1.2, exit_z=-0.5, stop_z=9.0, lookback=12, max_holding_bars=40, capital_base=1000.0),
    SpreadRules(entry_z=0.8, exit_z=0.0, stop_z=2.0, lookback=12, max_holding_bars=1, capital_base=1000.0),
]


@BOTH
def test_spread_trades_and_equity_equal_brute_force(spark, layout):
    """Several rule sets and series in one job, with gaps, infinities and short and flat series."""
    named = {"ou": reverting(400), "slow": reverting(300, 0.02, seed=3), "gaps": reverting(250, 0.3, seed=5),
             "flat": series([100.0] * 60), "short": reverting(25, seed=6), "fall": series(np.linspace(0, -10, 200))}
    named["gaps"].iloc[[30, 31, 90]] = np.nan
    named["gaps"].iloc[120] = np.inf
    results = sweep_spread_backtest(panel(spark, named), RULES, layout=layout)
    trades, equity, summary = (results[k].toPandas() for k in ("trades", "equity", "summary"))
    assert len(summary) == len(named) * len(RULES)
    for k, rules in enumerate(RULES):
        for name, s in named.items():
            def part(df):
                return df[(df["series_id"] == name) & (df["param_id"] == k)]
            want, pnl = brute_spread(s, rules)
            got = part(trades).sort_values("exit_date")
            columns = ["entry_date", "exit_date", "position", "exit_reason", "holding_bars"]
            assert [tuple(r) for r in got[columns].itertuples(index=False)] == [w[:5] for w in want], (name, k)
            np.testing.assert_allclose(got["pnl"], [w[5] for w in want], atol=1e-9)
            np.testing.assert_allclose(got["return"], got["pnl"] / rules.capital_base)
            bars = part(equity).sort_values("ts")
            assert list(bars["ts"]) == list(pnl.index)
            np.testing.assert_allclose(bars["daily_pnl"], pnl, atol=1e-9)
            np.testing.assert_allclose(bars["equity"], 1 + (pnl / rules.capital_base).cumsum(), rtol=1e-9)
            row = part(summary).iloc[0]
            assert row["n_trades"] == len(want)
            if want:
                won = np.array([w[5] for w in want])
                assert row["win_rate"] == pytest.approx((won > 0).mean())
                assert row["avg_holding"] == pytest.approx(np.mean([w[4] for w in want]))
                returns = pnl / rules.capital_base
                assert row["sharpe"] == pytest.approx(returns.mean() / returns.std() * np.sqrt(252))
                assert row["capital_base"] == rules.capital_base
            else:
                assert row["max_drawdown"] == 0 and pd.isna(row["sharpe"]) and pd.isna(row["capital_base"])
    assert {"reversion", "stop", "max_hold", "end_of_data"} == set(trades["exit_reason"])


@BOTH
def test_entry_on_the_last_bar_is_closed_there(spark, layout):
    s = series([0.0, 1.0] * 20 + [9.0])
    got = run_spread_backtest(panel(spark, {"a": s}), lookback=20, cost_per_trade=0.5, layout=layout)
    trade = got["trades"].collect()
    assert len(trade) == 1
    assert (trade[0]["holding_bars"], trade[0]["exit_reason"], trade[0]["pnl"]) == (0, "end_of_data", -0.5)
    assert trade[0]["exit_date"] == s.index[-1].to_pydatetime()
    last = got["equity"].orderBy(F.desc("ts")).first()
    assert last["daily_pnl"] == -0.5 and got["summary"].first()["win_rate"] == 0


@BOTH
def test_lost_capital_leaves_the_drawdown_open(spark, layout):
    s = series(list(np.tile([0.0, 1.0], 15)) + [4.0, 8.0, 16.0, 40.0])
    got = run_spread_backtest(panel(spark, {"a": s}), lookback=20, entry_z=2.0, stop_z=50.0, layout=layout)["summary"].first()
    assert got["equity_warning"] and got["max_drawdown"] is None and got["n_trades"] == 1


def test_capital_must_be_positive(spark):
    with pytest.raises(ValueError, match="capital_base must be positive"):
        run_spread_backtest(panel(spark, {"a": reverting(100)}), capital_base=0)


def test_cost_lowers_profit(spark):
    df = panel(spark, {"a": reverting(500)})
    free = run_spread_backtest(df, lookback=20, capital_base=100, layout=PIECES)
    paid = run_spread_backtest(df, lookback=20, capital_base=100, cost_per_trade=0.2, layout=PIECES)
    trades = free["trades"].count()
    assert free["trades"].agg(F.sum("pnl")).first()[0] > 0
    assert paid["trades"].agg(F.sum("pnl")).first()[0] == pytest.approx(free["trades"].agg(F.sum("pnl")).first()[0] - 0.2 * trades)
    assert paid["summary"].first()["sharpe"] < free["summary"].first()["sharpe"]
    assert frame(spark, "ts timestamp_ntz", pd.DataFrame({"ts": [dt.datetime(2020, 1, 1)]})).count() == 1
