import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe import calmar, max_drawdown, metric_flags, profit_factor, sharpe, sortino, win_rate
from support import BOTH, one, panel, series

RNG = np.random.RandomState(42)
DAILY = series(RNG.normal(0.001, 0.02, 252))
FORTNIGHTLY = series(RNG.normal(0.005, 0.03, 26))
GAPS = series(np.tile([0.01, -0.02, np.nan, 0.03, 0.005, np.inf], 20))


def test_sharpe(spark):
    named = {"daily": DAILY, "flat": series([0.01] * 100), "single": series([0.01]), "gaps": GAPS, "none": series([np.nan])}
    got = one(sharpe(panel(spark, named)))
    assert got["daily"]["sharpe"] == pytest.approx(DAILY.mean() / DAILY.std() * np.sqrt(365))
    assert [got[k]["sharpe"] for k in ("flat", "single", "none")] == [None] * 3
    finite = GAPS[np.isfinite(GAPS)]
    assert got["gaps"]["sharpe"] == pytest.approx(finite.mean() / finite.std() * np.sqrt(365))
    assert (got["gaps"]["n_obs"], got["single"]["small_sample_warning"], got["none"]["n_obs"]) == (80, True, 0)


def test_annualisation_follows_the_holding_period(spark):
    df = panel(spark, {"a": FORTNIGHTLY})
    right, wrong = one(sharpe(df, 14))["a"]["sharpe"], one(sharpe(df, 1))["a"]["sharpe"]
    assert wrong / right == pytest.approx(np.sqrt(14))


def test_risk_free_rate_is_per_period(spark):
    rate = 1.05 ** (14 / 365) - 1
    want = (FORTNIGHTLY - rate).mean() / FORTNIGHTLY.std() * np.sqrt(365 / 14)
    assert one(sharpe(panel(spark, {"a": FORTNIGHTLY}), 14, risk_free=0.05))["a"]["sharpe"] == pytest.approx(want)


def test_sortino(spark):
    mixed = series([0.02, -0.01, 0.03, -0.02])
    got = one(sortino(panel(spark, {"up": series([0.01, 0.02, 0.005]), "mixed": mixed, "single": series([0.1]),
                                    "zero": series([0.0, 0.0])})))
    assert got["up"]["sortino"] == np.inf and got["zero"]["sortino"] == np.inf and got["single"]["sortino"] is None
    deviation = np.sqrt(np.mean(np.minimum(mixed, 0) ** 2))
    assert got["mixed"]["sortino"] == pytest.approx(mixed.mean() / deviation * np.sqrt(365))


@BOTH
def test_max_drawdown(spark, layout):
    long = series(np.exp(np.cumsum(RNG.normal(0, 0.02, 400))))
    named = {"fall": series([100, 120, 90, 110]), "rise": series([100, 101, 102, 103]), "deep": series([100, 50, 25]),
             "zero": series([1, 0, 1.1]), "one": series([-5.0]), "gap": series([1, np.nan, 2]), "inf": series([1, np.inf, 2]),
             "long": long, "late": series([100.0] * 20 + [200.0] * 20 + [50.0])}
    got = one(max_drawdown(panel(spark, named), layout=layout))
    depth = {k: r["max_drawdown"] for k, r in got.items()}
    assert depth["fall"] == pytest.approx(-0.25) and depth["rise"] == 0 and depth["deep"] == pytest.approx(-0.75)
    assert depth["one"] == 0 and depth["late"] == pytest.approx(-0.75)
    assert depth["long"] == pytest.approx((long / long.cummax() - 1).min())
    assert [depth[k] for k in ("zero", "gap", "inf")] == [None] * 3
    assert got["zero"]["status"] == "non_positive_equity" and got["gap"]["status"] == "non_finite_equity"
    with pytest.raises(Exception, match="strictly positive"):
        max_drawdown(panel(spark, {"zero": named["zero"]}), strict=True, layout=layout).collect()


@BOTH
def test_calmar(spark, layout):
    wave, drift = series([0.10, -0.10] * 50), series(RNG.normal(0.002, 0.02, 300))
    ruin = series([0.1] * 10 + [-1.0] + [0.2] * 10)
    got = one(calmar(panel(spark, {"wave": wave, "drift": drift, "up": series([0.01] * 30), "one": series([0.1]), "ruin": ruin}),
                     layout=layout))
    for name, s in (("wave", wave), ("drift", drift)):
        equity = (1 + s).cumprod()
        annual = equity.iloc[-1] ** (365 / len(s)) - 1
        assert got[name]["calmar"] == pytest.approx(annual / abs((equity / equity.cummax() - 1).min()))
    assert [got[k]["calmar"] for k in ("up", "one", "ruin")] == [None] * 3
    assert got["ruin"]["status"] == "non_positive_equity" and got["one"]["n_obs"] == 1


def test_win_rate_and_profit_factor(spark):
    named = {"a": series([0.1, -0.05, 0.03, -0.01, 0.02]), "zeros": series([0.1, 0, -0.05, 0, 0.03]),
             "gains": series([0.01, 0.02]), "none": series([0.0, 0.0])}
    wins, factors = one(win_rate(panel(spark, named))), one(profit_factor(panel(spark, named)))
    assert wins["a"]["win_rate"] == pytest.approx(0.6) and wins["zeros"]["win_rate"] == pytest.approx(2 / 3)
    assert wins["none"]["win_rate"] is None
    assert factors["a"]["profit_factor"] == pytest.approx(0.15 / 0.06)
    assert factors["gains"]["profit_factor"] == np.inf and factors["none"]["profit_factor"] is None


@BOTH
def test_flags(spark, layout):
    prices = series(100 * np.exp(np.cumsum(RNG.normal(0, 0.02, 400))))
    overlapping = (prices.shift(-14) / prices - 1).dropna()
    named = {"overlap": overlapping, "clean": FORTNIGHTLY, "few": series([0.01, -0.02, 0.015, 0.005, -0.01]),
             "flat": series([0.5] * 30), "none": series([np.nan, np.nan])}
    got = one(metric_flags(panel(spark, named), layout=layout))
    assert got["overlap"]["overlap_warning"] and not got["clean"]["overlap_warning"]
    assert got["overlap"]["lag1_autocorr"] == pytest.approx(overlapping.autocorr(1))
    assert got["few"]["small_sample_warning"] and got["few"]["lag1_autocorr"] is None
    assert got["flat"]["lag1_autocorr"] is None and not got["flat"]["overlap_warning"]
    assert got["none"]["n_obs"] == 0


def test_metrics_accept_any_grouping(spark):
    df = panel(spark, {"a": DAILY, "b": DAILY}).withColumn("fold_idx", F.month("ts") % 2)
    assert sharpe(df, keys=["series_id", "fold_idx"]).count() == 4


@BOTH
@pytest.mark.parametrize("returns, status", [
    ([0.5] * 3000 + [-0.2] * 10, "non_finite_equity"), ([-0.5] * 1200, "non_positive_equity")])
def test_curves_beyond_doubles_are_told_in_both_layouts(spark, layout, returns, status):
    row = one(calmar(panel(spark, {"A": series(returns)}), layout=layout))["A"]
    assert (row["status"], row["calmar"], row["max_drawdown"]) == (status, None, None)
