import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe import Layout, align_pairs, build_spread, coint_screen, half_life, rolling_hedge_ratio
from quantframe.operators.coint import p_value
from support import BOTH, PIECES, PLAIN, one, panel, reverting, series, walk


def aligned(spark, named, pairs, layout=PLAIN):
    return align_pairs(panel(spark, named), spark.createDataFrame(pairs, "a_id string, b_id string"), layout=layout)


@BOTH
def test_spread_of_common_dates(spark, layout):
    a = series(np.arange(100.0))
    shifted = series(np.arange(100.0), start="2020-01-31")
    df = build_spread(aligned(spark, {"a": a, "b": a / 2, "c": shifted}, [("a", "b"), ("a", "c")], layout), 2.0)
    assert df.filter("b_id = 'b'").agg(F.max(F.abs("spread")), F.count("*")).first()[:] == (0.0, 100)
    assert df.filter("b_id = 'c'").count() == 70


@BOTH
def test_hedge_ratio_uses_only_earlier_rows(spark, layout):
    b, noisy = series(np.arange(100.0, 300.0)), walk(200)
    named = {"a": 2 * b + 10, "b": b, "n": noisy, "flat": series([5.0] * 200)}
    df = aligned(spark, named, [("a", "b"), ("a", "n"), ("a", "flat")], layout)
    got = rolling_hedge_ratio(df, 60, layout=layout).toPandas().sort_values("ts")
    straight = got[got["b_id"] == "b"]["hedge_ratio"].astype(float).to_numpy()
    assert np.isnan(straight[:60]).all() and straight[-1] == pytest.approx(2.0)
    assert got[got["b_id"] == "flat"]["hedge_ratio"].isna().all()
    rolled = named["a"].rolling(60).cov(noisy) / noisy.rolling(60).var()
    np.testing.assert_allclose(got[got["b_id"] == "n"]["hedge_ratio"].astype(float), rolled.shift(1), rtol=1e-6)


@BOTH
def test_half_life(spark, layout):
    fast = reverting(2000)
    gaps = fast.copy()
    gaps.iloc[::50] = np.nan
    drift = series(np.cumsum(np.random.RandomState(1).normal(0.5, 0.1, 200)))
    got = one(half_life(panel(spark, {"fast": fast, "drift": drift, "few": series(np.arange(5.0)),
                                      "flat": series([1.0] * 50), "gaps": gaps, "none": series([np.nan] * 3)}), layout=layout))
    assert abs(got["fast"]["half_life"] - math.log(2) / -math.log(0.9)) < 2
    assert got["drift"]["half_life"] > 50
    assert all(got[k]["half_life"] == math.inf for k in ("few", "flat", "none"))
    present = gaps.dropna().to_numpy()
    slope = np.polyfit(present[:-1], np.diff(present), 1)[0]
    assert got["gaps"]["half_life"] == pytest.approx(-math.log(2) / slope)


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """The two regressions written out with least squares on whole design matrices."""
    design = np.column_stack([b, np.ones(len(b))])
    e = a - design @ np.linalg.lstsq(design, a, rcond=None)[0]
    n = len(e)
    max_lag = min(n // 2 - 1, math.ceil(12 * (n / 100) ** 0.25))
    d = np.diff(e)

    def fit(lags, first):
        y = d[first:]
        x = np.column_stack([e[first:-1]] + [d[first - k: len(d) - k] for k in range(1, lags + 1)])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        return x, beta, float(np.sum((y - x @ beta) ** 2)), len(y)

    def aic(lags):
        _, _, rest, m = fit(lags, max_lag)
        return m * (math.log(2 * math.pi * rest / m) + 1) + 2 * (lags + 1)

    best = min(range(max_lag + 1), key=aic)
    x, beta, rest, m = fit(best, best)
    return beta[0] / math.sqrt(rest / (m - best - 1) * np.linalg.inv(x.T @ x)[0, 0]), best


@pytest.mark.parametrize("layout", [PLAIN, Layout(chunk_hours=24 * 7, block_rows=64)], ids=["plain", "pieces"])
def test_cointegration_equals_brute_force(spark, layout):
    common = walk(400).to_numpy()
    rng = np.random.RandomState(8)
    named = {"x": series(common), "tied": series(2 * common + 3 + reverting(400, 0.3).to_numpy() * 0.2),
             "other": walk(400, seed=77), "same": series(3 * common + 1), "short": series(rng.normal(size=150))}
    pairs = [("tied", "x"), ("other", "x"), ("same", "x"), ("short", "x"), ("tied", "other")]
    got = coint_screen(aligned(spark, named, pairs), layout=layout).toPandas().set_index(["a_id", "b_id"])
    for pair in pairs:
        row = got.loc[pair]
        if pair == ("same", "x"):
            assert row["collinear"] and row["t_stat"] == -math.inf and row["p_value"] == 0
            continue
        a, b = (named[k].iloc[: row["n_obs"]].to_numpy() for k in pair)
        statistic, lag = engle_granger(a, b)
        assert row["used_lag"] == lag
        assert row["t_stat"] == pytest.approx(statistic, rel=1e-6)
        assert row["p_value"] == pytest.approx(p_value(statistic), rel=1e-6)
    assert got.loc[("tied", "x")]["p_value"] < 0.01 < got.loc[("other", "x")]["p_value"]
    assert got.loc[("tied", "x")]["hedge_ratio"] == pytest.approx(2, abs=0.1)
    crit = got.loc[("tied", "x")][["crit_1pct", "crit_5pct", "crit_10pct"]].tolist()
    assert crit == sorted(crit) and crit[0] == pytest.approx(-3.89644 - 10.9519 / 399 - 22.527 / 399 ** 2)


def test_cointegration_ranks_true_pairs_first_over_many_draws(spark):
    """Independent walks reject rarely, tied ones nearly always."""
    named, pairs = {}, []
    for k in range(20):
        base = walk(300, seed=100 + k)
        named[f"base{k}"] = base
        named[f"free{k}"] = walk(300, seed=500 + k)
        named[f"tied{k}"] = base * 1.5 + reverting(300, 0.2, seed=900 + k) * 0.3
        pairs += [(f"free{k}", f"base{k}"), (f"tied{k}", f"base{k}")]
    got = coint_screen(aligned(spark, named, pairs), layout=PLAIN).toPandas()
    tied = got["a_id"].str.startswith("tied")
    assert (got[tied]["p_value"] < 0.05).sum() >= 18 and (got[~tied]["p_value"] < 0.05).sum() <= 4
    top = coint_screen(aligned(spark, named, pairs), layout=PLAIN, top=5).collect()
    assert len(top) == 5 and [r["p_value"] for r in top] == sorted(r["p_value"] for r in top)


def test_p_values_at_the_critical_values():
    assert [round(p_value(t), 3) for t in (-3.89644, -3.33613, -3.04445)] == [0.01, 0.05, 0.1]
    assert (p_value(-20), p_value(2)) == (0.0, 1.0)


def test_too_short_pairs_have_no_statistic(spark):
    got = coint_screen(aligned(spark, {"a": walk(8), "b": walk(8, seed=1)}, [("a", "b")]), layout=PIECES).first()
    assert got["t_stat"] is None and got["p_value"] is None and got["n_obs"] == 8
    assert isinstance(pd.DataFrame([got.asDict()]), pd.DataFrame)
