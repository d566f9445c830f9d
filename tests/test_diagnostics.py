import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe import forward_returns, ic_decay, ic_direction, quantile_returns, rank_ic
from quantframe.operators.diagnostics import horizon_of
from support import BOTH, frame, one, panel, series, walk

PAIRS = "series_id string, factor double, fwd_ret double"


def pairs(spark, named):
    rows = pd.concat([pd.DataFrame({"series_id": k, "factor": np.asarray(f, float), "fwd_ret": np.asarray(r, float)})
                      for k, (f, r) in named.items()])
    return frame(spark, PAIRS, rows)


@BOTH
def test_rank_ic(spark, layout):
    up = np.arange(100.0)
    gaps = np.arange(12.0)
    gaps[[3, 7]] = np.nan
    rng = np.random.RandomState(1)
    tied, noisy = rng.randint(0, 5, 200).astype(float), rng.normal(size=200)
    noisy[5] = np.inf
    got = one(rank_ic(pairs(spark, {
        "up": (up, up), "down": (up, -up), "two": (up[:2], up[:2]), "gaps": (gaps, np.arange(12.0)),
        "flat": (np.ones(30), np.arange(30.0)), "tied": (tied, noisy), "none": ([np.nan], [1.0])}), layout=layout))
    assert got["up"]["ic"] == pytest.approx(1) and got["down"]["ic"] == pytest.approx(-1)
    assert got["two"]["ic"] is None and got["flat"]["ic"] is None
    assert got["gaps"]["n_finite"] == 10 and got["gaps"]["ic"] == pytest.approx(1)
    keep = np.isfinite(noisy)
    want = pd.Series(tied[keep]).rank().corr(pd.Series(noisy[keep]).rank())
    assert got["tied"]["ic"] == pytest.approx(want, abs=1e-12)
    assert (got["tied"]["n_obs"], got["tied"]["n_finite"]) == (200, 199)
    assert (got["none"]["n_obs"], got["none"]["ic"]) == (0, None)


@BOTH
def test_ic_direction(spark, layout):
    up = np.arange(50.0)
    got = one(ic_direction(pairs(spark, {"up": (up, up), "down": (up, -up), "few": (up[:3], up[:3])}), layout=layout))
    assert {k: r["direction"] for k, r in got.items()} == {"up": 1, "down": -1, "few": 0}
    inside = one(ic_direction(pairs(spark, {"up": (up, up)}), min_abs_ic=1.5, layout=layout))
    assert inside["up"]["direction"] == 0


def wide(spark, named):
    rows = pd.concat([pd.DataFrame({"series_id": k, "ts": f1.index, "fwd_1": f1.to_numpy(), "fwd_3": f3.to_numpy()})
                      for k, (f1, f3) in named.items()])
    return frame(spark, "series_id string, ts timestamp_ntz, fwd_1 double, fwd_3 double", rows)


@BOTH
def test_decay_of_given_returns(spark, layout):
    up = series(np.arange(20.0))
    got = ic_decay(panel(spark, {"a": up, "b": -up}), forward_ret=wide(spark, {"a": (up, -up), "b": (up, -up)}), layout=layout)
    rows = {(r["series_id"], r["horizon"]): r for r in got.collect()}
    assert got.columns == ["series_id", "horizon", "column", "ic", "n_obs"]
    assert rows[("a", 1)]["ic"] == pytest.approx(1) and rows[("a", 3)]["ic"] == pytest.approx(-1)
    assert rows[("b", 1)]["ic"] == pytest.approx(-1) and rows[("b", 3)]["n_obs"] == 20
    picked = ic_decay(panel(spark, {"a": up}), [3], forward_ret=wide(spark, {"a": (up, -up)}), layout=layout)
    assert [r["column"] for r in picked.collect()] == ["fwd_3"]


@BOTH
def test_decay_from_prices_drops_each_horizons_own_tail(spark, layout):
    prices, factor = series(np.linspace(100, 160, 30)), series(np.linspace(1, 30, 30))
    got = ic_decay(panel(spark, {"a": factor}), [1, 5, 40], prices=panel(spark, {"a": prices}), layout=layout)
    assert {r["horizon"]: r["n_obs"] for r in got.collect()} == {1: 29, 5: 25, 40: 0}


def test_decay_arguments(spark):
    factor = panel(spark, {"a": walk(20)})
    forward = wide(spark, {"a": (walk(20), walk(20))})
    with pytest.raises(ValueError, match="exactly one"):
        ic_decay(factor, [1])
    with pytest.raises(ValueError, match="exactly one"):
        ic_decay(factor, [1], prices=factor, forward_ret=forward)
    with pytest.raises(ValueError, match="missing requested columns"):
        ic_decay(factor, [2], forward_ret=forward)
    with pytest.raises(ValueError, match="infer horizon"):
        ic_decay(factor, forward_ret=forward.withColumnRenamed("fwd_1", "next"))
    assert [horizon_of(c) for c in ("fwd_7", "fwd_x", "ret_7", None)] == [7, None, None, None]


def as_forward(df, column="fwd_7"):
    return df.withColumnRenamed("value", column)


@BOTH
@pytest.mark.parametrize("n_quantiles", [4, 5, 10])
def test_quantile_buckets_equal_pandas(spark, layout, n_quantiles):
    rng = np.random.RandomState(3)
    named = {"up": series(np.arange(101.0)), "noise": series(rng.normal(size=333)),
             "ties": series(rng.randint(0, 40, 250)), "short": series(np.arange(11.0))}
    got = quantile_returns(panel(spark, named), n_quantiles, forward_ret=as_forward(panel(spark, named)), layout=layout).toPandas()
    for name, s in named.items():
        want = s.groupby(pd.qcut(s, n_quantiles, labels=False) + 1).agg(["mean", "size"])
        part = got[got["series_id"] == name].sort_values("quantile")
        assert part["quantile"].tolist() == want.index.tolist()
        assert part["count"].tolist() == want["size"].tolist()
        np.testing.assert_allclose(part["mean_return"], want["mean"])
    assert set(got["horizon"]) == {7} and set(got["status"]) == {"ok"}


@BOTH
def test_quantiles_from_prices(spark, layout):
    prices, factor = series(np.linspace(100, 140, 40)), series(np.sin(np.arange(40.0)))
    got = quantile_returns(panel(spark, {"a": factor}), 4, horizon=3, prices=panel(spark, {"a": prices}), layout=layout)
    assert got.columns == ["series_id", "horizon", "quantile", "mean_return", "count", "status"]
    assert got.agg(F.sum("count")).first()[0] == 37


@BOTH
def test_series_that_cannot_be_cut(spark, layout):
    named = {"few": series([1.0, 2.0, 3.0]), "two": series([1.0] * 10 + [2.0] * 10),
             "edges": series([0.0] * 40 + list(range(1, 8))), "fine": series(np.arange(20.0))}
    got = quantile_returns(panel(spark, named), 5, forward_ret=as_forward(panel(spark, named)), layout=layout)
    status = {r["series_id"]: r["status"] for r in got.collect()}
    assert status == {"few": "too_few_rows", "two": "too_few_values", "edges": "duplicate_edges", "fine": "ok"}
    strict = quantile_returns(panel(spark, named), 5, forward_ret=as_forward(panel(spark, named)), strict=True, layout=layout)
    with pytest.raises(Exception, match="too_few|duplicate"):
        strict.collect()


def test_quantile_arguments(spark):
    factor = panel(spark, {"a": walk(20)})
    with pytest.raises(ValueError, match="at least 2"):
        quantile_returns(factor, 1, horizon=1, prices=factor)
    with pytest.raises(ValueError, match="horizon must be provided"):
        quantile_returns(factor, 5, prices=factor)
    with pytest.raises(ValueError, match="exactly one"):
        quantile_returns(factor, 5, horizon=1)
    with pytest.raises(ValueError, match="infer horizon"):
        quantile_returns(factor, 5, forward_ret=factor)
    with pytest.raises(ValueError, match="one return column"):
        quantile_returns(factor, 5, forward_ret=wide(spark, {"a": (walk(20), walk(20))}))


@BOTH
def test_decay_through_forward_returns_equals_decay_from_prices(spark, layout):
    prices = panel(spark, {"a": walk(80), "b": walk(60, seed=9)})
    forward = forward_returns(prices, [2, 7], layout=layout).select("series_id", "ts", "fwd_2", "fwd_7")
    direct = ic_decay(prices, [2, 7], prices=prices, layout=layout).toPandas().sort_values(["series_id", "horizon"])
    given = ic_decay(prices, forward_ret=forward, layout=layout).toPandas().sort_values(["series_id", "horizon"])
    pd.testing.assert_frame_equal(direct.reset_index(drop=True), given.reset_index(drop=True))
