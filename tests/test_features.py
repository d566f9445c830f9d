import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe import add_threshold_signal, forward_returns, zscore, zscore_fixed
from support import BOTH, PIECES, by_series, panel, series, walk


@BOTH
def test_forward_returns(spark, layout):
    growing = series([100, 110, 121, 133.1, 146.41])
    other = walk(60)
    wide = forward_returns(panel(spark, {"a": growing, "b": other}), [1, 2], layout=layout)
    np.testing.assert_allclose(by_series(wide, "fwd_1")["a"], [0.1] * 4 + [np.nan])
    np.testing.assert_allclose(by_series(wide, "fwd_2")["a"], [0.21] * 3 + [np.nan] * 2)
    np.testing.assert_allclose(by_series(wide, "fwd_2")["b"], other.shift(-2) / other - 1)


@pytest.mark.parametrize("horizons,message", [
    (None, "at least one"), ([], "at least one"), ([0], "positive"), ([1, 1], "once")])
def test_bad_horizons(spark, horizons, message):
    with pytest.raises(ValueError, match=message):
        forward_returns(panel(spark, {"a": walk(5)}), horizons)


@BOTH
def test_zero_and_missing_prices(spark, layout):
    wide = forward_returns(panel(spark, {"a": series([0.0, 5.0, np.nan, 5.0])}), [1], layout=layout)
    got = by_series(wide, "fwd_1")["a"]
    assert got[0] == np.inf and np.isnan(got[1:]).all()


@BOTH
def test_rolling_zscore(spark, layout):
    named = {"flat": series([5.0] * 100), "walk": walk(100), "gap": walk(90, seed=3)}
    named["gap"].iloc[40] = np.nan
    named["gap"].iloc[70] = np.inf
    got = by_series(zscore(panel(spark, named), "rolling", 20, layout=layout), "zscore")
    assert np.isnan(got["walk"][:19]).all() and abs(got["flat"][-1]) < 1e-9
    for name, s in named.items():
        rolling = s.rolling(20)
        np.testing.assert_allclose(got[name], (s - rolling.mean()) / (rolling.std() + 1e-10), rtol=1e-7, atol=1e-7)


@BOTH
def test_expanding_zscore(spark, layout):
    named = {"trend": series(np.linspace(1, 5000, 200)), "walk": walk(120), "gap": walk(80, seed=5)}
    named["gap"].iloc[[0, 1, 30]] = np.nan
    got = by_series(zscore(panel(spark, named), "expanding", 20, layout=layout), "zscore")
    for name, s in named.items():
        grown = s.expanding(20)
        np.testing.assert_allclose(got[name], (s - grown.mean()) / (grown.std() + 1e-10), rtol=1e-8, atol=1e-8)


def test_expanding_zscore_over_an_empty_first_chunk(spark):
    s = series([np.nan] * 10 + list(np.arange(30.0)))
    got = by_series(zscore(panel(spark, {"a": s}), "expanding", 5, layout=PIECES), "zscore")["a"]
    grown = s.expanding(5)
    np.testing.assert_allclose(got, (s - grown.mean()) / (grown.std() + 1e-10), rtol=1e-9)


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="rolling"):
        zscore(panel(spark, {"a": walk(5)}), "other")


def test_fixed_zscore(spark):
    df = spark.createDataFrame([(10.0,), (12.0,), (8.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(zscore_fixed(F.col("x"), 10.0, 2.0)).collect()] == [0.0, 1.0, -1.0, None]
    assert df.select(zscore_fixed(F.col("x"), 2.0, 0.0)).distinct().collect() == [(None,)]


def test_threshold_signal(spark):
    scores = [1.0, -1.0, 0.3, -0.3, 0.6, -0.7, 0.5, -0.5, float("nan"), None, float("inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, x double")
    got = [r["signal"] for r in add_threshold_signal(df, "x", 0.5).orderBy("i").collect()]
    assert got == [1, -1, 0, 0, 1, -1, 0, 0, 0, 0, 1]


def test_shared_row_index_is_kept(spark):
    from quantframe import index_rows

    indexed = index_rows(panel(spark, {"a": walk(40)}), ["series_id"], layout=PIECES)
    wide = zscore(forward_returns(indexed, [1], layout=PIECES), "rolling", 5, layout=PIECES)
    assert "row_index" in wide.columns
    assert by_series(wide, "row_index")["a"] == list(range(40))
    assert isinstance(wide.toPandas(), pd.DataFrame)
