import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantframe import rows_in_folds, select_dates, walk_forward_splits, zscore_by_fold
from support import BOTH, dates, frame, panel, series, walk


def folds_of(df):
    return df.toPandas().sort_values("fold_idx").reset_index(drop=True)


def brute_folds(index, train, test, gap, step):
    """Candidates by their definition, one at a time, over the sorted distinct dates."""
    index = pd.DatetimeIndex(sorted(set(index)))
    day, found, k = pd.Timedelta(days=1), [], 0
    while True:
        t0 = index[0] + k * step * day
        s0 = t0 + (train + gap) * day
        if s0 + (test - 1) * day > index[-1]:
            return found
        a = index[(index >= t0) & (index <= t0 + (train - 1) * day)]
        b = index[(index >= s0) & (index <= s0 + (test - 1) * day)]
        if len(a) >= 10 and len(b) >= 5:
            found.append((a[0], a[-1], b[0], b[-1]))
        k += 1


def test_daily_folds(spark):
    got = folds_of(walk_forward_splits(panel(spark, {"a": walk(500), "b": walk(400)}), 90, 90, 14))
    assert len(got) >= 2 and got["fold_idx"].tolist() == list(range(len(got)))
    assert (got["train_start"] < got["train_end"]).all()
    assert ((got["test_start"] - got["train_end"]).dt.days >= 14).all()
    assert (got["test_start"].iloc[1:].to_numpy() > got["test_end"].iloc[:-1].to_numpy()).all()


def test_exactly_one_fold_and_too_short(spark):
    assert walk_forward_splits(panel(spark, {"a": walk(194)}), 90, 90, 14).count() == 1
    short = panel(spark, {"a": walk(100)})
    with pytest.raises(Exception, match="need at least 180"):
        walk_forward_splits(short, 90, 90).collect()
    assert walk_forward_splits(short, 90, 90, strict=False).count() == 0
    assert walk_forward_splits(short.limit(0), 90, 90).count() == 0


@pytest.mark.parametrize("bad", [dict(train_days=0, test_days=5), dict(train_days=5, test_days=5, step_days=0),
                                 dict(train_days=5, test_days=5, embargo_days=-1)])
def test_bad_periods(spark, bad):
    with pytest.raises(ValueError, match="positive"):
        walk_forward_splits(panel(spark, {"a": walk(50)}), **bad)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_folds_equal_brute_force(spark, data):
    """Irregular, intraday and gappy dates, any step."""
    hours = data.draw(st.lists(st.integers(0, 24 * 150), min_size=40, max_size=300))
    train, test = data.draw(st.integers(3, 40)), data.draw(st.integers(3, 30))
    gap, step = data.draw(st.integers(0, 10)), data.draw(st.integers(1, 40))
    index = [pd.Timestamp("2020-01-01") + pd.Timedelta(hours=h) for h in hours]
    df = frame(spark, "ts timestamp_ntz", pd.DataFrame({"ts": index}))
    got = folds_of(walk_forward_splits(df, train, test, gap, step, strict=False))
    want = brute_folds(index, train, test, gap, step)
    assert [tuple(r[1:]) for r in got.itertuples(index=False)] == want
    assert got["fold_idx"].tolist() == list(range(len(want)))


def test_folds_per_series(spark):
    named = {"a": walk(300), "b": series(np.arange(250.0), start="2021-05-05")}
    got = walk_forward_splits(panel(spark, named), 60, 30, 5, keys=["series_id"]).toPandas()
    for name, s in named.items():
        part = folds_of(spark.createDataFrame(got[got["series_id"] == name]))
        assert [tuple(r[2:]) for r in part.itertuples(index=False)] == brute_folds(s.index, 60, 30, 5, 30)


def test_select_dates(spark):
    df = panel(spark, {"a": walk(100)})
    fold = walk_forward_splits(df, 40, 20, 5).orderBy("fold_idx").first()
    train = select_dates(df, fold, "train").agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    assert tuple(train) == (fold["train_start"], fold["train_end"], 40)
    assert select_dates(df, fold, "test").count() == 20
    with pytest.raises(ValueError, match="train"):
        select_dates(df, fold, "other")
    with pytest.raises(ValueError, match="train"):
        rows_in_folds(df, walk_forward_splits(df, 40, 20), "other")


@BOTH
def test_rows_and_scores_by_fold(spark, layout):
    named = {"a": walk(200), "b": walk(180, seed=4), "flat": series([3.0] * 200)}
    df = panel(spark, named)
    folds = walk_forward_splits(df, 60, 30, 7, step_days=20)
    bounds = folds_of(folds)
    rows = rows_in_folds(df, folds).toPandas()
    scored = zscore_by_fold(df, folds, layout=layout).toPandas()
    for f in bounds.itertuples():
        for name, s in named.items():
            inside = s[f.train_start: f.train_end]
            part = rows[(rows["fold_idx"] == f.fold_idx) & (rows["series_id"] == name) & (rows["split"] == "train")]
            assert sorted(part["ts"]) == list(inside.index)
            got = scored[(scored["fold_idx"] == f.fold_idx) & (scored["series_id"] == name)].sort_values("ts")
            test = s[f.test_start: f.test_end]
            want = (test - inside.mean()) / inside.std() if inside.std() >= 1e-10 else test * np.nan
            np.testing.assert_allclose(got["zscore"].astype(float), want, rtol=1e-9)


def test_training_statistics_never_see_test_rows(spark):
    calm = walk(120)
    wild = calm.copy()
    wild.iloc[60:] *= 50
    folds = walk_forward_splits(panel(spark, {"a": calm}), 50, 20, 5).filter("fold_idx = 0")
    stats = {}
    for name, s in (("calm", calm), ("wild", wild)):
        train = rows_in_folds(panel(spark, {"a": s}), folds, "train")
        stats[name] = train.agg(F.avg("value"), F.stddev_samp("value")).first()
    assert stats["calm"] == stats["wild"]
    assert dates(1)[0].to_pydatetime() == dt.datetime(2020, 1, 1)


@BOTH
def test_fold_scores_on_intraday_rows_whose_last_day_is_cut(spark, layout):
    rng = np.random.RandomState(6)
    index = pd.date_range("2020-01-01 15:00", periods=6 * 130, freq="4h").astype("datetime64[us]")
    named = {"a": pd.Series(rng.normal(size=len(index)).cumsum(), index), "b": pd.Series(1e7 + rng.normal(size=len(index)), index)}
    named["b"].iloc[::17] = np.nan
    df = panel(spark, named)
    folds = walk_forward_splits(df, 40, 15, 3, step_days=5)
    bounds = folds_of(folds)
    assert len(bounds) > 10 and (bounds["train_end"].dt.hour != 23).any()
    scored = zscore_by_fold(df, folds, layout=layout).toPandas()
    for f in bounds.itertuples():
        for name, s in named.items():
            inside, test = s[f.train_start: f.train_end], s[f.test_start: f.test_end]
            got = scored[(scored["fold_idx"] == f.fold_idx) & (scored["series_id"] == name)].sort_values("ts")
            np.testing.assert_allclose(got["zscore"].astype(float), (test - inside.mean()) / inside.std(), rtol=1e-8, atol=1e-8)
