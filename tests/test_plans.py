import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantframe import Layout, index_rows, keep_last, measure_layout, running_max, running_product, running_sum
from quantframe.functions.columns import ieee_divide, is_finite, missing_as_null, safe_corr
from quantframe.plans import average_ranks, join_ranges, ordered_counts, over_rows, previous_row
from quantframe.plans.rolling import rolling_moments
from quantframe.plans.skew import join_by_key
from support import BOTH, PIECES, PLAIN, by_series, dates, frame, panel, series, walk

KEYS = ["series_id"]


def test_missing_and_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    rows = df.select(missing_as_null(F.col("x")), is_finite(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(1.0, True), (None, False), (float("inf"), False), (None, False)]


def test_divide_by_zero_keeps_the_sign(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(ieee_divide(F.col("a"), F.col("b"))).collect()]
    assert got == [float("inf"), float("-inf"), None, 1.5]


def test_correlation_with_a_constant_side_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(safe_corr(F.col("a"), F.col("b"))).first()[0] is None


@BOTH
def test_running_columns(spark, layout):
    named = {"a": walk(100), "b": walk(37, seed=1), "c": series([2.0])}
    df = panel(spark, named)
    df = index_rows(df, KEYS, layout=layout, series_rows=True)
    for function, name in ((running_sum, "total"), (running_product, "growth"), (running_max, "top")):
        scale = F.col("value") / 100 if name == "growth" else F.col("value")
        df = function(df, KEYS, scale, name, layout=layout)
    df = previous_row(df, KEYS, "value", "before", layout=layout)
    for name, s in named.items():
        part = df.filter(F.col("series_id") == name)
        assert by_series(part, "row_index")[name] == list(range(len(s)))
        assert set(by_series(part, "series_rows")[name]) == {len(s)}
        np.testing.assert_allclose(by_series(part, "total")[name], s.cumsum(), rtol=1e-12)
        np.testing.assert_allclose(by_series(part, "growth")[name], (s / 100).cumprod(), rtol=1e-12)
        np.testing.assert_allclose(by_series(part, "top")[name], s.cummax())
        np.testing.assert_allclose(by_series(part, "before")[name], s.shift(1))


@BOTH
def test_integer_order_column(spark, layout):
    rows = pd.DataFrame({"series_id": "a", "ts": range(50), "value": np.arange(50.0)})
    df = frame(spark, "series_id string, ts long, value double", rows)
    assert by_series(running_sum(df, KEYS, F.col("value"), "total", layout=layout), "total")["a"] == list(np.cumsum(np.arange(50.0)))


@pytest.mark.parametrize("before,after", [(0, 0), (3, 0), (0, 5), (40, 40)])
def test_frames_reach_over_block_borders(spark, before, after):
    df = panel(spark, {"a": walk(100), "b": walk(33, seed=2)})

    def columns(rows):
        return {"frame_sum": F.sum("value").over(rows.rowsBetween(-before, after))}

    plain = over_rows(df, KEYS, "ts", columns, before, after, PLAIN)
    pieces = over_rows(df, KEYS, "ts", columns, before, after, PIECES)
    want, got = by_series(plain, "frame_sum"), by_series(pieces, "frame_sum")
    for name in want:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-12)
    assert pieces.columns == plain.columns


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-20, 20)), min_size=1, max_size=120), st.sampled_from([1, 2, 7]))
def test_ranks_of_any_split_equal_pandas(spark, rows, block_rows):
    """Many split points, none, and everything in between give the same exact ranks."""
    pdf = pd.DataFrame(rows, columns=["series_id", "x"]).astype({"x": float})
    df = spark.createDataFrame(pdf)
    layout = Layout(block_rows=block_rows)
    got = average_ranks(df, KEYS, {"x": "rank"}, layout).toPandas().sort_values(["series_id", "x"])
    pdf["rank"] = pdf.groupby("series_id")["x"].rank()
    pd.testing.assert_frame_equal(got.reset_index(drop=True), pdf.sort_values(["series_id", "x"]).reset_index(drop=True))


@BOTH
def test_ordered_counts(spark, layout):
    rng = np.random.RandomState(0)
    values = pd.Series(rng.randint(0, 200, 2000).astype(float))
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "x": values}))
    got = ordered_counts(df, KEYS, "x", layout).toPandas().sort_values("x")
    counts = values.value_counts().sort_index()
    assert got["n"].tolist() == counts.tolist()
    assert got["below"].tolist() == (counts.cumsum() - counts).tolist()
    assert set(got["total"]) == {2000} and set(got["distinct_total"]) == {len(counts)}


def test_keep_last_takes_the_greatest_and_is_repeatable(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n")], "k string, seq int, v string")
    got = {tuple(r) for r in keep_last(df, ["k"], ["seq"]).collect()}
    assert got == {("a", 2, "z"), ("b", None, "n")}


def test_ranges_include_both_ends_and_intraday_times(spark):
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    rows = spark.createDataFrame([(at(1, 9),), (at(2, 12),), (at(3, 10),), (at(3, 11),)], "ts timestamp_ntz")
    ranges = spark.createDataFrame([(1, at(1, 9), at(3, 10)), (2, at(3, 11), at(3, 11))], "id int, lo timestamp_ntz, hi timestamp_ntz")
    got = join_ranges(rows, ranges, "lo", "hi").select("id", "ts").orderBy("id", "ts").collect()
    assert [tuple(r) for r in got] == [(1, at(1, 9)), (1, at(2, 12)), (1, at(3, 10)), (2, at(3, 11))]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, how):
    rows = panel(spark, {"a": walk(60), "b": walk(5), "c": walk(4)})
    stats = spark.createDataFrame([("a", 1), ("b", 2)], "series_id string, s int")
    salted = join_by_key(rows, stats, KEYS, "ts", how, PIECES).toPandas()
    plain = rows.join(stats, KEYS, how).toPandas()
    order = ["series_id", "ts"]
    pd.testing.assert_frame_equal(salted.sort_values(order).reset_index(drop=True)[sorted(plain)],
                                  plain.sort_values(order).reset_index(drop=True)[sorted(plain)])


def test_measured_layout(spark):
    df = panel(spark, {"a": walk(100), "b": walk(10)})
    assert measure_layout(df).longest_series == 100 and measure_layout(df).fits_one_task
    cut = measure_layout(df, task_rows=40)
    assert not cut.fits_one_task and cut.chunk_hours == 40
    # the panel's grid bounds what its source rows may become
    copies = df.unionAll(df).unionAll(df)
    assert measure_layout(copies, bar_hours=24).longest_series <= 102
    assert measure_layout(df.limit(0)).longest_series == 0


def dense_panel(spark):
    """A second apart for hours, a crowd inside one hour, another inside a second, and a sparse series over all."""
    rng = np.random.RandomState(3)
    start = pd.Timestamp("2024-01-01")
    crowd = start + pd.to_timedelta(np.unique(rng.randint(0, 3_600_000_000, 3000, dtype=np.int64)), unit="us")
    burst = start + pd.Timedelta(hours=30) + pd.to_timedelta(np.unique(rng.randint(0, 900_000, 2000)), unit="us")
    named = {"second": pd.date_range(start, periods=9000, freq="s"), "crowd": crowd.append(burst),
             "sparse": pd.date_range(start, periods=60, freq="h")}
    rows = pd.concat([pd.DataFrame({"series_id": k, "ts": v.astype("datetime64[us]"), "value": rng.normal(size=len(v))}) for k, v in named.items()])
    return rows, spark.createDataFrame(rows.sample(frac=1, random_state=1), "series_id string, ts timestamp_ntz, value double").repartition(5)


def test_cuts_bound_every_piece_by_rows(spark):
    from quantframe.plans.layout import micros
    from quantframe.plans.scan import CHUNK, with_chunk

    rows, df = dense_panel(spark)
    layout = measure_layout(df, task_rows=500)
    assert layout.block_rows == 500 and not layout.fits_one_task
    placed = with_chunk(df, "ts", layout)
    assert placed.count() == len(rows)
    sizes = placed.groupBy("series_id", CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).toPandas()
    assert sizes["n"].max() <= 500 and len(sizes) > 40
    # chunks follow time: no chunk begins before the one with a lower number has ended
    for _, own in sizes.sort_values(CHUNK).groupby("series_id"):
        assert (own["a"].iloc[1:].to_numpy() > own["b"].iloc[:-1].to_numpy()).all()
    assert layout.cuts.table.agg(F.max(F.size("_starts"))).first()[0] < 60
    outside = spark.sql("select 'x' series_id, timestamp_ntz'2020-01-01' ts, 0d value union all select 'x', timestamp_ntz'2030-01-01', 0d")
    found = {r["ts"].year: r[CHUNK] for r in with_chunk(outside, "ts", layout).collect()}
    assert found == {2020: -1, 2030: layout.cuts.last_chunk + 1}
    assert df.select(micros(F.col("ts")) % 1_000_000).distinct().count() > 1000


def test_scans_over_cuts_equal_plain_scans(spark):
    rows, df = dense_panel(spark)
    layout = measure_layout(df, task_rows=400)
    ordered = rows.sort_values(["series_id", "ts"])
    want = ordered.groupby("series_id")["value"]
    checks = {"running": (running_sum(df, KEYS, F.col("value"), "running", layout=layout), want.cumsum()),
              "top": (running_max(df, KEYS, F.col("value"), "top", layout=layout), want.cummax()),
              "before": (previous_row(df, KEYS, "value", "before", layout=layout), want.shift()),
              "row_index": (index_rows(df, KEYS, layout=layout), want.cumcount())}
    for name, (got, expected) in checks.items():
        found = got.toPandas().sort_values(["series_id", "ts"])
        np.testing.assert_allclose(found[name].astype(float), expected.astype(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("layout", [PLAIN, PIECES, Layout(block_rows=7)], ids=["plain", "pieces", "tiny"])
@pytest.mark.parametrize("window, shift", [(1, 0), (2, 1), (5, 0), (20, 1), (60, 0)])
def test_rolling_moments_equal_pandas(spark, layout, window, shift):
    rng = np.random.RandomState(window)
    values = np.r_[rng.normal(1e6, 1e4, 40), np.full(70, 5.0), 5 + rng.normal(0, 1e-3, 40)]
    values[[3, 50]] = np.nan
    other = values * 2 + rng.normal(size=len(values))
    pdf = pd.DataFrame({"series_id": "a", "ts": dates(len(values)), "value": values, "other": other})
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=2))
    x, y = (F.when(~F.isnan(c), F.col(c)) for c in ("value", "other"))
    got = rolling_moments(df, KEYS, "ts", window, x, y, shift, layout).select("ts", "_moments.*").toPandas().sort_values("ts")
    frame = pdf.set_index("ts")[["value", "other"]].rolling(window, min_periods=1)
    n = frame["value"].count().shift(shift).fillna(0).to_numpy()
    assert got["n"].to_numpy() == pytest.approx(n)
    for i in range(len(pdf)):
        part = pdf.iloc[max(0, i - shift - window + 1):i - shift + 1].dropna() if i >= shift else pdf.iloc[:0]
        a, b = part["value"].to_numpy(), part["other"].to_numpy()
        row = got.iloc[i]
        assert row["n"] == len(a)
        if len(a):
            assert row["mean"] == pytest.approx(a.mean(), rel=1e-12)
            assert row["square"] == pytest.approx(((a - a.mean()) ** 2).sum(), rel=1e-9, abs=1e-18)
            assert row["cross"] == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), rel=1e-7, abs=1e-12)


def test_dominant_series_is_cut_into_bounded_pieces(spark):
    """One series holding most rows is spread over many (series, chunk) and (series, block) groups."""
    from quantframe.plans.halo import BLOCK, with_halo
    from quantframe.plans.scan import CHUNK, with_chunk

    index = dates(6000, freq="h")
    rows = pd.concat([pd.DataFrame({"series_id": "hot", "ts": index, "value": 1.0}),
                      pd.DataFrame({"series_id": "cold", "ts": index[:50], "value": 1.0})])
    df = spark.createDataFrame(rows)
    layout = Layout(chunk_hours=100, block_rows=100)
    chunks = with_chunk(df, "ts", layout).groupBy("series_id", CHUNK).count()
    assert chunks.agg(F.max("count")).first()[0] <= 100
    blocks = with_halo(index_rows(df, KEYS, layout=layout), before=9, layout=layout).groupBy("series_id", BLOCK).count()
    assert blocks.agg(F.max("count")).first()[0] <= 109
