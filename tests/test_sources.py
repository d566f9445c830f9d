import datetime as dt
import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quantframe.sources import coverage, klines, payloads, refresh, universe
from quantframe.sources.specs import RESEARCH_SYMBOLS, SPECS, spec_for

T0 = 1_700_000_000
AT = dt.datetime(2023, 11, 14, 22, 13, 20)


def documents(spark, bodies, envelope=True):
    lines = [body if isinstance(body, str) else json.dumps({"code": "0", "data": body} if envelope else body) for body in bodies]
    return spark.createDataFrame([("BTC", line) for line in lines], "symbol string, value string").repartition(2)


def parsed(spark, name, records, **kw):
    df = payloads.parse_payload(documents(spark, [records]), name, **kw).orderBy("record_no")
    return [r.asDict() for r in df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()]


def test_open_interest(spark):
    row = parsed(spark, "oi", [{"t": T0, "o": "1.5", "h": 2, "l": 1, "c": "1.75"}])[0]
    assert (row["ts"], row["oi_open"], row["oi_high"], row["oi_low"], row["oi_close"]) == (AT, 1.5, 2.0, 1.0, 1.75)
    assert row["symbol"] == "BTC"


def test_liquidations_have_net_and_total(spark):
    row = parsed(spark, "liq", [{"t": T0, "longLiquidationUsd": 5, "shortLiquidationUsd": "2"}])[0]
    assert (row["long_liq"], row["short_liq"], row["net_liq"], row["total_liq"]) == (5, 2, 3, 7)


@pytest.mark.parametrize("name,prefix", [("global_ls", "global"), ("top_acct", "top_acct"), ("top_pos", "top_pos")])
def test_ratios(spark, name, prefix):
    row = parsed(spark, name, [{"time": T0, "longShortRatio": "1.2", "longAccount": 55.0}])[0]
    assert (row[f"{prefix}_ls_ratio"], row[f"{prefix}_long_pct"]) == (1.2, 55.0)


def test_strict_numbers_fail_and_others_become_null(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parsed(spark, "fr", [{"t": T0, "c": "oops"}])
    row = parsed(spark, "taker_pair", [{"time": T0, "taker_buy_volume_usd": "oops", "taker_sell_volume_usd": "NaN"}])[0]
    assert row["buy"] is None and row["sell"] is None


def test_seconds_milliseconds_and_missing_times(spark):
    rows = parsed(spark, "cgdi", [{"time": T0, "cgdi_index_value": 1}, {"time": T0 * 1000 + 250, "cgdi_index_value": 2},
                                  {"time": "1700000000.5", "cgdi_index_value": 3}, {"cgdi_index_value": 4}])
    assert [r["ts"] for r in rows] == [AT, AT.replace(microsecond=250_000), AT.replace(microsecond=500_000), None]


def test_absent_fields_are_null(spark):
    rows = parsed(spark, "basis", [{"time": T0, "open_basis": 1, "close_change": 2}])
    assert (rows[0]["open_basis"], rows[0]["close_basis"], rows[0]["close_change"]) == (1, None, 2)
    assert parsed(spark, "bitfinex_margin", [{"time": T0, "long_quantity": 3}])[0]["short_quantity"] is None
    assert parsed(spark, "coinbase_premium", [{"time": T0, "premium": 3}])[0]["coinbase_price"] is None


@pytest.mark.parametrize("name", ["oi_stablecoin", "oi_coin_margin", "fr_oi_weight", "fr_vol_weight"])
def test_generic_candles(spark, name):
    row = parsed(spark, name, [{"time": T0 * 1000, "open": 1, "high": "4", "low": 0.5, "close": 2}])[0]
    assert [row[c] for c in ("ts", "open", "high", "low", "close")] == [AT, 1, 4, 0.5, 2]


def test_daily_global_series(spark):
    row = parsed(spark, "etf_btc", [{"timestamp": T0 * 1000, "flow_usd": -5, "price_usd": "40000"}])[0]
    assert (row["etf_btc_flow"], row["etf_btc_price"]) == (-5, 40000)


def test_parallel_arrays_and_wrong_shapes(spark):
    good = {"time_list": [T0, T0 + 60], "data_list": ["10", None]}
    bodies = [good, [1, 2], {"time_list": [T0]}, {"time_list": [T0], "data_list": [1, 2]}, "not json", {}]
    got = payloads.parse_payload(documents(spark, bodies), "fear_greed").orderBy("ts").collect()
    assert [(r["value"], r["record_no"]) for r in got] == [(10.0, 0), (None, 1)]


def test_plain_records_without_envelope(spark):
    bodies = [{"time": T0, "cgdi_index_value": 1}, "[]", "broken {", {"other": 1}]
    got = payloads.parse_payload(documents(spark, bodies, envelope=False), "cgdi", envelope=False)
    assert [r["cgdi"] for r in got.collect()] == [1.0]


def test_corrupt_documents_are_listed(spark):
    df = documents(spark, [[{"time": T0}], "broken {", '{"code": "1"}'])
    assert {r["value"] for r in payloads.corrupt_documents(df).collect()} == {"broken {", '{"code": "1"}'}


@pytest.mark.parametrize("body", ["broken {", '{"code": "429", "msg": "slow"}', '{"code": "0", "data": 5}'])
def test_strict_endpoints_fail_on_bad_documents(spark, body):
    bodies = [[{"t": T0, "c": 1}], body]
    with pytest.raises(Exception, match="fr: bad document"):
        payloads.parse_payload(documents(spark, bodies), "fr").collect()
    assert payloads.parse_payload(documents(spark, bodies), "cgdi").filter("cgdi IS NOT NULL").count() == 0


def test_strict_endpoints_accept_answers_without_data(spark):
    got = payloads.parse_payload(documents(spark, [[{"t": T0, "c": 1}], '{"code": "0"}', []]), "fr")
    assert [r["fr_close"] for r in got.collect()] == [1.0]


def test_refused_answers_give_no_rows(spark):
    body = json.dumps({"code": "1", "data": [{"time": T0, "cgdi_index_value": 1}]})
    assert payloads.parse_payload(documents(spark, [body]), "cgdi").count() == 0


def test_refresh_of_globals_and_snapshots(spark, tmp_path):
    def landed(cgdi, exchanges, symbol="BTC"):
        answers = [(None, None, "cgdi", cgdi), (symbol, None, "oi_exchange", exchanges), ("XRP", None, "option_maxpain", [{"p": 1}])]
        rows = [(s, i, e, json.dumps({"code": "0", "data": d}, indent=1)) for s, i, e, d in answers]
        return spark.createDataFrame([*rows, (None, None, "nobody", "{}")], "symbol string, interval string, endpoint string, value string")

    specs = [spec_for(n) for n in ("cgdi", "oi_exchange", "option_maxpain")]
    path = str(tmp_path / "store")
    first = landed([{"time": T0, "cgdi_index_value": 1}, {"time": T0 + 60, "cgdi_index_value": 2}], [{"symbol": "x", "oi": 1}])
    refresh.refresh_endpoints(first, specs, path)
    second = landed([{"time": T0 + 60, "cgdi_index_value": 3}], [{"symbol": "x", "oi": 2, "new": "n"}, {"symbol": "y"}])
    named = refresh.with_scope_names(refresh.refresh_endpoints(second, specs, path))
    got = {(r["scope"], r["name"]): (r["rows"], r["start"] is None) for r in named.collect()}
    assert got == {("v4_global", "cgdi"): (2, False), ("v4_snapshot", "BTC_oi_exchange"): (3, True)}
    assert {r["symbol"] for r in spark.read.parquet(f"{path}/oi_exchange").collect()} == {"BTC"}
    report = spark.read.parquet(f"{path}_documents").groupBy("endpoint", "status").agg(F.sum("documents").alias("n"))
    assert {tuple(r) for r in report.collect()} == {
        ("cgdi", "ok", 2), ("oi_exchange", "ok", 2), ("option_maxpain", "unsupported_symbol", 2), ("nobody", "unknown_endpoint", 2)}


def test_landed_directories_become_columns(spark, tmp_path):
    folder = tmp_path / "symbol=ETH" / "interval=4h"
    folder.mkdir(parents=True)
    (folder / "page.json").write_text(json.dumps({"code": "0", "data": [{"t": T0, "c": 1}, {"t": T0 + 1, "c": 2}]}))
    got = payloads.read_payload(spark, str(tmp_path), "fr").orderBy("ts").collect()
    assert [(r["symbol"], r["interval"], r["fr_close"]) for r in got] == [("ETH", "4h", 1.0), ("ETH", "4h", 2.0)]


def test_snapshots_keep_their_own_columns(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"code": "0", "data": [{"exchange": "x", "oi": 1}, {"exchange": "y", "extra": "z"}]}))
    got = payloads.read_snapshot(spark, str(tmp_path / "list.json"))
    assert sorted(got.columns) == ["exchange", "extra", "oi"] and got.count() == 2
    (tmp_path / "one.json").write_text(json.dumps({"code": "0", "data": {"exchange": "x", "oi": 1}}))
    assert payloads.read_snapshot(spark, str(tmp_path / "one.json")).first()["oi"] == 1
    (tmp_path / "bare.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert payloads.read_snapshot(spark, str(tmp_path / "bare.json"), envelope=False).count() == 2
    with pytest.raises(ValueError, match="snapshot"):
        payloads.parse_payload(documents(spark, [[]]), "oi_exchange")


def test_specs():
    assert len(SPECS) == 22 and spec_for("liq").strict and not spec_for("basis").strict
    with pytest.raises(ValueError, match="Unknown endpoint"):
        spec_for("nothing")


# candles -----------------------------------------------------------------------------------------

def line(ms, *values):
    return ",".join(str(v) for v in (ms, *values, *["0"] * (11 - len(values))))


def test_zipped_candles(spark, tmp_path):
    def archive(name, lines):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("data.csv", "\n".join(lines))
            z.writestr("second.csv", line(1, 9, 9, 9, 9, 9))
        (tmp_path / name).write_bytes(buffer.getvalue())

    archive("BTCUSDT-15m-2023-11.zip", ["open_time,o,h,l,c,v", line(T0 * 1000, 1, 2, 0.5, 1.5, 10), line("bad", 1, 1, 1, 1, 1),
                                        line(T0 * 1000 + 900_000, "x", 2, 0.5, 1.5, 11)])
    archive("BTCUSDT-15m-2023-12.zip", [line(T0 * 1000, 7, 8, 6, 7, 70), line(T0 * 1000, 3, 3, 3, 3, 3)])
    archive("ETHUSDT-15m-2023-11.zip", [""])
    got = klines.read_kline_zips(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["symbol"], r["o"], r["v"]) for r in got] == [("BTC", 3.0, 3.0), ("BTC", None, 11.0)]


def test_every_member_of_an_archive(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("part/", "")
        z.writestr("part/a.csv", "open_time,o\r\n" + line(T0 * 1000, 1, 1, 1, 1, 1) + "\r\n" + line(T0 * 1000 + 900_000, 2, 2, 2, 2, 2))
        z.writestr("empty.csv", "")
        z.writestr("b.csv", line(T0 * 1000, 5, 5, 5, 5, 5) + "\n")
    (tmp_path / "BTCUSDT-15m-2023-11.zip").write_bytes(buffer.getvalue())
    both = klines.read_kline_zips(spark, str(tmp_path), every_member=True).orderBy("ts").collect()
    assert [r["o"] for r in both] == [5.0, 2.0]
    first = klines.read_kline_zips(spark, str(tmp_path)).orderBy("ts").collect()
    assert [r["o"] for r in first] == [1.0, 2.0]


def test_long_archives_are_streamed_in_blocks_of_whole_lines(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(klines, "BLOCK_BYTES", 64)
    lines = [line(i, 1, 1, 1, 1, i) for i in range(20)] + ["x" * 300, line(20, 1, 1, 1, 1, 1)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", "\n".join(lines))
    frames = list(klines._unzip_blocks([pd.DataFrame({"path": ["p"], "content": [buffer.getvalue()]})], False))
    assert [f["block"].iloc[0] for f in frames] == list(range(len(frames))) and len(frames) > 8
    texts = [f["text"].iloc[0] for f in frames]
    assert "\n".join(texts) == "\n".join(lines) and max(map(len, texts)) < 400


def test_csv_candles(spark, tmp_path):
    for symbol, opener, name in (("BTC", open, "a.csv"), ("ETH", gzip.open, "a.csv.gz")):
        folder = tmp_path / f"symbol={symbol}"
        folder.mkdir()
        with opener(folder / name, "wt") as f:
            f.write("open_time,o\n" + line(T0 * 1000, 1, 2, 3, 4, 5) + "\n")
    got = klines.read_kline_csv(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [(r["symbol"], r["c"]) for r in got] == [("BTC", 4.0), ("ETH", 4.0)]


def test_candle_pages_mix_numbers_and_text(spark):
    page = [[T0 * 1000, "1", "2", "0.5", "1.5", "10", 0, "0", 1, "0", "0", "0"], [T0 * 1000 + 900_000, 1, 2, 1, "x", 3, 0, 0, 0, 0, 0, 0]]
    df = spark.createDataFrame([("BTC", json.dumps(page)), ("BTC", "oops")], "symbol string, value string")
    got = klines.parse_kline_pages(df).orderBy("ts").collect()
    assert [(r["o"], r["c"], r["v"]) for r in got] == [(1, 1.5, 10), (1, None, 3)]


def test_normalize_bars(spark):
    rows = [("BTC", AT, 1, "1", "2", "1", "x", "5", "extra"), ("BTC", AT, 2, "3", "4", "NaN", "3", "6", "extra")]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq int, o string, h string, l string, c string, v string, note string")
    got = klines.normalize_bars(df, ["seq"]).collect()
    assert [r.asDict() for r in got] == [{"symbol": "BTC", "ts": AT, "o": 3.0, "h": 4.0, "l": None, "c": 3.0, "v": 6.0}]


def test_bars_still_forming_are_dropped(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0),), (dt.datetime(2024, 1, 1, 10, 15),)], "ts timestamp_ntz")
    kept = klines.drop_forming_bars(df, F.lit("2024-01-01 10:29:59").cast("timestamp_ntz"))
    assert [r["ts"].minute for r in kept.collect()] == [0]


# universe and coverage ---------------------------------------------------------------------------

def test_universe(spark):
    assert universe.parse_symbols(" btc, ,eth") == ["BTC", "ETH"]
    assert universe.parse_symbols(None) == list(RESEARCH_SYMBOLS) and len(RESEARCH_SYMBOLS) == 12
    df = spark.createDataFrame([("BTC",), ("XXX",)], "symbol string")
    table = spark.createDataFrame([("BTC",), ("ETH",)], "symbol string")
    for named in (["BTC", "ETH"], table):
        assert [r["symbol"] for r in universe.filter_universe(df, named).collect()] == ["BTC"]


def bars_at(spark, named):
    rows = [(s, t) for s, times in named.items() for t in times]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")


def names(spark, *symbols):
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def test_coverage_and_manifest(spark):
    bars = bars_at(spark, {"BTC": [AT, AT + dt.timedelta(hours=1)], "NEW": [AT]})
    got = {r["symbol"]: (r["rows"], r["start"], r["end"]) for r in coverage.coverage_summary(bars, expected=names(spark, "BTC", "ETH")).collect()}
    assert got == {"BTC": (2, AT, AT + dt.timedelta(hours=1)), "ETH": (0, None, None), "NEW": (1, AT, AT)}
    undated = coverage.coverage_summary(bars, ts=None).filter("symbol = 'BTC'").first()
    assert (undated["rows"], undated["start"]) == (2, None)
    summary = spark.createDataFrame([("4h", "oi", 3, AT), ("4h", "oi", 0, None), (None, "fr", 2, AT), ("1d", "fr", 0, None)],
                                    "interval string, endpoint string, rows long, start timestamp_ntz").withColumn("end", F.col("start"))
    rolled = [(r["interval"], r["endpoint"], r["rows"]) for r in coverage.roll_up_manifest(summary).collect()]
    assert rolled == [(None, "fr", 2), ("1d", "fr", 0), ("4h", "oi", 3)]
    assert coverage.available(coverage.roll_up_manifest(summary)).count() == 2


def quarter_hours(start, end):
    n = int((end - start).total_seconds() // 900)
    return [start + dt.timedelta(minutes=15 * i) for i in range(n)]


def test_gaps_by_month_and_day(spark):
    full = quarter_hours(dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 3))
    holes = [t for t in full if t not in (dt.datetime(2024, 1, 31, 23, 45), dt.datetime(2024, 3, 2, 0, 0))]
    bars = bars_at(spark, {"FULL": full, "HOLES": holes})
    got = coverage.history_gaps(bars, names(spark, "FULL", "HOLES", "NONE"), "2024-01-10", "2024-03-03 08:00:00")
    rows = {(r["symbol"], r["unit"], r["period_start"].strftime("%m-%d")): (r["expected"], r["present"]) for r in got.collect()}
    assert rows == {
        ("HOLES", "month", "01-01"): (2976, 2975), ("HOLES", "day", "03-02"): (96, 95),
        ("NONE", "month", "01-01"): (2976, 0), ("NONE", "month", "02-01"): (2784, 0),
        ("NONE", "day", "03-01"): (96, 0), ("NONE", "day", "03-02"): (96, 0)}
    with pytest.raises(ValueError, match="unit"):
        coverage.period_grid(names(spark, "A"), F.lit(AT), F.lit(AT), "week")


def test_no_gaps_before_the_history_starts(spark):
    got = coverage.history_gaps(bars_at(spark, {"A": [AT]}), names(spark, "A"), "2024-05-01", "2024-03-03 08:00:00")
    assert got.count() == 0
    first_days = coverage.history_gaps(bars_at(spark, {"A": [AT]}), names(spark, "A"), "2024-03-01", "2024-03-03 08:00:00")
    assert {r["unit"] for r in first_days.collect()} == {"day"}


def test_watermark(spark):
    last = dt.datetime(2024, 1, 1, 9, 45)
    bars = bars_at(spark, {"OLD": [last, last - dt.timedelta(hours=1)], "DONE": [dt.datetime(2024, 1, 1, 10, 0)]})
    plan = coverage.fetch_watermark(bars, names(spark, "OLD", "DONE", "EMPTY"), "2024-01-01 10:07:00")
    got = {r["symbol"]: (r["from_ts"], r["to_ts"]) for r in plan.collect()}
    ten = dt.datetime(2024, 1, 1, 10, 0)
    assert got == {"OLD": (ten, ten), "EMPTY": (ten - dt.timedelta(days=2), ten)}


def test_gaps_of_five_minute_bars(spark):
    stamps = [dt.datetime(2024, 3, 1) + dt.timedelta(minutes=5 * i) for i in range(288)]
    full, short = bars_at(spark, {"FULL": stamps, "SHORT": stamps[:-1]}), names(spark, "FULL", "SHORT")
    got = coverage.history_gaps(full, short, "2024-03-01", "2024-03-02 01:00:00", bar_minutes=5).collect()
    assert [(r["symbol"], r["expected"], r["present"]) for r in got] == [("SHORT", 288, 287)]
