import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantframe.sources import history
from quantframe.streaming import run_available, snapshot_batches, upsert_batches

META = {"api_version": "v4", "interval": "1d", "endpoint": "basis"}
SCHEMA = "symbol string, ts timestamp, value double"


def at(day, month=1):
    return dt.datetime(2024, month, day)


def batch(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def stamp(day):
    return F.lit(at(day)).cast("timestamp")


def stored(spark, path):
    rows = history.load_history(spark, path).collect()
    return {(r["symbol"], r["ts"]): r["value"] for r in rows}


def test_upsert_keeps_the_last_fetch(spark, tmp_path):
    path = str(tmp_path / "t")
    history.upsert_history(batch(spark, [("BTC", at(1), 1.0), ("BTC", at(2), 2.0), ("ETH", at(1), 5.0)]), path, META, fetched_at=stamp(10))
    history.upsert_history(batch(spark, [("BTC", at(2), 20.0), ("BTC", at(3), 30.0)]), path, META, fetched_at=stamp(11))
    assert stored(spark, path) == {("BTC", at(1)): 1.0, ("BTC", at(2)): 20.0, ("BTC", at(3)): 30.0, ("ETH", at(1)): 5.0}
    row = history.load_history(spark, path, ["BTC"]).orderBy(F.desc("ts")).first()
    assert (row["interval"], row["endpoint"], row["fetched_at"]) == ("1d", "basis", at(11))


def test_running_a_batch_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = batch(spark, [("BTC", at(1), 1.0)])
    for _ in range(2):
        history.upsert_history(rows, path, META, fetched_at=stamp(10))
    assert stored(spark, path) == {("BTC", at(1)): 1.0}


def test_incoming_wins_even_with_an_older_fetch_time(spark, tmp_path):
    path = str(tmp_path / "t")
    history.upsert_history(batch(spark, [("BTC", at(1), 1.0)]), path, META, fetched_at=stamp(20))
    history.upsert_history(batch(spark, [("BTC", at(1), 2.0)]), path, META, fetched_at=stamp(10))
    assert stored(spark, path) == {("BTC", at(1)): 2.0}


def test_order_inside_a_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = batch(spark, [("BTC", at(1), 1.0, 2), ("BTC", at(1), 9.0, 1)], SCHEMA + ", seq int")
    history.upsert_history(rows, path, META, order_by=["seq"], fetched_at=stamp(10))
    assert stored(spark, path) == {("BTC", at(1)): 1.0}
    assert "seq" not in history.load_history(spark, path).columns


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    history.upsert_history(batch(spark, [("BTC", at(1), 1.0), ("BTC", at(1, 2), 2.0)]), str(path), META, fetched_at=stamp(10))
    january = {f.name for f in path.rglob("*.parquet") if "month=202401" in str(f)}
    history.upsert_history(batch(spark, [("BTC", at(2, 2), 3.0)]), str(path), META, fetched_at=stamp(11))
    assert {f.name for f in path.rglob("*.parquet") if "month=202401" in str(f)} == january
    assert len(stored(spark, str(path))) == 3


def test_empty_batch_and_changed_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    history.upsert_history(batch(spark, [("BTC", at(1), 1.0)]), path, META, fetched_at=stamp(10))
    history.upsert_history(batch(spark, []), path, META, fetched_at=stamp(11))
    wider = batch(spark, [("BTC", at(2), 2.0, 7.0)], SCHEMA + ", extra double")
    history.upsert_history(wider, path, META, fetched_at=stamp(12))
    history.upsert_history(batch(spark, [("BTC", at(3), 3.0)]), path, META, fetched_at=stamp(13))
    rows = {r["ts"]: r["extra"] for r in history.load_history(spark, path).collect()}
    assert rows == {at(1): None, at(2): 7.0, at(3): None}


def test_without_key_nothing_is_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        history.upsert_history(batch(spark, [("BTC", at(1), 1.0)]), path, META, key=None, fetched_at=stamp(10))
    assert history.load_history(spark, path).count() == 2


def test_partitions_have_to_follow_from_the_key(spark, tmp_path):
    with pytest.raises(ValueError, match="not determined by the key"):
        history.upsert_history(batch(spark, [("BTC", at(1), 1.0)]), str(tmp_path / "t"), META, key=["symbol", "ts"], fetched_at=stamp(1))


def test_snapshots_append_and_merge_columns(spark, tmp_path):
    path = str(tmp_path / "s")
    history.append_snapshot(batch(spark, [("a", 1)], "exchange string, oi int"), path, {"endpoint": "x"}, stamp(1))
    history.append_snapshot(batch(spark, [("a", 1, 2.0)], "exchange string, oi int, more double"), path, {"endpoint": "x"}, stamp(2))
    rows = history.read_table(spark, path).orderBy("fetched_at").collect()
    assert [(r["exchange"], r["oi"], r["more"]) for r in rows] == [("a", 1, None), ("a", 1, 2.0)]


def test_repeated_snapshot_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = batch(spark, [("a", 1)], "exchange string, oi int")
    for batch_id in (0, 1, 1):
        history.append_snapshot(rows, path, batch_id=batch_id, fetched_at=stamp(1))
    assert history.read_table(spark, path).count() == 2


def test_save_bars_replaces_given_months_only(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, o double, h double, l double, c double, v double"
    store, manifest = str(tmp_path / "bars"), str(tmp_path / "manifest")
    history.save_bars(batch(spark, [("BTC", at(1), *[1.0] * 5), ("BTC", at(1, 2), *[1.0] * 5)], schema), store, manifest)
    got = history.save_bars(batch(spark, [("BTC", at(1, 2), *[2.0] * 5), ("BTC", at(2, 2), *[2.0] * 5)], schema), store, manifest)
    assert [(r["symbol"], r["rows"], r["start"], r["end"]) for r in got.collect()] == [("BTC", 3, at(1), at(2, 2))]


def test_exports(spark):
    rows = [("taker_pair", "4h", 1.0), ("taker_agg", "4h", 2.0), ("taker_pair", "1d", 3.0), ("oi_coin_margin", "1d", 4.0), ("basis", "4h", 5.0)]
    df = batch(spark, rows, "endpoint string, interval string, value double")
    assert {tuple(r) for r in history.export_taker(df, "4h").collect()} == {("pair", "4h", 1.0), ("agg", "4h", 2.0)}
    assert {tuple(r) for r in history.export_daily(df).collect()} == {("oi_coin", "1d", 4.0)}
    world = batch(spark, [("fear_greed", 1.0, None), ("stablecoin_mcap", 2.0, None), ("cgdi", None, 3.0)], "endpoint string, value double, cgdi double")
    got = {r["endpoint"]: (r["fear_greed"], r["stable_mcap"], r["cgdi"]) for r in history.export_global(world).collect()}
    assert got == {"global_fg": (1.0, None, None), "global_stable_mcap": (None, 2.0, None), "global_cgdi": (None, None, 3.0)}


def test_older_csv_history(spark, tmp_path):
    (tmp_path / "h.csv").write_text("ts,value\n2024-01-01 00:00:00,1.5\n")
    assert history.import_history_csv(spark, str(tmp_path), "ts timestamp, value double").first()["value"] == 1.5


def landing(spark, path, name, rows):
    batch(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return f"{path}/*"


def test_stream_upsert_over_two_runs_and_a_replay(spark, tmp_path):
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    sink = upsert_batches(table, fetched_at=stamp(5), metadata=META)
    source = landing(spark, str(tmp_path / "in"), "one", [("BTC", at(1), 1.0), ("BTC", at(2), 2.0)])

    def run(where):
        run_available(spark.readStream.schema(SCHEMA).parquet(source), sink, where)

    run(checkpoint)
    landing(spark, str(tmp_path / "in"), "two", [("BTC", at(2), 20.0)])
    run(checkpoint)
    want = {("BTC", at(1)): 1.0, ("BTC", at(2)): 20.0}
    assert stored(spark, table) == want
    sink(batch(spark, [("BTC", at(2), 20.0)]), 1)
    assert stored(spark, table) == want


def test_stream_snapshots(spark, tmp_path):
    source = landing(spark, str(tmp_path / "in"), "one", [("BTC", at(1), 1.0)])
    sink = snapshot_batches(str(tmp_path / "s"), {"endpoint": "x"}, stamp(5))
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    run_available(stream, sink, str(tmp_path / "c"))
    sink(batch(spark, [("BTC", at(1), 1.0)]), 0)
    assert history.read_table(spark, str(tmp_path / "s")).count() == 1


def test_upsert_keeps_rows_of_null_partitions(spark, tmp_path):
    path = str(tmp_path / "globals")
    columns = "api_version string, interval string, endpoint string, symbol string, ts timestamp, value double"

    def rows(*rows):
        return spark.createDataFrame([("v4", None, "index", None, at(d), v) for d, v in rows], columns)

    history.upsert_history(rows((1, 1.0), (2, 2.0)), path)
    history.upsert_history(rows((2, 9.0), (3, 3.0)), path)
    stored = history.read_table(spark, path).orderBy("ts").collect()
    assert [(r["ts"].day, r["value"]) for r in stored] == [(1, 1.0), (2, 9.0), (3, 3.0)]
    timeless = spark.createDataFrame([("v4", None, "index", None, None, 5.0)], columns)
    history.upsert_history(timeless.union(rows((4, 4.0))), path)
    history.upsert_history(timeless, path)
    assert history.read_table(spark, path).count() == 4
    assert spark.read.parquet(f"{path}_rejected").count() == 2
