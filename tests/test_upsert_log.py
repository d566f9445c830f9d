import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantframe.sources.upsert_log import UpsertLog
from quantframe.streaming import log_batches


def batch(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, d), v) for k, d, v in rows], "symbol string, ts timestamp, value double")


def values(table):
    return {(r["symbol"], r["ts"].day): r["value"] for r in table.read().collect()}


@pytest.fixture
def log(spark, tmp_path):
    return UpsertLog(spark, str(tmp_path / "log"), ["symbol", "ts"])


def test_later_batches_win_and_nothing_stored_is_touched(spark, log):
    assert log.read() is None
    assert log.merge(batch(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]), {"source": "x"})
    before = {f: spark.read.parquet(f"{log.path}/data/{f}").count() for f in log._names("data")}
    assert log.merge(batch(spark, [("a", 2, 20.0), ("c", 40 // 2, 4.0)]))
    assert values(log) == {("a", 1): 1.0, ("a", 2): 20.0, ("b", 1): 3.0, ("c", 20): 4.0}
    assert {f: spark.read.parquet(f"{log.path}/data/{f}").count() for f in before} == before
    assert values_of(log, 1) == {("a", 1): 1.0, ("a", 2): 2.0, ("b", 1): 3.0}
    assert {r["source"] for r in log.read().collect()} == {"x", None}


def values_of(log, number):
    return {(r["symbol"], r["ts"].day): r["value"] for r in log.read(number).collect()}


@pytest.mark.parametrize("cut", ["before the run", "before the commit", "after the commit"])
def test_a_batch_cut_off_anywhere_and_run_again_counts_once(spark, log, cut, monkeypatch):
    log.merge(batch(spark, [("a", 1, 1.0)]), batch_id=0)

    def killed(*args):
        raise KeyboardInterrupt

    name = {"before the run": "_write", "before the commit": "_commit", "after the commit": "compact"}[cut]
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(log, name, killed)
        log.merge(batch(spark, [("a", 1, 5.0), ("b", 1, 2.0)]), batch_id=1)
    merged = cut == "after the commit"
    assert values(log) == ({("a", 1): 5.0, ("b", 1): 2.0} if merged else {("a", 1): 1.0})
    assert log.merge(batch(spark, [("a", 1, 5.0), ("b", 1, 2.0)]), batch_id=1) is not merged
    assert values(log) == {("a", 1): 5.0, ("b", 1): 2.0}
    gone = log.vacuum(1)
    assert len(gone) == (1 if cut == "before the commit" else 0) and values(log) == {("a", 1): 5.0, ("b", 1): 2.0}


def test_micro_batches_with_replays_and_compaction(spark, log):
    sink = log_batches(log.path, log.key, ["seq"])
    want, written = {}, 0
    for k in range(12):
        rows = [("s%d" % (i % 5), 1 + (i * 7 + k) % 20, float(k * 100 + i), i) for i in range(30)]
        df = spark.createDataFrame([(s, dt.datetime(2024, 1, d), v, i) for s, d, v, i in rows], "symbol string, ts timestamp, value double, seq int")
        sink(df, k)
        want |= {(s, d): v for s, d, v, _ in rows}
        if k % 3 == 2:
            sink(df.withColumn("value", F.col("value") * -1), k)  # handed in again
            sink(df.withColumn("value", F.col("value") * -1), k - 1)
        assert len(log.version().runs) <= 6
    assert values(log) == want
    assert log.version().streams == {"": 11}
    sizes = [n for _, n in log.version().runs]
    assert sum(sizes) < 12 * 30
    log.vacuum()
    assert values(log) == want and len(log._names("versions")) == 2


def test_writers_that_meet_lose_no_batch(spark, log):
    other = UpsertLog(spark, log.path, log.key)
    log.merge(batch(spark, [("a", 1, 1.0)]))
    write = log._write

    def slow(rows):
        run = write(rows)
        other.merge(batch(spark, [("b", 1, 2.0)]))  # commits in between
        log._write = write
        return run

    log._write = slow
    assert log.merge(batch(spark, [("c", 1, 3.0)]))
    assert values(log) == {("a", 1): 1.0, ("b", 1): 2.0, ("c", 1): 3.0}


def test_empty_batches_and_two_streams(spark, log):
    assert not log.merge(batch(spark, []), stream="x", batch_id=0)
    assert log.read() is None and log.version().streams == {"x": 0}
    assert log.merge(batch(spark, [("a", 1, 1.0)]), stream="y", batch_id=0)
    assert not log.merge(batch(spark, [("a", 1, 9.0)]), stream="y", batch_id=0)
    assert values(log) == {("a", 1): 1.0}
