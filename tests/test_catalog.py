"""Every registered query against its SQL, and the shape of the driver's contract."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check_oracle import TABLES, canonical
from quantframe import Layout, catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")

QUERIES, SQL = catalog.registered(), oracle.statements()
TWO_LEVEL = ["forward_returns", "ic_decay", "quantile_returns", "zscore_expanding", "calmar", "equity_curves",
             "hedge_ratio", "signal_sweep", "spread_trades", "spread_equity"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def assert_same(spark, db, name):
    got = canonical(QUERIES[name](spark, SF_DIR).toPandas())
    want = canonical(db.execute(SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(want) > 0
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert_same(spark, db, name)


@pytest.mark.parametrize("name", TWO_LEVEL)
def test_query_in_small_pieces_equals_sql(spark, db, name, monkeypatch):
    monkeypatch.setattr(catalog, "measure_layout", lambda *_, **__: Layout(chunk_hours=24 * 40, block_rows=64))
    assert_same(spark, db, name)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "horizon", "column", "ic", "n_obs"] and df.count() == 15


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert {f"{name}_blocks" for name in catalog.IN_BLOCKS} <= set(QUERIES)


def test_block_entries_cut_every_series(spark):
    layouts = []
    with pytest.MonkeyPatch.context() as patch:
        measured = catalog.measure_layout
        patch.setattr(catalog, "measure_layout", lambda *a, **k: layouts.append(measured(*a, **k)) or layouts[-1])
        QUERIES["equity_curves_blocks"](spark, SF_DIR)
        QUERIES["equity_curves"](spark, SF_DIR)
    assert [x.fits_one_task for x in layouts] == [False, True]
    assert layouts[0].cuts is not None and layouts[0].block_rows == catalog.PIECE_ROWS


def test_entry_registers_the_whole_catalog():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_screen_covers_all_pairs(spark):
    assert QUERIES["coint_screen"](spark, SF_DIR).count() == 10
