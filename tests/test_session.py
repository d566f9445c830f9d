import os

import pytest
from pyspark.sql import functions as F

from quantframe import session
from quantframe.plans import average_ranks
from quantframe.session import Scope, materialize, scratch_scope
from support import PIECES


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get(session.CHECKPOINT_DIR)
    assert session.shared_dir(spark) == folder.rstrip("/")
    first, second = (session.scratch_path(spark, "x") for _ in range(2))
    assert first != second and first.startswith(folder)


def test_materialized_table_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.lit("a").alias("name"), (F.col("id") / 2).alias("half"))
    kept = session.materialize(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_package_is_shipped_once(spark):
    session.ship_package(spark)
    before = len(session._shipped)
    session.ship_package(spark)
    assert len(session._shipped) == before and spark.sparkContext.applicationId in session._shipped


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_one_value_may_hold_most_rows(spark, share):
    """Ties of any size get one mean rank."""
    n = 4000
    x = F.when(F.col("id") < int(n * share), 0.0).otherwise(F.col("id").cast("double") + 1)
    df = spark.range(n).select(F.lit("a").alias("series_id"), x.alias("x"))
    ranked = average_ranks(df, ["series_id"], {"x": "rank"}, PIECES)
    assert ranked.count() == n
    assert ranked.agg(F.sum("rank")).first()[0] == n * (n + 1) / 2
    if share:
        tied = int(n * share)
        assert ranked.filter("x = 0").select("rank").distinct().collect() == [((tied + 1) / 2,)]


def test_scopes_remove_their_tables(spark):
    def there(df):
        return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())

    with scratch_scope(spark) as outer:
        first = materialize(spark.range(5), "first")
        with scratch_scope(spark) as inner:
            step = materialize(spark.range(3), "step")
            files = step.inputFiles()
            kept = inner.keep(step.selectExpr("id + 1 AS id"))
        assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
        assert sorted(r.id for r in kept.collect()) == [1, 2, 3] and first.count() == 5
        left = kept.inputFiles()
    assert outer.paths == [] and not any(os.path.exists(f.removeprefix("file://")) for f in left)
    held = Scope(spark)
    with scratch_scope(spark, held):
        table = materialize(spark.range(2))
    assert there(table)
    held.drop()
    with pytest.raises(ValueError), scratch_scope(spark) as failed:
        gone = materialize(spark.range(2)).inputFiles()
        raise ValueError
    assert failed.paths == [] and not any(os.path.exists(f.removeprefix("file://")) for f in gone)
