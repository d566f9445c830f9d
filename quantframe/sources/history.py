"""Stored history: keep-last upserts, snapshot appends, bar stores and compatibility exports.

Tables are Parquet, partitioned so that a batch rewrites only the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.columns import as_column
from quantframe.plans.latest import keep_last
from quantframe.session import materialize
from quantframe.sources.coverage import coverage_summary
from quantframe.sources.specs import (
    BAR_FIELDS, DAILY_EXPORT_NAMES, GLOBAL_EXPORT_NAMES, GLOBAL_VALUE_NAMES, TAKER_EXPORT_NAMES)

MONTH = "month"
BATCH = "batch_id"
PARTITION_TYPES = {
    **{name: T.StringType() for name in ("api_version", "interval", "endpoint", "symbol", "scope")},
    MONTH: T.IntegerType(), BATCH: T.LongType()}


def union_batches(*batches: DataFrame) -> DataFrame:
    """Union by name; a column that a batch lacks is NULL there."""
    merged = batches[0]
    for batch in batches[1:]:
        merged = merged.unionByName(batch, allowMissingColumns=True)
    return merged


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """A stored table. Without ``schema`` the file schemas are merged in one distributed pass over
    the footers. ``types`` fixes partition columns, whose type Spark guesses from directory names
    (the interval ``1d`` reads as a number)."""
    if schema is None:
        merged = spark.read.option("mergeSchema", "true").parquet(path).schema
        known = {**PARTITION_TYPES, **(types or {})}
        schema = T.StructType([T.StructField(f.name, known.get(f.name, f.dataType)) for f in merged])
    return spark.read.schema(schema).parquet(path)


def stored_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 types: Mapping[str, T.DataType] | None = None) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been stored yet."""
    try:
        return read_table(spark, path, schema, types)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_history(spark: SparkSession, path: str, symbols: Sequence[str] | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """Stored rows; a symbol list prunes partitions or is pushed into the scan."""
    stored = read_table(spark, path, schema)
    return stored if symbols is None else stored.filter(F.col("symbol").isin(list(symbols)))


def import_history_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Older history kept as CSV with a header, read with an explicit schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def with_metadata(df: DataFrame, metadata: Mapping[str, object], fetched_at: Column | None = None) -> DataFrame:
    """Metadata as constant columns, and the fetch time."""
    stamp = F.current_timestamp() if fetched_at is None else fetched_at
    return df.withColumns({**{k: F.lit(v) for k, v in metadata.items()}, "fetched_at": stamp})


def _with_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(MONTH, F.year(ts) * 100 + F.month(ts))


def _touched_part(stored: DataFrame, incoming: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions that the batch touches, a NULL partition among them.

    The batch's distinct partitions meet the table in a semi join. The month is never NULL, so its plain
    equality prunes the table's folders at run time; the other columns compare NULL-safe.
    """
    touched = incoming.select(*(F.col(c).alias(f"_{c}") for c in partition_by)).distinct()
    same = [F.col(c) == F.col(f"_{c}") if c == MONTH else F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition_by]
    return stored.join(touched, reduce(and_, same), "left_semi")


def _write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions present in ``df``. Rebalancing splits a dominant partition over tasks."""
    balanced = df.hint("rebalance", *partition_by)
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)


def upsert_history(incoming: DataFrame, path: str, metadata: Mapping[str, object] | None = None,
                   key: Sequence[str] | None = ("api_version", "interval", "endpoint", "symbol", "ts"),
                   partition_by: Sequence[str] = ("api_version", "interval", "endpoint", MONTH),
                   order_by: Sequence[str] = (), ts: str = "ts", fetched_at: Column | None = None,
                   table_schema: T.StructType | None = None) -> None:
    """Merge a batch into the table at ``path``, keeping the last record of each key.

    Incoming records win over stored ones; among incoming ones ``order_by`` decides. ``key=None``
    appends without removing duplicates. An empty batch changes nothing. The merged partitions are
    written beside the table first, because a path cannot be read and replaced in one job. Running a finished batch
    again gives the same table, but a crash while partitions are replaced can lose stored rows: ``UpsertLog`` is
    the form that cannot. ``table_schema`` saves the pass that merges the stored files' schemas.
    """
    spark = incoming.sparkSession
    batch = with_metadata(incoming, metadata or {}, fetched_at)
    if MONTH in partition_by:
        batch = _with_month(batch, ts)
    if key is None:
        batch.drop(*order_by).hint("rebalance", *partition_by).write.mode("append").partitionBy(
            *partition_by).parquet(path)
        return
    loose = [c for c in partition_by if c not in key and not (c == MONTH and ts in key)]
    if loose:
        raise ValueError(f"partition columns {loose} are not determined by the key {list(key)}")
    # read three times below; parsed and time-stamped once
    batch = materialize(batch, "batch")
    if MONTH in partition_by:
        timeless = batch.filter(F.col(ts).isNull())
        if not timeless.isEmpty():
            timeless.drop(*order_by).write.mode("append").parquet(f"{path}_rejected")
            batch = batch.filter(F.col(ts).isNotNull())
            if batch.isEmpty():
                return
    fresh = batch.withColumn("_age", F.lit(1))
    types = {c: batch.schema[c].dataType for c in partition_by}
    stored = stored_table(spark, path, table_schema, types)
    if stored is not None:
        old = _touched_part(stored, batch, partition_by).withColumn("_age", F.lit(0))
        fresh = union_batches(old, fresh)
    merged = keep_last(fresh, list(key), ["_age", *order_by]).drop("_age", *order_by)
    _write_partitions(materialize(merged, "upsert"), path, partition_by)


def append_snapshot(records: DataFrame, path: str, metadata: Mapping[str, object] | None = None,
                    fetched_at: Column | None = None, batch_id: int | None = None) -> None:
    """Append records as they are. Columns may change between batches: reads merge the schemas.

    With ``batch_id`` a repeated batch replaces itself instead of being appended twice.
    """
    batch = with_metadata(records, metadata or {}, fetched_at)
    if batch_id is None:
        batch.write.mode("append").parquet(path)
    else:
        _write_partitions(batch.withColumn(BATCH, F.lit(batch_id).cast("long")), path, [BATCH])


def save_bars(bars: DataFrame, path: str, manifest_path: str, ts: str = "ts") -> DataFrame:
    """Replace the stored bars of the given symbols and months, and the manifest of the whole store."""
    spark = bars.sparkSession
    _write_partitions(_with_month(bars.select("symbol", ts, *BAR_FIELDS), ts), path, ["symbol", MONTH])
    summary = coverage_summary(read_table(spark, path), ["symbol"], ts=ts).orderBy("symbol")
    summary.write.mode("overwrite").parquet(manifest_path)
    return spark.read.parquet(manifest_path)


def _renamed(df: DataFrame, names: Mapping[str, str], column: str = "endpoint") -> DataFrame:
    lookup = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.filter(F.col(column).isin(list(names))).withColumn(column, lookup[F.col(column)])


def export_taker(history: DataFrame, interval: str) -> DataFrame:
    """Taker volumes of one interval under their short endpoint names."""
    return _renamed(history.filter(F.col("interval") == as_column(interval)), TAKER_EXPORT_NAMES)


def export_daily(history: DataFrame) -> DataFrame:
    """Daily series under their short endpoint names."""
    return _renamed(history.filter(F.col("interval") == "1d"), DAILY_EXPORT_NAMES)


def export_global(history: DataFrame) -> DataFrame:
    """Global series under their export names, with ``value`` moved to a column of its own name."""
    named = {out: F.when(F.col("endpoint") == endpoint, F.col("value"))
             for endpoint, out in GLOBAL_VALUE_NAMES.items()}
    present = {k: v for k, v in named.items() if "value" in history.columns}
    return _renamed(history.withColumns(present).drop("value"), GLOBAL_EXPORT_NAMES)
