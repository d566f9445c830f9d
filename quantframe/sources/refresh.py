"""Refresh jobs: landed files to stored tables and their coverage report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.session import scratch_path
from quantframe.sources import history, klines, payloads
from quantframe.sources.coverage import coverage_summary
from quantframe.sources.specs import BAR_FIELDS, SPECS, SUPPORTED_SYMBOLS, PayloadSpec

SUMMARY_KEYS = ("interval", "symbol", "endpoint")
SOURCE = "_source"


def refresh_bars(archives: DataFrame, pages: DataFrame, path: str, symbols: DataFrame, as_of: Column,
                 bar_minutes: int = klines.BAR_MINUTES) -> DataFrame:
    """Merge parsed archives, then the parsed recent pages, into the bar store; coverage per symbol.

    Pages win over archives, both win over what is stored, and bars still forming at ``as_of`` are left
    out. Only months that receive bars are rewritten.
    """
    spark = archives.sparkSession
    fields = ["symbol", "ts", *BAR_FIELDS]
    batches = [b.select(*fields, F.lit(i).alias(SOURCE)) for i, b in enumerate((archives, pages))]
    closed = klines.drop_forming_bars(history.union_batches(*batches), as_of, bar_minutes)
    history.upsert_history(closed, path, key=["symbol", "ts"], partition_by=["symbol", history.MONTH],
                           order_by=[SOURCE])
    return coverage_summary(history.read_table(spark, path), ["symbol"], symbols).orderBy("symbol")


def refresh_endpoints(landed: DataFrame, specs: Iterable[PayloadSpec], path: str,
                      fetched_at: Column | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Parse landed documents (``value``, with ``symbol, interval, endpoint``) and merge each endpoint
    into its own table under ``path``; stored rows, first and last time per (interval, symbol, endpoint).

    Tables are apart because record shapes differ. Each endpoint is one distributed job. Documents of global
    endpoints have NULL ``symbol`` and ``interval``; records of snapshots are appended, and have no times.
    ``document_report`` of the batch is appended to ``<path>_documents`` before anything is merged, so no
    document is left out unseen.
    """
    spark, specs = landed.sparkSession, list(specs)
    report = history.with_metadata(document_report(landed, specs), {}, fetched_at)
    report.write.mode("append").parquet(f"{path}_documents")
    for spec in specs:
        documents = landed.filter((F.col("endpoint") == spec.name) & _supported([spec]))
        metadata = {"api_version": spec.api_version, "scope": spec.scope, "path": spec.path}
        if spec.shape == "snapshot":
            records = _snapshot_records(documents)
            if records is not None:
                history.append_snapshot(records, f"{path}/{spec.name}", {**metadata, "endpoint": spec.name}, fetched_at)
            continue
        history.upsert_history(payloads.parse_payload(documents, spec), f"{path}/{spec.name}", metadata,
                               order_by=["record_no"], fetched_at=fetched_at)
    tables = [t for t in (_dates(spark, path, spec) for spec in specs) if t is not None]
    if not tables:
        raise ValueError("none of the endpoints has landed data")
    return coverage_summary(history.union_batches(*tables), SUMMARY_KEYS, expected)


def _supported(specs: Iterable[PayloadSpec]) -> Column:
    """Whether a document's symbol is one that its endpoint has. Endpoints without a list have all."""
    limited = {s.name: SUPPORTED_SYMBOLS[s.name] for s in specs if s.name in SUPPORTED_SYMBOLS}
    unfit = F.lit(False)
    for name, symbols in limited.items():
        unfit = unfit | ((F.col("endpoint") == name) & ~F.coalesce(F.col("symbol").isin(list(symbols)), F.lit(False)))
    return ~unfit


def document_report(landed: DataFrame, specs: Iterable[PayloadSpec]) -> DataFrame:
    """Documents per (endpoint, status): those of ``payloads.document_status``, or ``unknown_endpoint`` and
    ``unsupported_symbol`` for documents that a refresh with these specs does not take."""
    specs = list(specs)
    known = F.coalesce(F.col("endpoint").isin([s.name for s in specs]), F.lit(False))
    status = F.when(~known, "unknown_endpoint").when(~_supported(specs), "unsupported_symbol").otherwise(
        payloads.document_status())
    return landed.groupBy("endpoint", status.alias("status")).agg(F.count(F.lit(1)).alias("documents"))


def _snapshot_records(documents: DataFrame) -> DataFrame | None:
    """The records of readable documents with whatever columns they have, and the document's symbol; None
    without any. They pass through files, one document a line, whose columns Spark infers."""
    good = documents.filter(payloads.document_status() == "ok")
    line = F.to_json(F.try_parse_json(F.col(payloads.DOCUMENT))).alias(payloads.DOCUMENT)
    path = scratch_path(documents.sparkSession, "snapshot-lines")
    good.select(F.col("symbol").cast("string").alias("of_symbol"), line).write.partitionBy("of_symbol").text(path)
    try:
        read = payloads.read_snapshot(documents.sparkSession, path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise
    return read.withColumn("symbol", F.col("of_symbol").cast("string")).drop("of_symbol")


def _dates(spark: SparkSession, path: str, spec: PayloadSpec) -> DataFrame | None:
    """Keys and times of an endpoint's stored rows; snapshots have neither interval nor time."""
    stored = history.stored_table(spark, f"{path}/{spec.name}")
    if stored is None or spec.shape != "snapshot":
        return None if stored is None else stored.select(*SUMMARY_KEYS, "ts")
    return stored.select(F.lit(None).cast("string").alias("interval"), "symbol", "endpoint", F.lit(None).cast("timestamp").alias("ts"))


def with_scope_names(summary: DataFrame, api_version: str = "v4") -> DataFrame:
    """The summary under one ``scope`` and ``name``, as in ``v4_4h`` and ``BTC_basis``, or ``v4_global`` and
    ``cgdi``, ``v4_snapshot`` and ``BTC_oi_exchange``."""
    other = {s.name: s.scope for s in SPECS.values() if s.scope != "symbol_interval"}
    scopes = F.create_map(*(F.lit(x) for pair in other.items() for x in pair))
    return summary.select(
        F.concat(F.lit(f"{api_version}_"), F.coalesce(scopes[F.col("endpoint")], F.col("interval"))).alias("scope"),
        F.concat_ws("_", "symbol", "endpoint").alias("name"), "rows", "start", "end")
