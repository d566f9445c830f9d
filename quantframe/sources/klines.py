"""Candlestick files to OHLCV bars."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.plans.latest import keep_last
from quantframe.session import ship_package
from quantframe.sources.specs import BAR_FIELDS, KLINE_FIELDS

BLOCK_BYTES = 1 << 20
BAR_MINUTES = 15
SYMBOL_IN_FILE_NAME = r"([A-Z0-9]+)USDT-"


def _text_number(column: Column) -> Column:
    value = F.trim(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def _millis(column: Column) -> Column:
    return F.timestamp_micros(F.round(_text_number(column) * 1_000).cast("long"))


def bars_from_fields(rows: DataFrame, fields: Column, kept: Sequence[str]) -> DataFrame:
    """Bars from an array of text fields; rows without a readable time, as headers, fall out."""
    values = (_text_number(F.get(fields, KLINE_FIELDS.index(name))).alias(name) for name in BAR_FIELDS)
    return rows.select(*kept, _millis(F.get(fields, 0)).alias("ts"), *values).filter(F.col("ts").isNotNull())


def _unzip_blocks(batches: Iterable[pd.DataFrame], every: bool) -> Iterable[pd.DataFrame]:
    """Text of the members of each archive in blocks of whole lines, streamed. A line longer than a block stays whole."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                files = [m for m in archive.infolist() if not m.is_dir()]
                for number, member in enumerate(files if every else files[:1]):
                    with archive.open(member) as stream:
                        block_no, rest = 0, b""
                        while data := stream.read(BLOCK_BYTES):
                            whole, newline, rest = (rest + data).rpartition(b"\n")
                            if newline:
                                yield _block_frame(path, number, block_no, whole)
                                block_no += 1
                        if rest:
                            yield _block_frame(path, number, block_no, rest)


def _block_frame(path: str, member: int, block: int, text: bytes) -> pd.DataFrame:
    return pd.DataFrame({"path": [path], "member": [member], "block": [block], "text": [text.decode("utf-8", "replace")]})


def read_kline_zips(spark: SparkSession, path: str, symbol_pattern: str = SYMBOL_IN_FILE_NAME,
                    every_member: bool = False) -> DataFrame:
    """Bars of all zip archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return bars_from_zips(files, symbol_pattern, every_member)


def bars_from_zips(files: DataFrame, symbol_pattern: str = SYMBOL_IN_FILE_NAME, every_member: bool = False) -> DataFrame:
    """Bars of zipped candlestick CSV files (``path``, ``content``), last line per (symbol, ts).

    The first member of an archive is read, as its files are published, or every one in the archive's order. Spark has no
    zip codec, so Python opens the archives and passes blocks of about a megabyte on; lines are cut and read in columns. One
    archive is one input row; monthly archives are far under the 2 GB a row may hold.
    """
    ship_package(files.sparkSession)
    blocks = files.select("path", "content").mapInPandas(
        lambda batches: _unzip_blocks(batches, every_member), "path string, member int, block int, text string")
    order = ["path", "member", "block", "line_no"]
    lines = blocks.select("path", "member", "block", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    symbol = F.regexp_extract(F.element_at(F.split("path", "/"), -1), symbol_pattern, 1)
    bars = bars_from_fields(lines.withColumn("symbol", symbol), F.split("line", ","), ["symbol", *order])
    return keep_last(bars, ["symbol", "ts"], order).select("symbol", "ts", *BAR_FIELDS)


def read_kline_csv(spark: SparkSession, path: str, kept: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of plain or gzipped CSV files. ``kept`` names directory levels to keep, as ``symbol=BTC``."""
    names = [f.name for f in _csv_schema().fields]
    rows = spark.read.schema(_csv_schema()).csv(path)
    return bars_from_fields(rows, F.array(*names), [c for c in kept if c in rows.columns])


def _csv_schema() -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", T.StringType()) for n in KLINE_FIELDS])


def parse_kline_pages(raw: DataFrame, document: str = "value") -> DataFrame:
    """Bars of JSON pages, each an array of 12-element arrays that mix numbers and quoted numbers."""
    kept = [c for c in raw.columns if c != document]
    pages = F.from_json(F.col(document), T.ArrayType(T.ArrayType(T.StringType())))
    rows = raw.select(*kept, F.posexplode(pages).alias("record_no", "_fields"))
    return bars_from_fields(rows, F.col("_fields"), [*kept, "record_no"])


def normalize_bars(bars: DataFrame, order_by: Sequence[str], key: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Key and numeric OHLCV columns only, bad numbers NULL, last record per key in ``order_by``."""
    def number(name: str) -> Column:
        value = F.col(name).try_cast("double")
        return F.when(~F.isnan(value), value).alias(name)

    typed = bars.select(*key, *order_by, *(number(n) for n in BAR_FIELDS))
    return keep_last(typed, list(key), list(order_by)).select(*key, *BAR_FIELDS)


def drop_forming_bars(bars: DataFrame, as_of: Column, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Without bars that were still open at ``as_of``."""
    return bars.filter(F.col("ts") + F.make_dt_interval(mins=F.lit(bar_minutes)) <= as_of)
