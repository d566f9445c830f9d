"""Landed JSON payloads to typed tables.

Input is one JSON document per row in a ``value`` column, as ``spark.read.text`` and
``spark.readStream.text`` give it. A document is a response envelope ``{"code": ..., "data": ...}`` or,
with ``envelope=False``, its data alone. Other columns of the input (symbol, interval) are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.sources.specs import PayloadSpec, spec_for

DOCUMENT = "value"
MILLIS_FROM = 1e12
SUCCESS = "0"


def epoch_to_timestamp(value: Column) -> Column:
    """Seconds or milliseconds to a timestamp; a magnitude from 1e12 on means milliseconds."""
    number = value.cast("double")
    micros = F.when(F.abs(number) >= MILLIS_FROM, number * 1_000).otherwise(number * 1_000_000)
    return F.timestamp_micros(F.round(micros).cast("long"))


def _number(column: Column, spec: PayloadSpec) -> Column:
    value = column.cast("double") if spec.strict else column.try_cast("double")
    return F.when(~F.isnan(value), value)


def _timestamp(column: Column, spec: PayloadSpec) -> Column:
    number = column.cast("double") if spec.strict else column.try_cast("double")
    if spec.epoch == "s":
        return F.timestamp_micros(F.round(number * 1_000_000).cast("long"))
    return epoch_to_timestamp(number)


def _record_type(spec: PayloadSpec) -> T.StructType:
    """All fields are read as text: sources mix numbers and quoted numbers."""
    return T.StructType([T.StructField(f, T.StringType()) for f in (spec.time_field, *spec.fields)])


def document_status(envelope: bool = True) -> Column:
    """``unreadable`` (no JSON), ``refused`` (another code than 0), ``no_data``, or ``ok``."""
    status = F.when(F.try_parse_json(F.col(DOCUMENT)).isNull(), "unreadable")
    if envelope:
        status = status.when(F.get_json_object(DOCUMENT, "$.code") != SUCCESS, "refused")
        status = status.when(F.get_json_object(DOCUMENT, "$.data").isNull(), "no_data")
    return status.otherwise("ok")


def _records(raw: DataFrame, spec: PayloadSpec, envelope: bool) -> DataFrame:
    """One row per record, in column ``_r`` with its place ``record_no`` in the document."""
    kept = [c for c in raw.columns if c != DOCUMENT]
    if spec.shape == "parallel":
        body = T.StructType([T.StructField(f, T.ArrayType(T.StringType()))
                             for f in (spec.time_field, *spec.fields)])
    elif envelope:
        body = T.ArrayType(_record_type(spec))
    else:
        body = _record_type(spec)
    response = T.StructType([T.StructField("code", T.StringType()), T.StructField("data", body)])
    parsed = F.from_json(F.col(DOCUMENT), response if envelope else body)
    data = parsed
    if envelope:
        data = F.when(F.coalesce(parsed["code"], F.lit(SUCCESS)) == SUCCESS, parsed["data"])
    if spec.shape == "parallel":
        lists = [data[f] for f in (spec.time_field, *spec.fields)]
        well_formed = F.size(lists[0]) == F.size(lists[1])
        data = F.when(well_formed, F.arrays_zip(*lists))
    elif not envelope:
        # a line that is no object parses to a record without any field
        filled = F.coalesce(*(data[f] for f in (spec.time_field, *spec.fields)))
        data = F.when(filled.isNotNull(), F.array(data))
    if spec.strict:
        status = document_status(envelope)
        # an answer without data has no records; anything else that gives none is an error
        wrong = ~status.isin("no_data", "ok") | (status == "ok" if envelope else F.lit(False))
        failure = F.raise_error(F.concat(F.lit(f"{spec.name}: bad document: "), F.substring(DOCUMENT, 1, 200)))
        data = F.when(data.isNull(), F.when(wrong, failure)).otherwise(data)
    return raw.select(*kept, F.posexplode(data).alias("record_no", "_r"))


def parse_payload(raw: DataFrame, spec: PayloadSpec | str, envelope: bool = True) -> DataFrame:
    """``ts`` and the endpoint's value columns for each record, next to the kept input columns.

    Fields a record lacks are NULL. A document that is malformed, refused or wrongly shaped fails the job
    where the spec is strict, and gives no rows elsewhere (``corrupt_documents`` lists them).
    """
    spec = spec_for(spec) if isinstance(spec, str) else spec
    if spec.shape == "snapshot":
        raise ValueError(f"{spec.name!r} is a snapshot: use read_snapshot")
    kept = [c for c in raw.columns if c != DOCUMENT]
    rows = _records(raw, spec, envelope)
    values = {out: _number(F.col("_r")[f], spec) for f, out in spec.fields.items()}
    typed = rows.select(*kept, "record_no", _timestamp(F.col("_r")[spec.time_field], spec).alias("ts"),
                        *(c.alias(n) for n, c in values.items()))
    return typed.withColumns({name: F.expr(formula) for name, formula in spec.derived.items()})


def corrupt_documents(raw: DataFrame, envelope: bool = True) -> DataFrame:
    """Input rows that are no JSON document, or where an envelope is expected, were refused or carry no ``data``."""
    return raw.filter(document_status(envelope) != "ok")


def read_payload(spark: SparkSession, path: str, spec: PayloadSpec | str, envelope: bool = True) -> DataFrame:
    """Parse landed files. Directory levels such as ``symbol=BTC/interval=4h`` become columns."""
    return parse_payload(spark.read.text(path), spec, envelope)


def _data_fields(read: DataFrame) -> DataFrame:
    if "data" not in read.columns:
        return read
    extra = [c for c in read.columns if c not in ("code", "msg", "data", "success")]
    if isinstance(read.schema["data"].dataType, T.ArrayType):
        return read.select(*extra, F.inline("data"))
    return read.select(*extra, "data.*")


def read_snapshot(spark: SparkSession, path: str, envelope: bool = True,
                  schema: T.StructType | None = None) -> DataFrame:
    """Undated records with whatever columns they have; a document may be one record or a list.

    Without ``schema`` Spark infers one from the files, which costs a pass over them.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    read = reader.json(path)
    return _data_fields(read) if envelope else read
