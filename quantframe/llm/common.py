"""Steps that several text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantframe.session import ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
ROW, TEXT = "row", "_text"
PIECE_BYTES = 4 << 20
#: Only these end a chunk; other white space is left to the vocabulary's own rules.
BLANKS = bytes(32 if b in b" \t\n\r" else b for b in range(256))
STOP = re.compile(rb"(?<=[a-z])([,.])(?= |\Z)")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, as the word contracts ask."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, even inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_of(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A NULL id counts as the text ``null``."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")), F.lit(folds))


def pieces(array: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes of text each; a longer text stands alone."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(array), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def spaced(text: bytes) -> bytes:
    """A text in which blanks part the pieces that a lower-casing vocabulary without blanks encodes one by one.

    A blank goes before a comma or full stop that ends a piece after a letter, so that a word has one form; letters
    are lower-cased in ASCII, unless the text may hold a special token, whose case matters.
    """
    text = text.translate(BLANKS)
    return text if b"<|" in text else STOP.sub(b" \\1", text.lower())


def chunks_of(text: bytes) -> list[bytes]:
    """The pieces of ``spaced``."""
    return spaced(text).split(b" ")


def spaced_batch(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """``spaced`` texts with a blank between them, and the number of pieces up to the end of each."""
    joined = b" ".join(texts).translate(BLANKS)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if b"<|" in joined:
        each = list(map(spaced, texts))
        return b" ".join(each), np.cumsum([t.count(b" ") + 1 for t in each])
    data = np.frombuffer(joined.lower() + b" ", dtype=np.uint8)
    stop = ((data[1:-1] == 44) | (data[1:-1] == 46)) & (data[2:] == 32) & (data[:-2] >= 97) & (data[:-2] <= 122)
    at = np.flatnonzero(stop) + 1
    ends = np.cumsum(sizes + 1) - 1
    ends += np.searchsorted(at, ends)
    data = np.insert(data[:-1], at, 32)
    return data.tobytes(), np.searchsorted(np.flatnonzero(data == 32), ends) + 1


def map_texts(df: DataFrame, text: str | Column, make: Callable[[], Callable[[list[bytes]], Sequence[Sequence]]],
              fields: Sequence[T.StructField], keep: Sequence[str] | None = None, limit: int = PIECE_BYTES) -> DataFrame:
    """Columns computed from one text column in Arrow batches, beside a struct ``row`` of the input's columns.

    ``make()`` runs once per task and returns a function from a list of UTF-8 texts (NULL becomes empty) to
    one sequence per field. ``keep`` names the columns that ``row`` carries, all by default. Because they
    travel inside the struct, no column name of the input can clash with a computed one.
    """
    ship_package(df.sparkSession)
    kept = df.columns if keep is None else list(keep)
    column = F.col(text) if isinstance(text, str) else text
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(0).alias("_none"))
    source = df.select(row.alias(ROW), column.cast("string").alias(TEXT))
    schema = T.StructType([source.schema[ROW], *fields])
    names = [f.name for f in fields]
    types = [f.type for f in to_arrow_schema(T.StructType(list(fields)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for a, b in pieces(texts, limit):
                values = compute([x or b"" for x in texts.slice(a, b - a).to_pylist()])
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), *arrays], [ROW, *names])

    return source.mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)
