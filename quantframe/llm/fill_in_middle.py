"""Fill-in-middle documents over seekable compressed texts.

Layout. A text is stored as independent zstandard frames of ``frame_units`` code points each, beside the
cumulative unit counts at the frames' ends. A range of units therefore touches only the frames that hold it.

Transformation. Two cuts split a text into prefix, middle and suffix. The output is again a list of frames: whole
frames between the cuts are passed on as they are, only the frames that a cut goes through are decompressed and
split. Digests stream the frames in order, so a task holds one document's compressed frames and one open frame.

    plain   the text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

Cuts and forms follow the sha256 of the id, not the row's place, so every run gives the same output.

Defined cases: a NULL text counts as empty and is plain; texts that hold a mark are plain; a NULL id is hashed as
the text ``null``; rows of one id are each treated alone, equal rows alike; very long texts become many frames; an
empty table gives no rows; columns of the input travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantframe.llm.common import field, map_texts
from quantframe.session import ship_package

MARKS = P, S, M = b"<P>", b"<S>", b"<M>"
ERRORS = "surrogateescape"


@dataclass(frozen=True)
class Settings:
    """``plain_percent`` of the texts stay plain; of the others ``spm_percent`` begin with the suffix."""

    plain_percent: int = 10
    spm_percent: int = 20
    seed: str = "1"
    frame_units: int = 4096
    level: int = 3


def pack(text: str, frame_units: int, compress) -> tuple[list[bytes], list[int]]:
    """(frames, cumulative units) of a text; an empty text has no frames."""
    starts = range(0, len(text), frame_units)
    frames = [compress(text[a:a + frame_units].encode("utf-8", ERRORS)) for a in starts]
    return frames, [min(a + frame_units, len(text)) for a in starts]


def cut_out(frames: Sequence[bytes], ends: Sequence[int], low: int, high: int, compress, decompress) -> Iterator[bytes]:
    """Frames of the units ``low`` to ``high``; only frames that a border goes through are opened."""
    if low >= high:
        return
    for k in range(bisect_right(ends, low), bisect_left(ends, high) + 1):
        start = ends[k - 1] if k else 0
        if low <= start and ends[k] <= high:
            yield frames[k]
        else:
            inside = decompress(frames[k]).decode("utf-8", ERRORS)
            yield compress(inside[max(low - start, 0):high - start].encode("utf-8", ERRORS))


def arrange(form: str, parts: tuple[Iterable[bytes], Iterable[bytes], Iterable[bytes]], compress) -> list[bytes]:
    """Frames of the output from the frames of prefix, middle and suffix."""
    prefix, middle, suffix = parts
    p, s, m = (compress(x) for x in MARKS)
    if form == "psm":
        return [p, *prefix, s, *suffix, m, *middle]
    return [s, *suffix, p, *prefix, m, *middle]


def marks_at(frames: Iterable[bytes]) -> dict[bytes, int]:
    """Byte offset of each mark in a stream of plain frames, also where it lies over a border of frames."""
    found, seen, tail = {}, 0, b""
    for frame in frames:
        window = tail + frame
        for mark in MARKS:
            at = window.find(mark)
            if at >= 0 and mark not in found:
                found[mark] = seen - len(tail) + at
        seen += len(frame)
        tail = window[-2:]
    return found | {b"": seen}


def between(frames: Iterable[bytes], low: int, high: int) -> Iterator[bytes]:
    """Bytes ``low`` to ``high`` of a stream."""
    start = 0
    for frame in frames:
        if start < high and start + len(frame) > low:
            yield frame[max(low - start, 0):high - start]
        start += len(frame)


def restored(frames: Sequence[bytes], form: str, decompress) -> Iterator[bytes]:
    """The text behind an output, in pieces, from the output and its form alone."""
    def stream() -> Iterator[bytes]:
        return map(decompress, frames)

    if form == "plain":
        yield from stream()
        return
    at = marks_at(stream())
    p, s, m, end = at[P], at[S], at[M], at[b""]
    prefix, suffix = ((p + 3, s), (s + 3, m)) if form == "psm" else ((p + 3, m), (s + 3, p))
    for low, high in (prefix, (m + 3, end), suffix):
        yield from between(stream(), low, high)


def seekable(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
             settings: Settings = Settings()) -> DataFrame:
    """(row, n, marked, frames, ends): each text as frames with cumulative unit counts."""
    units, level = settings.frame_units, settings.level

    def make():
        compress = zstandard.ZstdCompressor(level=level).compress

        def compute(texts: list[bytes]):
            packed = [pack(t.decode("utf-8", ERRORS), units, compress) for t in texts]
            return ([ends[-1] if ends else 0 for _, ends in packed], [any(m in t for m in MARKS) for t in texts],
                    [frames for frames, _ in packed], [ends for _, ends in packed])

        return compute

    fields = [field("n", "bigint"), field("marked", "boolean"), field("frames", "array<binary>"),
              field("ends", "array<bigint>")]
    return map_texts(docs, text, make, fields, keep=keep, limit=1 << 20)


def _plan(stored: DataFrame, key: Column, settings: Settings) -> DataFrame:
    """Adds form and the two cuts, which follow from the id and the length."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4))
    places = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - settings.plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < settings.spm_percent, "spm").otherwise("psm")
    return stored.select("row", "n", form.alias("form"), F.least(h1 % places, h2 % places).alias("low"),
                         F.greatest(h1 % places, h2 % places).alias("high"), "frames", "ends")


def fill_in_middle(stored: DataFrame, doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, frames) of a ``seekable`` table: outputs as frames."""
    ship_package(stored.sparkSession)
    planned = _plan(stored, F.col("row")[doc_id], settings)
    kinds = [field("n", "bigint"), field("form", "string"), field("prefix_chars", "bigint"),
             field("middle_chars", "bigint"), field("frames", "array<binary>")]
    schema = T.StructType([planned.schema["row"], *kinds])
    frames_type = to_arrow_schema(T.StructType([kinds[-1]])).field(0).type
    level = settings.level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, n, form, low, high, frames, ends = batch.columns
            out = []
            for i, kind in enumerate(form.to_pylist()):
                own = frames[i].as_py()
                if kind != "plain":
                    at, a, b = ends[i].as_py(), low[i].as_py(), high[i].as_py()
                    own = arrange(kind, tuple(cut_out(own, at, x, y, compress, decompress) for x, y in (
                        (0, a), (a, b), (b, at[-1]))), compress)
                out.append(own)
            split = pa.compute.not_equal(form, "plain")
            nothing = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays([
                rows, n, form, pa.compute.if_else(split, low, nothing),
                pa.compute.if_else(split, pa.compute.subtract(high, low), nothing), pa.array(out, frames_type)],
                ["row", *(k.name for k in kinds)])

    return planned.mapInArrow(run, schema)


def output_digests(outputs: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` without frames, with the sha256 of the output and of the rebuilt text."""
    ship_package(outputs.sparkSession)
    schema = T.StructType([*(f for f in outputs.schema if f.name != "frames"), field("output_sha256", "string"),
                           field("restored_sha256", "string")])

    def digest(pieces: Iterable[bytes]) -> str:
        total = hashlib.sha256()
        for piece in pieces:
            total.update(piece)
        return total.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            frames, forms = batch.column(batch.schema.get_field_index("frames")), batch.column(2).to_pylist()
            sums = []
            for i, form in enumerate(forms):
                own = frames[i].as_py()
                sums.append((digest(map(decompress, own)), digest(restored(own, form, decompress))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([a for a, _ in sums], pa.string()), pa.array([b for _, b in sums], pa.string())],
                schema.names)

    return outputs.mapInArrow(run, schema)


def output_texts(outputs: DataFrame) -> DataFrame:
    """(row, form, output): the outputs as texts."""
    ship_package(outputs.sparkSession)
    schema = T.StructType([outputs.schema["row"], field("form", "string"), field("output", "string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [b"".join(map(decompress, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], schema.names)

    return outputs.select("row", "frames", "form").mapInArrow(run, schema)
