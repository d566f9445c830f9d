"""Removal of byte strings that occur more than once, by a depth-limited radix sort of sparse suffixes.

Suffixes. Ordering the suffix at every byte would move many times the input. Each window of ``depth`` bytes is
therefore read from an anchor inside it: of the first ``reach`` positions of the window the one whose eight bytes
have the least hash. Equal windows have the same anchor at the same place, neighbouring windows mostly share one, so
about two anchors in ``reach`` bytes stand for all windows. A set of windows of one anchor has a core, the bytes that
all of them hold, and a span, the bytes that any of them holds.

Passes. Most significant digits first: a pass groups the sets by their cores, at first ``depth - reach + 1`` bytes
long. Sets alone with their core hold no repeated window and leave. Sets that share core and span with another one
are repeated as a whole and leave too. The others are cut into smaller sets, whose cores are longer; in the last
pass a set is a single window and its core is the window, so that equal groups are exactly the repeated windows.
Only the ends of matching passages get that far.

Groups are compared by two 64-bit fingerprints with different seeds, of core and span; they are only counted, with
sums before the shuffle, and the counts joined back, so no group meets in one task however many copies it has.

Texts are keyed by a 128-bit hash; what is found for a text holds for all its copies.

Defined cases: NULL counts as empty; nothing of a text shorter than ``depth`` bytes is removed; rows with equal text
are each other's copies whatever their ids; NULL ids and repeated ids are rows like others; an empty table gives no
rows; very long texts are read in slices of bounded size; columns of the input travel in the struct ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import field, pieces
from quantframe.session import materialize, ship_package

GRAM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Strings of ``depth`` bytes; anchors are chosen among ``reach`` positions; sets are cut to ``cuts`` windows."""

    depth: int = 400
    reach: int = 256
    cuts: tuple[int, ...] = (32, 4, 1)
    slice_bytes: int = 1 << 20

    def __post_init__(self):
        if not 1 <= self.reach <= self.depth - GRAM + 1:
            raise ValueError("reach must leave room for eight bytes in a window")
        if self.cuts[-1] != 1:
            raise ValueError("the last cut is single windows")


def anchors(data: np.ndarray, reach: int) -> np.ndarray:
    """For each position p with ``reach`` grams from it on, the place of the first one of least hash."""
    n = len(data) - GRAM + 1
    if n < reach:
        return np.zeros(0, dtype=np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)
    hashed = np.ascontiguousarray(grams).view(np.uint64).reshape(-1) * MIX
    hashed ^= hashed >> np.uint64(31)
    hashed *= MIX
    least = (hashed >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    # the least of a run of ``reach`` from overlapping runs of powers of two
    have = 1
    while have * 2 <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < reach:
        least = np.minimum(least[:n - reach + 1], least[reach - have:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fingerprints(text: bytes, a: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, settings: Settings):
    """Cores and spans of sets of windows low to high of anchor a, where a set is ``size`` windows long at most.

    The set's place on its anchor's grid fixes core and span, whichever of its windows the text has. That place seeds
    the fingerprints, so that sets of two anchors over the same bytes are not taken for copies; so does the core's
    place in the span, where a text begins or ends inside it.
    """
    depth, n = settings.depth, len(text)
    first = a - (a - high) // size * size  # last window of the set's place on the grid
    view, of = memoryview(text), xxhash.xxh3_64_intdigest
    cores, spans = [], []
    for last, place in zip(first.tolist(), (a - first).tolist(), strict=True):
        start = max(0, last - size + 1)
        cores.append(of(view[last:last - size + 1 + depth], place))
        spans.append(of(view[start:min(n, last + depth)], 1 << 62 | last - start << 31 | place))
    return (np.array(cores, dtype=np.uint64).view(np.int64), np.array(spans, dtype=np.uint64).view(np.int64))


def whole_sets(text: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last window) of all windows of a text, read in slices."""
    windows, step = len(text) - settings.depth + 1, settings.slice_bytes
    found = []
    data = np.frombuffer(text, dtype=np.uint8)
    for start in range(0, windows, step):
        end = min(start + step, windows)
        at = anchors(data[start:end + settings.reach + GRAM - 2], settings.reach)[:end - start] + start
        cut = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        found.append((at[cut], cut + start, np.append(cut[1:], end - start) + start - 1))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    a, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    same = np.nonzero(a[1:] == a[:-1])[0]  # an anchor met on both sides of a slice's border
    return a[np.delete(np.arange(len(a)), same + 1)], np.delete(low, same + 1), np.delete(high, same)


def cut_sets(a: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of ``size`` windows at most, on the grid that starts at the anchor."""
    near, far = (a - high) // size, (a - low) // size
    count = far - near + 1
    owner = np.repeat(np.arange(len(a)), count)
    k = near[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    a = a[owner]
    return a, np.maximum(low[owner], a - k * size - size + 1), np.minimum(high[owner], a - k * size)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text, F.lit(k)).alias(f"t{k}") for k in (1, 2)]


def _sets_of(texts: DataFrame, settings: Settings, size: int = 0) -> DataFrame:
    """(t1, t2, a, low, high, core, span) of all windows of (t1, t2, text) rows, or of the sets ``open`` that such
    rows list, cut to ``size`` windows."""
    ship_package(texts.sparkSession)
    schema = T.StructType([field(n, "bigint") for n in ("t1", "t2", "a", "low", "high", "core", "span")])
    binary = F.col("text").cast("binary").alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, e in pieces(batch.column(2), settings.slice_bytes):
                keys = [batch.column(k).slice(b, e - b).to_numpy() for k in (0, 1)]
                found = []
                for i in range(b, e):
                    text = batch.column(2)[i].as_py()
                    if size:
                        own = batch.column(3)[i].values
                        sets = cut_sets(*(own.field(n).to_numpy() for n in ("a", "low", "high")), size)
                    else:
                        sets = whole_sets(text, settings)
                    found.append((*sets, *fingerprints(text, *sets, size or settings.reach, settings)))
                counts = [len(x[0]) for x in found]
                columns = [*(np.repeat(k, counts) for k in keys), *(np.concatenate(c) for c in zip(*found, strict=True))]
                for at in range(0, sum(counts), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 100_000], pa.int64()) for c in columns], schema.names)

    columns = ["t1", "t2", binary] + (["open"] if size else [])
    return texts.select(*columns).mapInArrow(run, schema)


def _pass(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of sets of equal core with a partner: ((t1, t2, low, high) of sets repeated as a whole, (t1, t2, a, low,
    high) of sets to cut, with one of each repeated kind that shares their core)."""
    sets = materialize(sets, "sets")
    # counts are tables, so that both sides of a join are shuffled and adaptive execution can split a frequent core
    shared = materialize(sets.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "cores")
    left = materialize(sets.join(shared, "core"), "shared_sets")
    kinds = materialize(left.groupBy("core", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "a", "low", "high")).alias("first")), "kinds")
    whole = left.join(kinds.filter("n > 1").select("core", "span"), ["core", "span"]).select("t1", "t2", "low", "high")
    undecided = materialize(kinds.filter("n = 1").select("core").distinct(), "undecided")
    return whole, kinds.join(undecided, "core").select("first.*")


def repeated_ranges(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(t1, t2, ranges) for (t1, t2, text) rows: first and last starts of repeated windows, for each text that has any."""
    whole, open_ = _pass(_sets_of(texts, settings))
    found = [materialize(whole, "repeated")]
    for size in settings.cuts:
        listed = open_.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "low", "high")).alias("open"))
        listed = materialize(listed, "open")
        if size == settings.cuts[0]:
            texts = materialize(texts.join(listed.select("t1", "t2"), ["t1", "t2"]).dropDuplicates(["t1", "t2"]), "open_texts")
        whole, open_ = _pass(_sets_of(texts.join(listed, ["t1", "t2"]), settings, size))
        found.append(materialize(whole, "repeated"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows.groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))


def runs_of(low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes that windows with starts low to high cover."""
    order = np.argsort(low, kind="stable")
    start, end = low[order], np.maximum.accumulate(high[order] + depth)
    cut = np.nonzero(start[1:] > end[:-1])[0] + 1
    return start[np.concatenate([[0], cut])], end[np.concatenate([cut - 1, [len(end) - 1]])]


def remove_repeated(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
                    settings: Settings = Settings()) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` is what is left, as bytes."""
    kept = docs.columns if keep is None else list(keep)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(0).alias("_none"))
    source = docs.select(row.alias("row"), whole.alias("text"))
    source = source.select("row", *text_key(F.col("text")), F.col("text"))
    texts = source.filter(F.octet_length("text") >= settings.depth).select("t1", "t2", "text")
    ranges = materialize(repeated_ranges(texts, settings), "ranges")
    joined = source.join(ranges, ["t1", "t2"], "left").select("row", F.col("text").cast("binary").alias("text"), "ranges")
    ship_package(docs.sparkSession)
    schema = T.StructType([joined.schema["row"], field("n_bytes", "bigint"), field("n_removed", "bigint"),
                           field("n_spans", "bigint"), field("kept", "binary"), field("kept_sha256", "string")])
    depth = settings.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, e in pieces(batch.column(1)):
                out = []
                for i in range(b, e):
                    text, own = batch.column(1)[i].as_py(), batch.column(2)[i].values
                    left, removed, spans = text, 0, 0
                    if own is not None and len(own):
                        start, end = runs_of(own.field("low").to_numpy(), own.field("high").to_numpy(), depth)
                        left = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
                        removed, spans = int((end - start).sum()), len(start)
                    out.append((len(text), removed, spans, left, hashlib.sha256(left).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), batch.schema.field(1).type, pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, e - b), *columns], schema.names)

    return joined.mapInArrow(run, schema)
