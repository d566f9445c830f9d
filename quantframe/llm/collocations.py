"""Phrase collocations per language from count streams in prefix and suffix order.

Counts. Phrases are counted by length, shortest first: a phrase of m words can only be frequent if both its parts of
m - 1 words are, so a pass counts only phrases whose parts are set in a bit table filled from the pass before. The
table has a fixed most size; where it fills up, more rare phrases are counted and dropped afterwards, with the same
result. Tasks add up what a bounded run of words holds before anything is shuffled; a phrase's words, never hashes
of them, are its key.

Streams. The frequent phrases are laid out twice: ordered by their words (prefix order) and by their words from the
last to the first (suffix order), cut into ranges. In prefix order the parts that begin a phrase come right before
it and its extensions by one word follow it, so one pass in lockstep with a stack of the open phrases reads off the
counts of all first parts and the largest extension to the right; the suffix stream gives last parts and extensions
to the left in the same way. A range starts with the open phrases of the ranges before, which are looked up for its
first phrase only, so ranges are independent and no key has to fit one task.

Score of a cut into l and r: floor(1000 * a * n / (l * r)) in exact decimals; a phrase has the lowest of its cuts.
A phrase is dropped when a longer one that holds it is as frequent. Extensions by one word suffice for that, as
every phrase between two of equal count has that count.

Defined cases: NULL text has no words; NULL language is ``und``; repeated rows count each time; a very long text is a
run of its own, so a task holds the words of one text or ``run_words``; ties are ranked by score, count and the
phrase's bytes; an empty table or one without frequent phrases gives no rows; columns other than text and language
are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.session import materialize, ship_package

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Not part of any UTF-8 text.
BREAK = b"\xff"
CLEAN = bytes(0xFF if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
RARE = -1
MIX, TURN = np.uint64(0xFF51AFD7ED558CCD), np.uint64(29)


@dataclass(frozen=True)
class Settings:
    """Phrases of 2 to ``longest`` words with ``least`` occurrences; the best ``top`` of each language. A phrase is
    dropped if a longer one has ``percent`` of its count."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    percent: int = 100
    run_words: int = 1 << 20
    least_bits: int = 16
    most_bits: int = 26


def _mixed(left: np.ndarray | int, right: np.ndarray) -> np.ndarray:
    out = (np.bitwise_xor(left, right) * MIX).astype(np.uint64)
    return out ^ (out >> TURN)


def phrase_hash(lang: bytes, words: Sequence[bytes]) -> int:
    """Place of a phrase in the bit table before it is cut to the table's size."""
    at = np.array([xxhash.xxh3_64_intdigest(lang)], dtype=np.uint64)
    for word in words:
        at = _mixed(at, np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64))
    return int(at[0])


class BitTable:
    """Fixed-size set of hashes that may hold more than was put in, never less."""

    def __init__(self, log2_bits: int, places: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - log2_bits)
        self.table = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
        self.table[places] = values.view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class PhraseCounter:
    """Counts of the phrases of some lengths, for runs of texts of one language at a time."""

    def __init__(self, lengths: Sequence[int], tables: Mapping[int, BitTable]):
        self.lengths, self.tables = tuple(lengths), dict(tables)
        self.start()

    def start(self) -> None:
        self.known: dict[bytes, dict[bytes, int]] = {}
        self.runs: dict[bytes, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: bytes, text: bytes) -> None:
        known = self.known.setdefault(lang, {BREAK: RARE})
        words = text.translate(CLEAN).replace(BREAK, b" \xff ").split()
        # only blanks and tabs are left as white space
        fresh = list(set(words).difference(known))
        if fresh and 1 in self.tables:
            base = np.uint64(xxhash.xxh3_64_intdigest(lang))
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in fresh], dtype=np.uint64)
            for word, kept in zip(fresh, self.tables[1](_mixed(base, hashes)).tolist(), strict=True):
                known[word] = len(known) if kept else RARE
        else:
            for word in fresh:
                known[word] = len(known)
        self.runs.setdefault(lang, []).append(np.array([*map(known.__getitem__, words), RARE], dtype=np.int64))
        self.size += len(words)

    def counted(self) -> Iterator[tuple[bytes, list[bytes], list[int]]]:
        """(language, phrases, counts) of what was added, and start anew."""
        for lang, runs in self.runs.items():
            yield from ((lang, *x) for x in self._count(lang, np.concatenate(runs)))
        self.start()

    def _count(self, lang: bytes, x: np.ndarray) -> Iterator[tuple[list[bytes], list[int]]]:
        names = list(self.known[lang])
        # a word's id is its place among all words seen, also where others are RARE
        if 1 in self.lengths:
            counts = np.bincount(x[x >= 0], minlength=len(names))
            present = np.nonzero(counts)[0]
            yield [names[k] for k in present.tolist()], counts[present].tolist()
        if max(self.lengths) == 1:
            return
        word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in names], dtype=np.uint64)[x]
        hashes = _mixed(np.uint64(xxhash.xxh3_64_intdigest(lang)), word_hash)
        fits = x >= 0
        for m in range(2, min(max(self.lengths), len(x)) + 1):
            # a phrase may count if both its parts of m - 1 words may
            fits = fits[:-1] & fits[1:]
            if m in self.lengths:
                yield self._phrases(x, np.nonzero(fits)[0], m, len(names) + 1, names)
            hashes = _mixed(hashes[:-1], word_hash[m - 1:])
            if m in self.tables:
                at = np.nonzero(fits)[0]
                fits[at] = self.tables[m](hashes[at])

    @staticmethod
    def _phrases(x: np.ndarray, at: np.ndarray, m: int, width: int, names: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The distinct phrases of m words at some places, and how often they are there."""
        if width ** m < 1 << 63:
            keys = x[at]
            for k in range(1, m):
                keys = keys * width + x[at + k]
            keys, counts = np.unique(keys, return_counts=True)
            ids = [keys // width ** k % width for k in reversed(range(m))]
        else:
            # too many digits for one number: the number of what came before stands for it
            keys = x[at]
            for k in range(1, m):
                keys = np.unique(keys, return_inverse=True)[1] * width + x[at + k]
            _, first, counts = np.unique(keys, return_index=True, return_counts=True)
            ids = [x[at[first] + k] for k in range(m)]
        return [b" ".join([names[k] for k in row]) for row in zip(*(i.tolist() for i in ids), strict=True)], counts.tolist()


def count_phrases(docs: DataFrame, lengths: Sequence[int], tables: Mapping[int, tuple[int, np.ndarray, np.ndarray]],
                  settings: Settings) -> DataFrame:
    """(lang, phrase, n): occurrences of the phrases of some lengths whose parts the tables let pass."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(dict(tables))
    lengths, run_words = tuple(lengths), settings.run_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(lengths, {m: BitTable(*t) for m, t in shared.value.items()})

        def batch() -> Iterator[pa.RecordBatch]:
            for lang, phrases, counts in counter.counted():
                for a in range(0, len(phrases), 100_000):
                    part = pa.array(phrases[a:a + 100_000], pa.binary()).cast(pa.string(), safe=False)
                    langs = pa.array([lang] * len(part), pa.binary()).cast(pa.string(), safe=False)
                    yield pa.RecordBatch.from_arrays([langs, part, pa.array(counts[a:a + 100_000], pa.int64())], ["lang", "phrase", "n"])

        for arrow in batches:
            texts = arrow.column(1).cast(pa.large_binary() if pa.types.is_large_string(arrow.column(1).type) else pa.binary())
            for lang, text in zip(arrow.column(0).to_pylist(), texts, strict=True):
                counter.add(lang.encode(), text.as_py())
                if counter.size >= run_words:
                    yield from batch()
        yield from batch()

    return docs.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_table(frequent: DataFrame, settings: Settings) -> tuple[int, np.ndarray, np.ndarray]:
    """(log2 of its bits, places of its set 64-bit words, the words): sized by the number of phrases, up to a fixed bound."""
    ship_package(frequent.sparkSession)
    bits = min(max(settings.least_bits, ceil(log2(max(1, frequent.count()) * 16))), settings.most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            at = np.array([phrase_hash(a.encode(), b.encode().split(b" ")) for a, b in pairs], dtype=np.uint64) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(
                (np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["place", "value"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "place bigint, value bigint")
    found = words.groupBy("place").agg(F.bit_or("value").alias("value")).toPandas()
    return bits, found["place"].to_numpy(dtype=np.int64), found["value"].to_numpy(dtype=np.int64)


def frequent_phrases(docs: DataFrame, settings: Settings = Settings(), text: str = "text",
                     lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases with ``least`` occurrences, (lang, n) of all words)."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = materialize(count_phrases(source, (1,), {}, settings), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found, tables = [words.filter(F.col("n") >= settings.least)], {}
    done = 1
    # beyond three words the parts of three sort out enough to count all longer phrases at once
    for lengths in ((2,), (3,), range(4, settings.longest + 1)):
        lengths = [m for m in lengths if m <= settings.longest]
        if not lengths:
            break
        tables[done] = bit_table(found[-1], settings)
        counted = count_phrases(source, lengths, tables, settings).filter(F.col("n") >= settings.least)
        found.append(materialize(counted, "phrases"))
        done = lengths[-1]
    stream = found[0]
    for more in found[1:]:
        stream = stream.union(more)
    return stream, totals


def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(lang, key, n, counts of the key's first parts, largest count of an extension by one word) for every key of
    two words or more, from (part, lang, key, n, carried) in order. A carried row only opens its part's stack and
    tells what extends it there; its n is given as None."""
    stack: list[list] = []
    at: tuple | None = None

    def closed(down_to: int) -> Iterator[tuple]:
        while len(stack) > down_to:
            lang, key, n, carried, longest = stack.pop()
            if len(key) > 1:
                yield lang, key, None if carried else n, None if carried else [s[2] for s in stack], longest
    for part, lang, key, n, carried in rows:
        if (part, lang) != at:
            yield from closed(0)
            at = part, lang
        while stack and (len(stack[-1][1]) >= len(key) or key[:len(stack[-1][1])] != stack[-1][1]):
            yield from closed(len(stack) - 1)
        if stack and len(stack[-1][1]) == len(key) - 1:
            stack[-1][4] = max(stack[-1][4], n)
        stack.append([lang, key, n, carried, 0])
    yield from closed(0)


def _read_stream(stream: DataFrame, backwards: bool) -> DataFrame:
    """(lang, phrase, a, parts, extension) from the stream in prefix order, or in suffix order."""
    words = F.split("phrase", " ")
    key = F.reverse(words) if backwards else words
    laid = stream.select("lang", key.alias("key"), "n").repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    laid = materialize(laid.withColumn("part", F.spark_partition_id()), "suffix_order" if backwards else "prefix_order")
    first = laid.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("f")).select("part", "f.lang", "f.key")
    opened = first.filter(F.size("key") > 1).select("part", "lang", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("key") - 1), lambda k: F.slice("key", 1, k))).alias("key"))
    carried = opened.join(laid.select("lang", "key", "n"), ["lang", "key"]).select(
        "part", "lang", "key", "n", F.lit(True).alias("carried"))
    rows = laid.select("part", "lang", "key", "n", F.lit(False).alias("carried")).union(carried)
    rows = rows.repartition("part").sortWithinPartitions("part", "lang", "key")
    ship_package(stream.sparkSession)
    names = ["lang", "key", "a", "parts", "extension"]
    types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held = []
        for row in scan(given()):
            held.append(row)
            if len(held) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    read = rows.mapInArrow(run, "lang string, key array<string>, a bigint, parts array<bigint>, extension bigint")
    return read.withColumn("phrase", F.array_join(F.reverse("key") if backwards else F.col("key"), " ")).drop("key")


def scored(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of (lang, phrase, a, lefts, rights): the lowest cut of each phrase. Counts up
    to 10^17 are exact."""
    wide = "cast({} as decimal(19,0))"
    over = f"{wide.format('a')} * {wide.format('n')} * 1000"
    under = f"({wide.format('lefts[k - 1]')} * {wide.format('rights[size(rights) - k]')})"
    cut = f"struct(({over}) div {under} as score, k as k, lefts[k - 1] as l, rights[size(rights) - k] as r)"
    best = F.expr(f"array_min(transform(sequence(1, size(lefts)), k -> {cut}))")
    return parts.join(totals, "lang").withColumn("best", best).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    stream, totals = frequent_phrases(docs, settings, text, lang)
    nothing = F.lit(None).cast("array<bigint>")
    ahead, back = _read_stream(stream, False), _read_stream(stream, True)
    both = ahead.select("lang", "phrase", "a", F.col("parts").alias("lefts"), nothing.alias("rights"), "extension").union(
        back.select("lang", "phrase", "a", nothing, "parts", "extension"))
    read = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("lefts").alias("lefts"),
                                              F.max("rights").alias("rights"), F.max("extension").alias("extension"))
    # a last part of j words stands at j - 1 in rights; a first part of k words at k - 1 in lefts
    whole = read.filter(~((F.col("extension") >= settings.least) & (F.col("extension") * 100 >= F.col("a") * settings.percent)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(whole, totals).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
