"""Benchmark decontamination by spaced seeds and substitution-tolerant overlaps.

Seeds. Four fixed masks of six words each inside windows of eight to ten ignore the words between. Any overlap
of 13 words with up to two substituted words matches at least one mask somewhere; so does nearly every overlap
of 16 words with three. Items of six words, shorter than any window, have one seed of all their words; documents
take it only if there is such an item. Words are letter and digit runs in lower case, without ASCII punctuation.

Hits. The benchmark's seed hashes fill a bit table sized by their number, up to a fixed bound; documents look
their seeds up there and only seeds found go on to an equi-join with the benchmark's seeds on the hash. Beyond
the bound the table lets more seeds pass and the join does the work, with the same result.

Overlaps. Each hit says which benchmark word lies on which document word (a diagonal). On every diagonal with a
hit the best run of equal words is taken, a substituted word costing as much as two equal ones earn. A document is
contaminated by an item if the run has ``min_words`` equal words, or ``item_share`` of a shorter item. Substitutions
near an edge cut a run short, so where it is too short the longest window counts of whose words ``item_share`` are
equal; the whole item is such a window if that share of it is in the document.

Texts are keyed by a 128-bit hash, so copies are judged once and documents need no id.

Defined cases: NULL or empty texts are clean; benchmark items of NULL text or fewer than six words (the weight
of a seed) match nothing; repeated items are reported by each id; repeated documents are judged alike. An empty table
of documents gives no rows, one of items leaves all clean; a very long text is read whole in one task; the documents'
columns travel in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import field, map_texts
from quantframe.session import materialize, ship_package

#: Word positions that a seed looks at; found by search for the guarantee above.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 3, 4, 7, 8, 9), (0, 2, 4, 5, 6, 7), (0, 1, 3, 4, 5, 6))
#: For items of its length only.
SHORT = (0, 1, 2, 3, 4, 5)
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE = 400_000
MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Settings:
    min_words: int = 12
    item_share: float = 0.8
    substitution: float = 2.0
    least_bits: int = 16
    most_bits: int = 27


class Words:
    """Word hashes of texts, with a bounded cache."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        if not text.isascii():
            text = text.decode("utf-8", "replace").lower().encode()
        words, known = text.lower().translate(None, PUNCTUATION).split(), self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        out = np.array([known[w] for w in words], dtype=np.uint64)
        if len(known) > CACHE:
            known.clear()
        return out


def seeds(words: np.ndarray, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every mask at every place; of the short mask too if asked."""
    hashes, places = [], []
    for number, mask in enumerate((*MASKS, SHORT) if short else MASKS, 1):
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        mixed = np.full(n, number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for at in mask:
            mixed = (mixed ^ words[at:at + n]) * MIX
            mixed ^= mixed >> np.uint64(31)
        hashes.append(mixed)
        places.append(np.arange(n, dtype=np.int32))
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    return np.concatenate(hashes), np.concatenate(places)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), kind))


def _seed_rows(df: DataFrame, text: str, keep: list[str], table: np.ndarray | None = None, short: bool = False) -> DataFrame:
    """Kept columns, hash and place of the seeds of each text; of those in the bit ``table`` if one is given.
    Short seeds are those of items, without a table, or ``short`` asks for them."""
    shared = None if table is None else df.sparkSession.sparkContext.broadcast(table)

    def make():
        words = Words()
        bits = None if shared is None else shared.value

        def compute(texts: list[bytes]) -> Iterator[pa.Array]:
            found = [seeds(w, short if bits is not None else len(w) == len(SHORT)) for w in map(words, texts)]
            if bits is not None:
                found = [(h[ok], p[ok]) for h, p in found for ok in [_held(bits, h)]]
            return [_lists([h.view(np.int64) for h, _ in found], pa.int64()), _lists([p for _, p in found], pa.int32())]

        return compute

    rows = map_texts(df, text, make, [field("hash", "array<bigint>"), field("place", "array<int>")], keep=keep, limit=1 << 20)
    return rows.filter(F.size("hash") > 0).select(*(f"row.{c}" for c in keep), F.inline(F.arrays_zip("hash", "place")))


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in the table: both of its bits are set."""
    mask = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(hashes), dtype=bool)
    for part in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        out &= (bits[part >> np.uint64(6)] >> (part & np.uint64(63))) & np.uint64(1) == 1
    return out


def bit_table(seeds_: DataFrame, settings: Settings) -> np.ndarray:
    """The table as uint64 words; at most 2**most_bits bits (16 MB), whatever the benchmark's size."""
    n = max(seeds_.count(), 1)
    size = min(max(ceil(log2(n * 16)), settings.least_bits), settings.most_bits)
    mask = (1 << size) - 1
    place = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask)))
    words = seeds_.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    found = words.toPandas()
    table = np.zeros(1 << (size - 6), dtype=np.uint64)
    table[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int, settings: Settings) -> int:
    """Equal words in the best run of one diagonal (document place minus item place)."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b <= a:
        return 0
    equal = item[a:b] == doc[a + diagonal:b + diagonal]
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -settings.substitution))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[:end + 1] == low[end]))
    return int(equal[start:end].sum())


def best_window(doc: np.ndarray, item: np.ndarray, diagonal: int, settings: Settings) -> int:
    """Most equal words in a window of one diagonal of whose words at least ``item_share`` are equal."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b <= a:
        return 0
    equal = item[a:b] == doc[a + diagonal:b + diagonal]
    share = round(settings.item_share * 1000)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - share, -share))])
    # the first start from which the window to each end has the share
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    upto = np.concatenate([[0], np.cumsum(equal)])
    return int((upto - upto[start]).max())


def overlap(doc: np.ndarray, item: np.ndarray, diagonals: Iterable[int], settings: Settings) -> int:
    """Equal words of the longest run that suffices, or else of such a window; 0 if none does."""
    least = min(settings.min_words, ceil(settings.item_share * len(item)))
    for best in (best_run, best_window):
        n = max((best(doc, item, d, settings) for d in diagonals), default=0)
        if n >= least:
            return n
    return 0


def _any_short(items: DataFrame) -> bool:
    def make():
        words = Words()
        return lambda texts: [[len(words(t)) for t in texts]]

    lengths = map_texts(items, "item_text", make, [field("n", "int")], keep=[])
    return not lengths.filter(F.col("n") == len(SHORT)).isEmpty()


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str,
                       settings: Settings) -> DataFrame:
    """(k1, k2, items, overlap_words): keys of the contaminated texts, item ids and the longest overlap."""
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.filter(F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("item_text"))
    probes = materialize(_seed_rows(items, "item_text", ["item"]), "seeds").withColumnRenamed("place", "item_place")
    keyed = docs.select(F.col(text).cast("string").alias("text")).filter("text is not null").select(
        F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), "text")
    hits = materialize(_seed_rows(keyed, "text", ["k1", "k2"], bit_table(probes, settings), _any_short(items)).distinct(), "hits")
    met = hits.join(probes, "hash").groupBy("k1", "k2", "item").agg(
        F.collect_set(F.col("place") - F.col("item_place")).alias("diagonals"))
    met = materialize(met, "met")
    found = keyed.join(met.select("k1", "k2").distinct(), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    tasks = met.join(found, ["k1", "k2"]).join(items, "item").select("k1", "k2", "item", "diagonals", "text", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for r in rows:
                doc, item = words(r["text"].encode()), words(r["item_text"].encode())
                found.append(overlap(doc, item, r["diagonals"], settings))
            yield pa.RecordBatch.from_pydict({
                "k1": batch["k1"], "k2": batch["k2"], "item": batch["item"], "overlap": pa.array(found, pa.int32())})

    checked = tasks.mapInArrow(verify, "k1 bigint, k2 bigint, item bigint, overlap int").filter("overlap > 0")
    return checked.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"),
                                           F.max("overlap").alias("overlap_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: struct ``row`` of the input, items (ids, empty if clean) and overlap_words."""
    found = materialize(contaminated_texts(docs, benchmark, text, item_id, item_text, settings), "contaminated")
    key = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.xxhash64(key).alias("k1"), F.xxhash64(key, F.lit(1)).alias("k2"))
    joined = rows.join(found, ["k1", "k2"], "left")
    return joined.select("row", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                         F.coalesce("overlap_words", F.lit(0)).alias("overlap_words"))
