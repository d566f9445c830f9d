"""Near-duplicate classes by an inverted join over MinHash signature coordinates.

Sets. The distinct word shingles of a text, as 64-bit hashes. Texts of equal sets form a class; only its document
of least id goes on, so exact copies cost nothing.

Postings. A signature has ``coordinates`` minima. A document is posted under its (coordinate, value) pairs. Two
documents of the similarity asked for agree in at least ``matches`` coordinates, but for a chance of a few in
100,000 (four standard deviations). Sorted by how many documents hold a pair, the rarest first, two such
documents share one of their first ``coordinates - matches + 1`` pairs: only this prefix is posted. A passage
that very many documents share thus leaves the prefixes, however many there are; pairs of one holder are skipped.

Pairs. The documents of a posting are compared with its pivot, the text most typical of them. Pairs with enough equal
coordinates are confirmed on the full sets, of each document the best pair first: its links put most other pairs
inside one class, where they need not be tried.

Rest. Where a posting of up to ``few`` documents still holds several classes, its pairs between classes are tried. The
documents of a longer one are posted anew under what tells them from the
pivot. Two linked documents must have about half of these differences in common (``_differences`` has the exact
bounds). Near copies that happen to have changed the same words still meet there, more of them the larger the group;
parity sketches of their sets, which bound from below how far two sets are apart, tell nearly all of these apart inside
the join, so that few pairs besides the links leave it. So every link between different classes is tried, and none
inside a class need be.

Texts are keyed by id and a 128-bit hash: rows of one id with different texts are different documents.

Defined cases: a text without words has an empty set, is linked with nothing and kept; with fewer words than a
shingle the whole sequence is one; a very long text is one set in one task; rows with a NULL id are kept and have no
component; equal rows get equal answers, and dropping duplicates keeps one of them; of rows of one id whose texts
are in one component one stays, of those in different components each; an empty table gives no rows; of the input's
columns only id and text are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import field, map_texts
from quantframe.llm.components import connected_components
from quantframe.session import materialize, scratch_scope, ship_package

CACHE = 400_000
MIX = np.uint64(0xFF51AFD7ED558CCD)
AROUND, BESIDE, AWAY = range(3)
#: Distance from a pivot up to which the differences from it are compared; more than twice the gap of any setting.
NEAR = 0.5
KEY = ["doc", "t1", "t2"]
#: Size of the table that sorts out most rows before a join by key: a megabyte of bits.
SIFT_BITS = 23
#: Bits of a parity sketch.
SKETCH_BITS = 1024


@dataclass(frozen=True)
class Settings:
    """Shingles of ``width`` words; documents are linked from ``percent`` of Jaccard similarity on."""

    width: int = 5
    percent: int = 80
    coordinates: int = 48
    few: int = 5
    seed: int = 11

    @property
    def matches(self) -> int:
        p, k = self.percent / 100, self.coordinates
        return max(1, int(k * p - 4 * sqrt(k * p * (1 - p))))


class Shingler:
    """Sorted distinct shingle hashes of texts. Word hashes are kept in a bounded cache."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = text.lower().split(), self.known
        if not words:
            return np.zeros(0, dtype=np.uint64)
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.array([known[w] for w in words], dtype=np.uint64)
        if len(known) > CACHE:
            known.clear()
        width = min(self.width, len(words))
        mixed = np.full(len(words) - width + 1, width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for i in range(width):
            mixed = (mixed ^ hashes[i:len(words) - width + 1 + i]) * MIX
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least upper halves of the shingles times each factor, as int32."""
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = (shingles[i:i + 2048, None] * factors) >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint32).view(np.int32)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit, as int64 words. The sketches of two sets differ in one bit
    for each shingle that one of them has alone, at most."""
    place = ((shingles.view(np.uint64) * MIX) >> np.uint64(32)) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array without a Python object per element."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def text_key(doc_id: Column, text: Column) -> list[Column]:
    """Id and two 64-bit hashes of the text."""
    return [doc_id.cast("bigint").alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc, t1, t2, n_shingles, h1, h2, sig): size, 128-bit hash and signature of the set of each row's text."""
    factors = (np.random.default_rng(settings.seed).integers(0, 1 << 63, settings.coordinates, dtype=np.uint64)
               << np.uint64(1)) | np.uint64(1)

    def make():
        shingler = Shingler(settings.width)

        def compute(texts: list[bytes]):
            sets = [shingler(t) for t in texts]
            sums = [[int(x.view(np.int64).sum()), int(((x * MIX) ^ (x >> np.uint64(17))).view(np.int64).sum())]
                    for x in sets]
            return ([len(x) for x in sets], [s[0] for s in sums], [s[1] for s in sums],
                    _arrays([signature(x, factors) for x in sets], pa.int32()))

        return compute

    fields = [field("n_shingles", "bigint"), field("h1", "bigint"), field("h2", "bigint"), field("sig", "array<int>")]
    return map_texts(docs, "text", make, fields, keep=KEY, limit=1 << 20).select("row.*", *(f.name for f in fields))


def shingle_sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """(id, set): the full sets of (id, text) rows."""
    def make():
        shingler = Shingler(settings.width)

        def compute(texts: list[bytes]) -> Iterator[pa.Array]:
            return [_arrays([shingler(t).view(np.int64) for t in texts], pa.int64())]

        return compute

    return map_texts(texts, "text", make, [field("set", "array<bigint>")], keep=["id"], limit=1 << 20).select("row.id", "set")


def _prefix(postings: DataFrame, group: Sequence[str] = (), pivots: bool = True) -> DataFrame:
    """(group, token, id, linked, size, pivot_of) of (group, token, id, need, linked): each document's rarest tokens, as
    many as it takes for documents with ``need`` tokens in common to meet in one. ``pivot_of`` only with ``pivots``.

    Tokens of one holder come first in the order and never meet another document, so they only shorten the prefix. A
    token's pivot is the heaviest of all its holders, posted under it or not, where the weight sums the holders of all
    tokens: in a group of near copies that is the text they stem from, for nearly every token they share.
    """
    group = list(group)
    shared = postings.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    held = postings.join(materialize(shared, "holders"), [*group, "token"]).groupBy(*group, "id", "need", "linked").agg(
        F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("tokens"))
    weight = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda total, t: total + t["holders"])
    held = materialize(held.filter(F.size("tokens") >= F.col("need")).withColumn("weight", weight), "held")
    first = F.slice("tokens", 1, (F.size("tokens") - F.col("need") + 1).cast("int"))
    met = materialize(held.select(*group, "id", "linked", F.explode(F.transform(first, lambda t: t["token"])).alias("token")), "postings")
    # of postings with the same members one is enough
    by = met.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                          F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("n > 1")
    one = by.groupBy(*group, "n", "x", "y").agg(F.min("token").alias("token")).select(*group, "token", F.col("n").alias("size"))
    one = materialize(one, "different")
    if not pivots:
        return materialize(met.join(one, [*group, "token"]), "met")
    heaviest = held.select(*group, "id", "weight", F.explode(F.transform("tokens", lambda t: t["token"])).alias("token")).join(
        one.select(*group, "token"), [*group, "token"], "left_semi").groupBy(*group, "token").agg(
            F.min(F.struct(-F.col("weight"), F.col("id"))).alias("p"))
    one = materialize(one.join(heaviest, [*group, "token"]).select(*group, "token", "size", F.col("p.id").alias("pivot_of")), "pivots")
    return materialize(met.join(one, [*group, "token"]), "met")


def _members(met: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Postings with the class that each document has by now, where more than one class is left."""
    members = materialize(met.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component"), "members")
    mixed = members.groupBy(*by).agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    return members.join(materialize(mixed.select(*by), "mixed"), by)


def _with_pivots(members: DataFrame) -> DataFrame:
    """Members of each posting beside its pivot."""
    return members.withColumn("pivot", F.col("pivot_of")).filter("id <> pivot")


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _sketched(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with the size ``n`` and the parity sketch of their sets."""
    ship_package(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(1)[i].values.to_numpy() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(v) for v in values], pa.int64()),
                _arrays([parity_sketch(v) for v in values], pa.int64())], ["id", "n", "sketch"])

    wanted = sets.join(materialize(members.select("id").distinct(), "ids"), "id").select("id", "set")
    sketches = materialize(wanted.mapInArrow(run, "id bigint, n bigint, sketch array<bigint>"), "sketches")
    return materialize(members.join(sketches, "id"), "sketched")


def _near_enough(settings: Settings) -> str:
    """SQL condition that linked sets of ``n`` and ``n_b`` shingles meet. They are apart by at most gap |x | y|, which is
    gap (|x| + |y|) / (2 - gap), with gap = 1 - percent / 100; their sketches differ in no more bits."""
    apart = " + ".join(f"bit_count(sketch[{i}] ^ sketch_b[{i}])" for i in range(SKETCH_BITS // 64))
    return f"({apart}) * (100 + {settings.percent}) <= (n + n_b) * (100 - {settings.percent})"


def _meeting(members: DataFrame, by: list[str], allowed: str = "true") -> DataFrame:
    """Pairs of members of one posting in different classes; ``allowed`` may name the other member's columns by _b."""
    others = members.select(*by, *(F.col(c).alias(f"{c}_b") for c in members.columns if c not in by))
    met = members.join(others, by).filter((F.col("id") < F.col("id_b")) & (F.col("class") != F.col("class_b")) & F.expr(allowed))
    return _pairs(met, "id", "id_b")


def _collided(pairs: DataFrame, signed: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, hits): pairs whose sizes allow the similarity, with enough equal coordinates."""
    a = signed.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = signed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sizes = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * settings.percent)
    hits = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    met = pairs.join(a, "a").join(b, "b").filter(sizes).select("a", "b", hits.alias("hits"))
    return materialize(met.filter(F.col("hits") >= settings.matches), "collided")


def _ends(pairs: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    ids = pairs.select(F.col(one).alias("id")).union(pairs.select(F.col(other).alias("id"))).distinct()
    return materialize(ids, "ids")


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    joined = materialize(pairs.select("a", "b"), "pairs").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    measured = joined.select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return measured.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * settings.percent).select("a", "b")


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose documents are in different classes."""
    a = classes.select(F.col("id").alias("a"), F.col("component").alias("class_a"))
    b = classes.select(F.col("id").alias("b"), F.col("component").alias("class_b"))
    met = pairs.join(a, "a", "left").join(b, "b", "left")
    return met.filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select(*pairs.columns)


def _join_classes(pairs: DataFrame, sets: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Classes after trying the pairs (a, b, hits): of each document first its best pair, then all pairs that are still
    between classes."""
    for best in (True, False):
        # pairs come between classes, so they only have to be looked through again once some are joined
        left = pairs if best else _between(pairs, classes)
        if best:
            ends = left.select(F.explode(F.array("a", "b")).alias("id"), F.struct("hits", "a", "b").alias("pair"))
            left = ends.groupBy("id").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()
        links = materialize(_confirmed(left, sets, settings), "links")
        if not links.isEmpty():
            known = classes.select(F.col("id").alias("a"), F.col("component").alias("b"))
            classes = connected_components(links.union(known))
    return classes


def differences(own: np.ndarray, pivot: np.ndarray, percent: int) -> Iterator[tuple[int, bool, np.ndarray, int]]:
    """(kind, linked, tokens, need) of a set against its pivot's: see ``_differences``."""
    gap, n, m = 1 - percent / 100, len(own), len(pivot)
    apart = np.setxor1d(own, pivot, assume_unique=True)
    common = (n + m - len(apart)) // 2
    distance = len(apart) / max(1, n + m - common)
    half = max(1, ceil((1 - gap) * len(apart) / 2 - 1e-6))
    if common * 100 >= (n + m - common) * percent:
        yield BESIDE, True, apart, half
        return
    if distance <= NEAR:
        left = max(1, ceil(len(apart) - gap * (n + n / (1 - gap)) / (2 - gap) - 1e-6))
        yield AROUND, False, apart, max(half, left)
        if distance <= 2 * gap:
            yield BESIDE, False, apart, left
    if distance > NEAR - gap:
        yield AWAY, False, own, max(1, ceil((1 - gap) * n - 1e-6))


def _differences(rest: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(pivot, kind, token, id, need, linked) of (pivot, id) rows: what tells a document from its pivot, as postings.

    With gap = 1 - similarity, let x and y be linked, D the shingles that a document or the pivot has alone. If x is not
    linked with the pivot p, |x ^ y| <= gap |x | y| <= gap (|x | p| + |Dy|) < |Dx| + gap |Dy|, so that x and y have more
    than (1 - gap) / 2 of Dy in common. In any case they have |Dx| - |x ^ y| of Dx in common, and |x ^ y| is at most
    gap (|x| + |y|) / (2 - gap), where |y| is at most |x| / (1 - gap).

    AROUND  neither is linked with the pivot, both are near it: the larger of both bounds.
    BESIDE  x is not, y is linked with it: the first bound for y, the second for x; only such pairs are formed.
    AWAY    both are far from it: the share of their own shingles that linked sets have in common.

    Near and far overlap by the gap, so that two linked documents are both near or both far.
    """
    both = rest.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")
    percent = settings.percent
    ship_package(rest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pivot, one = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own, other = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
                for kind, linked, tokens, need in differences(own, other, percent):
                    for a in range(0, len(tokens), 100_000):
                        n = len(tokens[a:a + 100_000])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, pivot)), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(tokens[a:a + n]),
                            pa.array(np.full(n, one)), pa.array(np.full(n, need)), pa.array([linked] * n, pa.bool_())],
                            ["pivot", "kind", "token", "id", "need", "linked"])

    rows = both.select("pivot", "id", "set", "pivot_set").mapInArrow(
        run, "pivot bigint, kind int, token bigint, id bigint, need bigint, linked boolean")
    return materialize(rows, "differences")


def _link_classes(reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], settings: Settings) -> DataFrame:
    """(id, component) for representatives (id, n, sig) that are not the least of their component. ``sets_of`` gives
    the full sets of a table of ids."""
    classes = reps.sparkSession.createDataFrame([], "id bigint, component bigint")
    token = (F.col("pos").cast("bigint") * (1 << 32)) + (F.col("value").cast("bigint") + (1 << 31))
    met = _prefix(reps.select("id", F.posexplode("sig").alias("pos", "value")).select(
        "id", token.alias("token"), F.lit(settings.matches).cast("bigint").alias("need"), F.lit(False).alias("linked")))
    pairs = _collided(_pairs(_with_pivots(met), "id", "pivot"), reps, settings)
    classes = _join_classes(pairs, sets_of(_ends(pairs)), classes, settings)
    members = materialize(_members(met, classes, ["token"]), "open")
    pairs = _collided(_meeting(members.filter(F.col("size") <= settings.few), ["token"]), reps, settings)
    long_ = members.filter(F.col("size") > settings.few)
    rest = materialize(_with_pivots(long_).select("pivot", "id").distinct(), "rest")
    sets = sets_of(materialize(_ends(pairs).union(_ends(rest, "pivot", "id")).distinct(), "ids"))
    classes = _join_classes(pairs, sets, classes, settings)
    if rest.isEmpty():
        return classes
    apart = _prefix(_differences(rest, sets, settings), ["pivot", "kind"], pivots=False)
    members = _sketched(_members(apart, classes, ["pivot", "kind", "token"]), sets)
    tried = _meeting(members, ["pivot", "kind", "token"], f"(kind <> {BESIDE} OR linked <> linked_b) AND {_near_enough(settings)}")
    return _join_classes(_collided(tried, reps, settings), sets, classes, settings)


def _sifted(rows: DataFrame, keys: DataFrame, hit: str = "_hit") -> DataFrame:
    """``rows`` with a flag: false only where the row's key is not in ``keys``. The keys' hashes are put in a bit table
    of fixed size that every task gets; where it fills up, more flags are true."""
    place = F.shiftrightunsigned(F.xxhash64(*KEY), 64 - SIFT_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    words = keys.select((place / 64).cast("bigint").alias("_place"), bit.alias("_bit")).groupBy("_place").agg(
        F.bit_or("_bit").alias("_word"))
    met = rows.withColumn("_place", (place / 64).cast("bigint")).join(F.broadcast(materialize(words, "bits")), "_place", "left")
    return met.withColumn(hit, F.coalesce(F.col("_word").bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_word")


def _judged(docs: DataFrame, doc_id: str, text: str, settings: Settings) -> DataFrame:
    """(doc, t1, t2, n_shingles, h1, h2, class, component) of each row: the component's own name and the least id that links
    reach, NULL for an empty set or a NULL id. A table; the steps' own tables are removed."""
    column = F.col(f"`{text}`").cast("string")
    narrow = docs.select(*text_key(F.col(f"`{doc_id}`"), column), column.alias("text"))
    with scratch_scope(docs.sparkSession) as scope:
        base = materialize(signatures(narrow, settings), "signatures")
        equal = ["h1", "h2", "n_shingles"]
        usable = base.filter(F.col("doc").isNotNull() & (F.col("n_shingles") > 0))
        # of rows with equal sets one stands for all; its id names it, unless that id has several sets
        heads = materialize(usable.groupBy(*equal).agg(F.min(F.struct(*KEY)).alias("key")).select(*equal, "key.*"), "heads")
        first = materialize(heads.groupBy("doc").agg(F.min(F.struct(*equal)).alias("first"), F.count(F.lit(1)).alias("n")).filter(
            "n > 1").select("doc", F.col("first").alias("named")), "several")
        named = heads.join(first, "doc", "left")
        vertex = F.when(F.coalesce(F.col("named") == F.struct(*equal), F.lit(True)), F.col("doc")).otherwise(F.xxhash64(*equal))
        heads = materialize(named.select(*equal, *KEY, vertex.alias("id")), "named")
        signed = base.join(heads, [*KEY, *equal]).select("id", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["id"])
        signed = materialize(signed, "signed")
        keys = heads.select("id", *KEY)

        def sets_of(ids: DataFrame) -> DataFrame:
            wanted = materialize(keys.join(ids, "id"), "chosen")
            chosen = _sifted(narrow, wanted).filter("_hit").join(wanted, KEY).select("id", "text").dropDuplicates(["id"])
            return materialize(shingle_sets(chosen, settings), "sets")

        classes = heads.select(*equal, "id", "doc").join(_link_classes(signed, sets_of, settings), "id", "left").withColumn(
            "class", F.coalesce("component", "id"))
        classes = materialize(classes.select(*equal, "doc", "class"), "classes")
        least = materialize(classes.groupBy("class").agg(F.min("doc").alias("component")), "least")
        of_set = materialize(classes.join(least, "class").select(*equal, "class", "component"), "components")
        joined = base.drop("sig").join(of_set, equal, "left")
        linked = F.col("doc").isNotNull() & (F.col("n_shingles") > 0)
        return scope.keep(joined.select(*KEY, *equal, *(F.when(linked, F.col(c)).alias(c) for c in ("class", "component"))), "judged")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row. ``component_id`` is the least id that links reach."""
    component = F.coalesce("component", "doc")
    return _judged(docs, doc_id, text, settings).select(
        F.col("doc").alias(doc_id), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         settings: Settings = Settings()) -> DataFrame:
    """The input's rows with one document of each component, and one of equal rows. Rows with a NULL id all stay."""
    judged = _judged(docs, doc_id, text, settings).filter(F.col("doc").isNotNull())
    lone = judged.filter("class IS NULL").select(*KEY)
    first = judged.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(*KEY)).alias("key")).select("key.*")
    rows = judged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    stay = lone.union(first).distinct().withColumn("stays", F.lit(True))
    # only rows that go or repeat need to be looked up
    looked = rows.join(stay, KEY, "left").filter("n > 1 OR stays IS NULL")
    looked = materialize(looked.select(*KEY, F.lit(True).alias("_found"), F.coalesce("stays", F.lit(False)).alias("_stays")), "looked_up")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"),
                        *text_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")))
    flagged = _sifted(keyed, looked)
    met = flagged.filter("_hit").join(looked, KEY, "left")
    return flagged.filter("NOT _hit").select(*columns).union(met.filter("_found IS NULL").select(*columns)).union(
        met.filter("_stays").dropDuplicates(KEY).select(*columns))
