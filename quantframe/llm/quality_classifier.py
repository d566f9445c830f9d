"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text becomes tokens (letter runs in lower case, digit runs as one class, punctuation runs), each letter run
also gives its letter case, and a token equal to the one before gives a repeat mark. Hashed unigrams, bigrams
and bigrams of the case and repeat marks form a sparse vector of log counts with unit length; the score is the
logistic function of its dot product with the weights.

Training reads at most about ``max_rows`` labelled texts, chosen by a hash of id and text, whatever the size
of the table; everything else covers all rows. ``shards`` models are trained side by side on fixed, hashed
parts of the sample and their weights averaged, so no task or driver holds more than max_rows / shards
vectors or shards * 2**bits weights.

Defined cases: NULL text counts as empty; an empty text gets the score of the bias alone; rows without a label
or with a NULL label do not train; without any training rows all weights are zero and every score is 0.5. An empty
table gives no rows; a very long text is one sparse vector in one task; rows of one id are drawn together; of the
input only the kept columns travel, in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import field, map_texts

TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
CACHE = 200_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_rows: int = 12_000
    shards: int = 4
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


class Hasher:
    """Sparse vectors of texts. Token hashes are kept in a bounded cache."""

    def __init__(self, bits: int):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _token(self, token: str) -> tuple[int, int]:
        head = token[0]
        if head.isalpha():
            kind = 1 if token.islower() else 2 if len(token) > 1 and token.isupper() else 3
        else:
            kind = 4 if head.isnumeric() else 5 + min(len(token), 3)
        name = "0" if kind == 4 else token.lower()
        return xxhash.xxh3_64_intdigest(name) >> 1, kind

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        tokens = TOKEN.findall(text.decode("utf-8", "replace"))
        for token in set(tokens).difference(known):
            known[token] = self._token(token)
        if not tokens:
            return np.zeros(1, np.int64), np.ones(1, np.float32)
        pairs = np.array([known[t] for t in tokens], dtype=np.uint64)
        if len(known) > CACHE:
            known.clear()
        word, kind = pairs[:, 0], pairs[:, 1]
        mark = kind.copy()
        mark[1:] += (word[1:] == word[:-1]) * np.uint64(16)
        mixed = [word * np.uint64(0x9E3779B97F4A7C15),
                 (word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (word[1:] * np.uint64(0x165667B19E3779F9)),
                 (mark[:-1] * np.uint64(31) + mark[1:] + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93),
                 (mark + np.uint64(99)) * np.uint64(0xD6E8FEB86659FD93)]
        slots = (np.concatenate(mixed) * np.uint64(0xFF51AFD7ED558CCD)) >> self.shift
        index, count = np.unique(slots.astype(np.int64), return_counts=True)
        value = np.log1p(count)
        value /= np.sqrt((value * value).sum())
        # slot 0 is the bias; a token that hashes there adds to it
        return np.append(0, index), np.append(1.0, value).astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings, passes: int) -> np.ndarray:
    """Weights after ``passes`` over (index, value, label) rows, one update a row."""
    z = np.zeros(1 << settings.bits)
    n = np.zeros(1 << settings.bits)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2)
        return np.where(np.abs(zi) <= settings.l1, 0.0, w)

    for _ in range(passes):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha
            z[index] = zi + g - sigma * w
            n[index] = ni + g * g
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", training: Column | None = None,
        doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> np.ndarray:
    """Averaged weights from the labelled rows for which ``training`` (over the documents) holds."""
    spark = docs.sparkSession
    marked = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    usable = marked if training is None else marked.filter(training)
    n = usable.count()
    if not n:
        return np.zeros(1 << settings.bits)
    # rows are drawn by a hash, so the sample does not depend on partitions
    share = min(1.0, settings.max_rows / n)
    drawn = usable.filter(F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = docs.select(doc_id, text).join(drawn, doc_id).select(
        "_label", F.col(text), F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(settings.shards)).alias("shard"),
        F.xxhash64(text, doc_id).alias("at"))

    def make():
        hasher = Hasher(settings.bits)

        def compute(texts: list[bytes]):
            index, value = zip(*map(hasher, texts), strict=True)
            return [x.astype(np.int32).tobytes() for x in index], [x.tobytes() for x in value]

        return compute

    vectors = map_texts(sample, text, make, [field("index", "binary"), field("value", "binary")],
                        keep=["_label", "shard", "at"]).select("row.*", "index", "value")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(
            table["index"].to_pylist(), table["value"].to_pylist(), table["_label"].to_pylist(), strict=True)]
        weights = train_ftrl(rows, settings, settings.epochs)
        return pa.table({"weights": [weights.astype(np.float32).tobytes()]})

    models = vectors.groupBy("shard").applyInArrow(train, "weights binary").collect()
    return np.mean([np.frombuffer(m["weights"], np.float32) for m in models], axis=0).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None,
          settings: Settings = Settings()) -> DataFrame:
    """Struct ``row`` of the kept input columns, and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hasher, w = Hasher(settings.bits), shared.value

        def one(text: bytes) -> float:
            index, value = hasher(text)
            return float(1 / (1 + np.exp(-np.clip(w[index] @ value, -35, 35))))

        def compute(texts: list[bytes]) -> Iterator[list[float]]:
            return [[one(t) for t in texts]]

        return compute

    return map_texts(docs, text, make, [field("score", "double")], keep=keep)
