"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Scores. Words (letter runs, lower case) and their prefixes of 3 to 8 letters form a trie. Each node's log-odds
between toxic and other texts are estimated from counts of the distinct words of each text under a two-category Dirichlet prior with the
corpus's own odds; a node stands for its lower confidence bound, and a token takes the best bound on its path,
so a rare word can rely on a well-known stem. A word repeated on the spot is one token. From every token a drift is taken, three times the mean score in
non-toxic training texts, so ordinary text has a negative expectation.

Segments. One linear scan finds all maximal-scoring segments (disjoint runs that no extension improves).

Aggregation. Segment scores of ordinary text have an exponential tail: n tokens are expected to hold
K n exp(-lambda S) segments of score S or more. lambda and K come from the segments of non-toxic training
texts above a high threshold. The r best segments of a text have the sum statistic T = sum(lambda S - ln(K n)),
whose chance is about exp(-T) T**(r-1) / (r! (r-1)!); the least likely r gives the text's evidence in nats, and a
logistic curve fitted on the training texts turns it into a probability.

Fitting reads about ``max_rows`` labelled texts at most, drawn by hash; the node counts are summed over the
cluster and only nodes found in ``min_docs`` texts or more and pointing at toxicity are kept, at most
max_rows * words / min_docs of them. Scoring covers every row and every token.

Defined cases: NULL text counts as empty; a text without tokens has no segment; without toxic training rows
the table is empty and all texts get one same score below 0.5; repeated rows are scored one by one. An empty table
gives no rows; a very long text is scanned once, in time linear in its tokens; of segments with equal scores the first
counts; the kept columns travel in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field as default
from math import lgamma

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import field, map_texts
from quantframe.session import materialize

WORD = regex.compile(r"\p{L}+")
CACHE = 200_000


@dataclass(frozen=True)
class Settings:
    max_rows: int = 16_000
    prior: float = 3.0
    min_docs: int = 5
    shortest: int = 3
    longest: int = 8
    least: float = 0.5
    bound: float = 1.64


@dataclass
class Model:
    """Scores of trie nodes (words end with a space), drift, tail lambda and log K, logistic weights of the evidence."""

    nodes: dict[str, float] = default(default_factory=dict)
    drift: float = 0.02
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (1.0, 0.0, -2.0)


def nodes_of(word: str, settings: Settings) -> list[str]:
    """Prefixes from short to long, then the word itself."""
    return [word[:n] for n in range(settings.shortest, min(len(word), settings.longest) + 1)] + [word + " "]


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) of ``scores - drift``, where most scores are zero.

    Linear-time stack algorithm over the positive tokens; what lies between two of them is a known loss.
    """
    at = np.nonzero(scores > drift)[0]
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores - drift)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    for i in at.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, end, left, right))
    return [(s, e, float(r - b)) for s, e, b, r in stack]


class Scorer:
    """Token scores of texts, with a bounded cache of words."""

    def __init__(self, nodes: dict[str, float], settings: Settings):
        self.nodes, self.settings, self.known = nodes, settings, {}

    def _word(self, word: str) -> float:
        return max((self.nodes.get(node, 0.0) for node in nodes_of(word, self.settings)), default=0.0)

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = WORD.findall(text.decode("utf-8", "replace").lower()), self.known
        for word in set(words).difference(known):
            known[word] = self._word(word)
        # a word repeated on the spot counts once
        out = np.array([known[w] for w, last in zip(words, [None, *words], strict=False) if w != last], dtype=np.float64)
        if len(known) > CACHE:
            known.clear()
        return out


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, int]:
    """Nats of the least likely sum of best segments, and how many segments it takes."""
    chance = model.log_k + np.log(max(n, 1))
    total, best, taken = 0.0, 0.0, 0
    for r, s in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
        total += model.rate * s - chance
        if total > 0:
            nats = total - (r - 1) * np.log(total) + lgamma(r + 1) + lgamma(r)
            if nats > best:
                best, taken = nats, r
    return float(best), taken


def _node_scores(counts: list[tuple[str, int, int]], settings: Settings, toxic: int, clean: int) -> dict[str, float]:
    """Lower bounds of log-odds of the nodes that point at toxicity; counts and totals are of distinct words per text."""
    root = toxic / max(toxic + clean, 1)
    scores = {}
    for node, t, c in counts:
        a, b = t + settings.prior * root, c + settings.prior * (1 - root)
        low = np.log(a / b) - np.log(root / (1 - root)) - settings.bound * np.sqrt(1 / a + 1 / b)
        if low >= settings.least:
            scores[node] = float(low)
    return scores


def _fit_tail(found: np.ndarray, tokens: int) -> tuple[float, float]:
    """lambda and ln K from the excesses of segment scores over their ninetieth percentile."""
    if len(found) < 20:
        return 1.0, 0.0
    edge = np.quantile(found, 0.9)
    over = found[found >= edge]
    rate = float(np.clip(1 / max((over - edge).mean(), 1e-6), 0.05, 5.0))
    return rate, float(np.log(len(over) / max(tokens, 1)) + rate * edge)


def _features(found: list[tuple[int, int, float]], n: int, model: Model) -> list[float]:
    """What the logistic curve sees: logs of the nats of all segments and of the best one, and one."""
    best = max((s for _, _, s in found), default=0.0)
    return [float(np.log1p(evidence(found, n, model)[0])), float(np.log1p(model.rate * best)), 1.0]


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        grad = x.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
    return tuple(map(float, w))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None,
        doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Fit on labelled rows for which ``training`` (over the labels' id) holds. Equal texts count once."""
    spark = docs.sparkSession
    marked = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    usable = marked if training is None else marked.filter(training)
    n = usable.count()
    if not n:
        return Model()
    share = min(1.0, settings.max_rows / n)
    drawn = usable.filter(F.pmod(F.xxhash64(doc_id, F.lit(23)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = docs.select(doc_id, text).join(drawn, doc_id).groupBy(F.xxhash64(text).alias("_h")).agg(
        F.first(text).alias("_t"), F.max("_label").alias("_label")).select("_label", "_t")
    sample = materialize(sample.repartition(max(8, settings.max_rows // 1000)), "sample")

    def make():
        def compute(texts: list[bytes]):
            names, counts, ends = [], [], [0]
            for t in texts:
                nodes = Counter()
                for w in set(WORD.findall(t.decode("utf-8", "replace").lower())):
                    nodes.update(nodes_of(w, settings))
                names += nodes
                counts += nodes.values()
                ends.append(len(names))
            flat = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int32())], ["node", "n"])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return compute

    found = map_texts(sample, "_t", make, [field("nodes", "array<struct<node:string,n:int>>")], keep=["_label"],
                      limit=256 << 10).select(
        "row._label", F.inline("nodes"))
    t, c = F.col("_label") * F.col("n"), (1 - F.col("_label")) * F.col("n")
    # only nodes of toxic texts can be kept; whole words carry the totals
    counted = materialize(found.groupBy("node").agg(F.sum(t).alias("t"), F.sum(c).alias("c"), F.count(F.lit(1)).alias("docs")),
                          "nodes")
    totals = counted.filter(F.col("node").endswith(" ")).agg(F.sum("t"), F.sum("c")).first()
    toxic, clean = int(totals[0] or 0), int(totals[1] or 0)
    if not toxic or not clean:
        return Model()
    counts = [(r["node"], r["t"], r["c"]) for r in counted.filter(
        (F.col("docs") >= settings.min_docs) & (F.col("t") * clean > F.col("c") * toxic)).collect()]
    model = Model(nodes=_node_scores(counts, settings, toxic, clean))
    shared = spark.sparkContext.broadcast(model.nodes)

    def average():
        scorer = Scorer(shared.value, settings)

        def compute(texts: list[bytes]):
            scores = [scorer(t) for t in texts]
            return [len(s) for s in scores], [float(s.sum()) for s in scores]

        return compute

    sums = map_texts(sample.filter("_label = 0"), "_t", average, [field("n", "int"), field("s", "double")], keep=[]).agg(
        F.sum("s"), F.sum("n")).first()
    drift = model.drift = max(0.02, 3 * (sums[0] or 0.0) / max(sums[1] or 0, 1))

    def measure():
        scorer = Scorer(shared.value, settings)

        def compute(texts: list[bytes]):
            scores = [scorer(t) for t in texts]
            return [len(s) for s in scores], [[x[2] for x in segments(s, drift)] for s in scores]

        return compute

    rows = map_texts(sample, "_t", measure, [field("n", "int"), field("found", "array<double>")], keep=["_label"]).select(
        "row._label", "n", "found").collect()
    model.rate, model.log_k = _fit_tail(np.array([s for r in rows if not r["_label"] for s in r["found"]]),
                                        sum(r["n"] for r in rows if not r["_label"]))
    x = np.array([_features([(0, 0, s) for s in r["found"]], r["n"], model) for r in rows])
    y = np.array([r["_label"] for r in rows], dtype=float)
    if 0 < y.sum() < len(y):
        model.weights = _fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
          settings: Settings = Settings()) -> DataFrame:
    """Struct ``row`` of the kept input columns, score, n_segments and the passages (start, end, nats) in tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        scorer = Scorer(m.nodes, settings)

        def compute(texts: list[bytes]):
            out = [], [], []
            for t in texts:
                scores = scorer(t)
                found = segments(scores, m.drift)
                n = evidence(found, len(scores), m)[1]
                chance = m.log_k + np.log(max(len(scores), 1))
                out[0].append(float(_logistic(np.dot(m.weights, _features(found, len(scores), m)))))
                out[1].append(n)
                out[2].append([{"start": a, "end": b, "nats": m.rate * s - chance}
                               for a, b, s in found if m.rate * s > chance])
            return out

        return compute

    return map_texts(docs, text, make, [
        field("score", "double"), field("n_segments", "int"),
        field("passages", "array<struct<start:int,end:int,nats:double>>")], keep=keep)
