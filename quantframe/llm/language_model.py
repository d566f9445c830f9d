"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Model. Every word with ``least`` occurrences, and in small corpora the ``words`` most frequent ones, the end of a
text and one class of all other words are predicted from the two tokens before: context vectors of both places
are weighted and added, and products with output vectors give scores. The vocabulary follows the corpus. The
softmax is factored: outputs are cut by frequency into classes of about equal sums of square roots of their
shares, and a token's probability is that of its class times its own inside the class. A word of the other
class has, inside that class, the probability of its smoothed count, so a text's probability adds up to one over
all texts.

Training. Word counts and the counts of (before, before, token) come from all training texts, summed over the
cluster. The second table is split over groups of about ``shard_tokens`` tokens, at least ``shards``; a context met
very often is dealt to several. In every round numpy goes over each token of each group once, in random order (in
small groups as often as makes ``draws`` tokens), up to ``TOGETHER`` equal ones after equal contexts at a time as one row
of that weight, with noise words and noise classes from their unigrams, and takes
AdaGrad steps on the rows it meets. After every round each row's change is averaged over the shards that met it, weighted by how often they
did; a task averages over its shards, the cluster over the tasks block by block, and the driver adds one change per row.

Scoring. Texts are scored in Arrow batches: the distinct contexts of a batch meet all classes, and its distinct
contexts and tokens the outputs of their class, in matrix products. As a score is a sum over both places, contexts of
two words that others share multiply the exponentials of their parts. Counts of the ``local_words`` most frequent
words, at least those of the vocabulary, are broadcast; those of other words meet the texts in a join on the
word's hash, summed per text.

Defined cases: NULL text is empty and is one end token; without training texts every count is zero; repeated
rows are scored alike; an empty table gives no rows; a very long text is one batch in one task; words of equal count
are ranked by their bytes; the kept columns travel in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm.common import field, map_texts, pieces
from quantframe.session import Scope, materialize, scratch_path, scratch_scope, ship_package


#: Keys scored at a time, contexts that meet the classes at a time, and scores inside a class at a time.
PIECE, ROWS, CELLS = 1 << 17, 1 << 10, 1 << 18
#: Cells of a table of shared exponentials, and scores whose exponentials add up in 32 bits.
TABLE, SAFE = 1 << 21, 60
#: Rows of a parameter averaged at a time, and the largest vocabulary whose keys fit 63 bits.
BLOCK, MOST_OUTPUTS = 1 << 13, (1 << 21) - 1
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Odd factor that spreads keys, and the most shards that one task trains in a round when there are cores for more.
MIX, TASK_SHARDS = np.uint64(0x9E3779B97F4A7C15), 8
#: Occurrences of one context and token that stay in one shard, and those of them that one row of a batch stands for.
PART, TOGETHER = 4096, 4


@dataclass(frozen=True)
class Settings:
    words: int = 254
    least: int = 20
    local_words: int = 150_000
    size: int = 24
    noise: int = 48
    shards: int = 6
    rounds: int = 3
    draws: int = 300_000
    shard_tokens: int = 4_000_000
    batch: int = 512
    rate: float = 0.05

    @property
    def outputs(self) -> int:
        """End of text (0), ``words`` words, and the class of other words: the smallest model of a corpus."""
        return self.words + 2


@dataclass(frozen=True)
class Model:
    """Words of the vocabulary by id (from 1), local counts, corpus totals and the parameters."""

    words: tuple[bytes, ...]
    local: dict[bytes, int]
    tokens: int
    types: int
    texts: int
    other_tokens: int
    other_types: int
    params: dict[str, np.ndarray]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all texts one after the other, and how many each text has; NULL has none."""
    if pa.types.is_binary(texts.type):
        texts = texts.view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # blanks at either end leave empty words
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    return words.filter(full).cast(pa.binary()), upto[ends] - upto[ends - sizes]


def word_places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among the known ones; past their end if it is none of them."""
    return pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy().astype(np.int64)


def word_hash(word: bytes) -> int:
    """Spark's ``xxhash64`` of a word."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return h - (1 << 64) if h >> 63 else h


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(hash, word, n) over all texts; each task adds up before it sends."""
    ship_package(texts.sparkSession)
    flush = 1 << 19

    def added(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                found = split_words(batch.column(0).slice(a, b - a))[0].value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                size += len(found)
                if size > flush:
                    held = [added(held)]
                    size = held[0].num_rows
                if size > flush // 2 and len(held) == 1:
                    yield from held[0].to_batches(max_chunksize=PIECE)
                    held, size = [], 0
        if held:
            yield from added(held).to_batches(max_chunksize=PIECE)

    parts = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "word binary, n bigint")
    sums = parts.groupBy("word").agg(F.sum("n").alias("n"))
    return sums.select(F.xxhash64("word").alias("hash"), "word", "n")


def _ids(words: list[bytes], known: dict[bytes, int], other: int) -> np.ndarray:
    """Ids of a text with its end token."""
    return np.array([known.get(w, other) for w in words] + [0], dtype=np.int64)


def _keys(ids: np.ndarray, outputs: int) -> np.ndarray:
    """Context and token of every place packed in one number; places before the text count as ends."""
    one = np.concatenate([[0], ids[:-1]])
    two = np.concatenate([[0, 0], ids[:-2]])[:len(ids)]
    return (two * outputs + one) * outputs + ids


def _text_keys(ids: np.ndarray, sizes: np.ndarray, outputs: int) -> np.ndarray:
    """``_keys`` of all texts one after the other, from the ids of their words and how many each text has."""
    ends = np.cumsum(sizes + 1) - 1
    all_ids = np.insert(ids, np.cumsum(sizes), 0)
    two = np.concatenate([[0, 0], all_ids[:-2]])[:len(all_ids)]
    # where a text starts, the one before it has ended, but two places before is a word of it
    two[ends - sizes] = 0
    return (two * outputs + np.concatenate([[0], all_ids[:-1]])) * outputs + all_ids


def count_contexts(texts: DataFrame, text: str, words: tuple[bytes, ...], outputs: int, shards: int) -> DataFrame:
    """(shard, data): how often each token followed each two tokens, dealt to shards and packed by the task that counts,
    so that single keys never leave Python; a key may be in several rows, which add up."""
    shared = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))
    limit = 1 << 21

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            first, keys = _runs(keys)
            return _packed_rows(*_dealt_keys(keys, np.diff(first, append=size), shards, task))

        for batch in batches:
            for a, b in pieces(batch.column(0)):
                found, sizes = split_words(batch.column(0).slice(a, b - a))
                held.append(_text_keys(word_places(found, shared.value) + 1, sizes, outputs))
                size += len(held[-1])
                if size > limit:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    return texts.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "shard int, data binary")


def _dealt_keys(keys: np.ndarray, n: np.ndarray, shards: int, task: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_dealt`` does, for the keys that one task has counted."""
    parts = (n - 1) // PART + 1
    rest = np.repeat(n, parts)
    part = np.arange(len(rest)) - np.repeat(np.cumsum(parts) - parts, parts)
    keys = np.repeat(keys, parts)
    x = keys.astype(np.uint64) * MIX ^ (np.where(rest > 16, task + 1, 0) << 32 | part).astype(np.uint64)
    for shift in (31, 29):
        x ^= x >> np.uint64(shift)
        x *= MIX
    shard = ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
    return keys, np.minimum(rest - part * PART, PART), shard


def class_edges(unigram: np.ndarray) -> np.ndarray:
    """First output of each class, and the number of outputs: about equal sums of square roots of the shares, which
    keep the expected products per token lowest."""
    root = np.sqrt(unigram)
    upto = np.cumsum(root)
    number = ((upto - root / 2) / upto[-1] * np.ceil(upto[-1])).astype(np.int64)
    return np.append(np.unique(number, return_index=True)[1], len(unigram)).astype(np.int64)


def new_params(unigram: np.ndarray, settings: Settings, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    edges = class_edges(unigram)

    def normal(rows: int) -> np.ndarray:
        return rng.normal(0, 0.1, (rows, settings.size)).astype(np.float32)

    return {"context": normal(len(unigram)), "output": _with_bias(normal(len(unigram)), unigram),
            "classes": _with_bias(normal(len(edges) - 1), np.add.reduceat(unigram, edges[:-1])),
            "place": np.ones((2, settings.size), dtype=np.float32), "edges": edges}


def _with_bias(vectors: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors, np.log(unigram)]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_shard(keys: np.ndarray, counts: np.ndarray, params: dict[str, np.ndarray], unigram: np.ndarray,
                settings: Settings, seed: int) -> dict[str, np.ndarray]:
    """One round of noise-contrastive estimation: every token once, and all again until there are ``draws``."""
    held = _train(_drawn(keys, counts, settings), params, unigram, settings, seed)
    return {k: x if k == "edges" else held[k][:, :x.shape[1]] for k, x in params.items()}


def _drawn(keys: np.ndarray, counts: np.ndarray, settings: Settings) -> np.ndarray:
    """One number per token."""
    return np.repeat(keys, counts * _passes(int(counts.sum()), settings))


def _passes(tokens: int, settings: Settings) -> int:
    return max(1, -(-settings.draws // tokens))


def _together(drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours of ``drawn`` as one number, up to ``TOGETHER`` at a time, and how many tokens each stands for;
    taken piece by piece."""
    numbers, times = [], []
    for a in range(0, len(drawn), PIECE):
        first, part = _runs(drawn[a:a + PIECE])
        length = np.diff(first, append=min(PIECE, len(drawn) - a))
        whole = -(-length // TOGETHER)
        left = np.full(whole.sum(), TOGETHER, dtype=np.uint8)
        left[np.cumsum(whole) - 1] = length - (whole - 1) * TOGETHER
        numbers.append(np.repeat(part, whole))
        times.append(left)
    return np.concatenate(numbers), np.concatenate(times)


def _train(drawn: np.ndarray, params: dict[str, np.ndarray], unigram: np.ndarray, settings: Settings,
           seed: int, times: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The round over ``drawn`` in random order, which is taken apart batch by batch; a number stands for as many tokens as
    ``times`` says, one by default. A row of the result holds its parameters and beside them the sums of their squared
    gradients; the distinct rows of a batch are read and written once."""
    rng = np.random.default_rng(seed)
    edges, size, noise = params["edges"], settings.size, settings.noise
    mixed = np.arange(len(drawn), dtype=np.int32)
    rng.shuffle(mixed)
    tokens = len(drawn) if times is None else int(times.sum(dtype=np.int64))
    v = len(unigram)
    class_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    held = {k: np.full((len(x), 2 * x.shape[1]), 1e-3, dtype=np.float32) for k, x in params.items() if k != "edges"}
    for k, x in held.items():
        x[:, :params[k].shape[1]] = params[k]
    heads = [(name, np.log(noise * share).astype(np.float32), np.cumsum(share) / share.sum())
             for name, share in (("output", unigram), ("classes", np.add.reduceat(unigram, edges[:-1])))]

    def move(rows: np.ndarray, grad: np.ndarray) -> None:
        width = grad.shape[1]
        total = rows[:, width:]
        total += grad * grad
        grad /= np.sqrt(total)
        grad *= settings.rate
        rows[:, :width] += grad

    # a round of many tokens has steps enough in larger batches, whose rows are sorted and added up at once
    batch = int(np.clip(tokens // 1000, settings.batch, 8 * settings.batch))
    step = batch if times is None else -(-len(drawn) // -(-tokens // batch))
    for a in range(0, len(drawn), step):
        chosen = mixed[a:a + step]
        before, token = np.divmod(drawn[chosen], v)
        n, place = len(token), held["place"][:, :size]
        # in the order of tokens, which is that of classes too
        sort, first_token, distinct, _ = _grouped(token)
        before, token = before.take(sort), token.take(sort)
        often = None if times is None else times[chosen[sort]].astype(np.float32)[:, None]
        order, first, rows, at = _grouped(np.concatenate([before % v, before // v]))
        met = held["context"].take(rows, axis=0)
        r = met[:, :size].take(at, axis=0)
        # the column of the bias, and one that makes their number even and is never used
        h = np.ones((n, size + 2 - size % 2), dtype=np.float32)
        np.add(r[:n] * place[0], r[n:] * place[1], out=h[:, :size])
        steps, apart, d_h = [], [], 0
        first_class, classes = _runs(class_of[distinct])
        for (name, base, upto), rows_right, first_right in zip(
                heads, (distinct, classes), (first_token, first_token[first_class]), strict=True):
            # one draw for the whole batch
            drawn_noise = np.minimum(np.searchsorted(upto, rng.random(noise), side="right"), len(upto) - 1)
            of_head, at_head = np.unique(np.concatenate([rows_right, drawn_noise]), return_inverse=True)
            met_head = held[name].take(of_head, axis=0)
            at_right, at_noise = np.split(at_head, [len(rows_right)])
            length = np.diff(first_right, append=n)
            q = met_head[:, :size + 1].take(np.repeat(at_right, length), axis=0)
            right = 1 - _sigmoid(np.einsum("ij,ij->i", h[:, :size + 1], q) - np.repeat(base[rows_right], length))[:, None]
            if often is not None:
                right *= often
            d_h = d_h + right * q[:, :size]
            grad = np.zeros((len(of_head), size + 1), dtype=np.float32)
            grad[at_right] = _sums(right * h, first_right)[:, :size + 1]
            apart.append((met_head[at_noise, :size + 1], base[drawn_noise]))
            steps.append((held[name], of_head, met_head, grad, at_noise))
        # noise of both heads in one product each
        q_noise, base = (np.concatenate(x) for x in zip(*apart, strict=True))
        shifted = -q_noise
        shifted[:, size] += base
        back = 0
        for b in range(0, n, ROWS):
            part = h[b:b + ROWS, :size + 1]
            wrong = part @ shifted.T
            with np.errstate(over="ignore"):
                np.exp(wrong, out=wrong)
            wrong += 1
            np.reciprocal(wrong, out=wrong)
            d_noise = wrong @ q_noise[:, :size]
            if often is not None:
                d_noise *= often[b:b + ROWS]
                part = part * often[b:b + ROWS]
            d_h[b:b + ROWS] -= d_noise
            back = back + wrong.T @ part
        for i, (table, of_head, met_head, grad, at_noise) in enumerate(steps):
            np.subtract.at(grad, at_noise, back[i * noise:(i + 1) * noise])
            move(met_head, grad)
            table[of_head] = met_head
        d_rows = np.empty_like(r)
        np.multiply(d_h, place[0], out=d_rows[:n])
        np.multiply(d_h, place[1], out=d_rows[n:])
        d_place = np.stack([np.einsum("ij,ij->j", d_h, r[:n]), np.einsum("ij,ij->j", d_h, r[n:])])
        move(met, _sums(d_rows.take(order, axis=0), first))
        held["context"][rows] = met
        move(held["place"], d_place)
    return held


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal sorted rows starts, and its row."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return first, rows[first]


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of ``rows``, where each distinct one starts in it, the distinct rows, and which of them each is."""
    bits = len(rows).bit_length()
    packed = rows << bits | np.arange(len(rows))
    packed.sort()
    order, rows = packed & (1 << bits) - 1, packed >> bits
    new = np.concatenate([[True], rows[1:] != rows[:-1]])
    at = np.empty(len(rows), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order, first, rows[first], at


def _sums(grad: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at ``first``. Most runs have one row or two; only longer ones are left to
    ``reduceat``, which takes every column by itself, or two at a time as one complex number where their number is even."""
    columns = grad if grad.shape[1] % 2 or grad.dtype != np.float32 else grad.view(np.complex64)
    if len(first) * 3 < len(grad):
        return np.add.reduceat(columns, first, axis=0).view(grad.dtype)
    length = np.diff(first, append=len(grad))
    out = grad.take(first, axis=0)
    runs = np.flatnonzero(length == 2)
    out[runs] += grad.take(first[runs] + 1, axis=0)
    runs = np.flatnonzero(length > 2)
    if len(runs):
        ends = np.stack([first[runs], first[runs] + length[runs]], axis=1).reshape(-1)
        ends = ends[:-1] if ends[-1] == len(grad) else ends
        out[runs] = np.add.reduceat(columns, ends, axis=0)[::2].view(grad.dtype)
    return out


def _log_sum(score: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; ``score`` is written over."""
    top = score.max(axis=1)
    # the largest of a row need not be taken off where no sum leaves the range of 32 bits
    if top.max() < SAFE and top.min() > -SAFE:
        return np.log(np.exp(score, out=score) @ np.ones(score.shape[1], dtype=np.float32))
    score -= top[:, None]
    np.exp(score, out=score)
    return top + np.log(score.sum(axis=1))


def _shared_words(words: np.ndarray, v: int, most: int) -> np.ndarray:
    """Words that several contexts of a batch have at one place, ``most`` of them at the most, the more frequent first."""
    times = np.bincount(words, minlength=v)
    words = np.flatnonzero(times > 2)
    return np.sort(words[np.argsort(-times[words], kind="stable")[:most]])


def _class_norms(params: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over all classes for each context. A score is a sum of one part per place: of
    words that many contexts share, the exponentials of the parts are taken once, and where both are known the sum is that
    of their products. Other contexts take their own."""
    v, size, classes = len(params["output"]), params["context"].shape[1], params["classes"]
    out, direct, places = np.empty(len(context)), np.ones(len(context), dtype=bool), []
    for place, words in enumerate((context % v, context // v)):
        shared = _shared_words(words, v, TABLE // len(classes))
        score = (params["context"][shared] * params["place"][place]) @ classes[:, :size].T
        if not place:
            score += classes[:, size]
        # where products stay far inside the range of 32 bits
        plain = np.abs(score).max(axis=1, initial=0) < SAFE / 2
        row = np.full(v, -1)
        row[shared[plain]] = np.flatnonzero(plain)
        places.append((np.exp(np.clip(score, -SAFE, SAFE, out=score), out=score), row[words]))
    (right, i), (left, j) = places
    both = np.flatnonzero((i >= 0) & (j >= 0))
    for a in range(0, len(both), ROWS):
        at = both[a:a + ROWS]
        out[at] = np.log(np.einsum("ij,ij->i", right.take(i[at], axis=0), left.take(j[at], axis=0)))
    direct[both] = False
    alone = np.flatnonzero(direct)
    for a in range(0, len(alone), ROWS):
        at = alone[a:a + ROWS]
        out[at] = _log_sum(_contexts(params, context[at]) @ classes.T)
    return out


def _contexts(params: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    """Vectors of contexts, with a one for the bias."""
    v, size = len(params["output"]), params["context"].shape[1]
    h = np.ones((len(context), size + 1), dtype=np.float32)
    h[:, :size] = params["context"][context % v] * params["place"][0] + params["context"][context // v] * params["place"][1]
    return h


def log_probs(params: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of each key's token after its context. Keys are distinct and sorted."""
    out = np.empty(len(keys), dtype=np.float64)
    edges, v = params["edges"], len(params["output"])
    class_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    first, contexts = _runs(keys // v) if len(keys) else (keys, keys)
    norms = _class_norms(params, contexts)
    for a in range(0, len(keys), PIECE):
        token = keys[a:a + PIECE] % v
        low = np.searchsorted(first, a, side="right") - 1
        high = np.searchsorted(first, a + len(token))
        place = np.searchsorted(first[low:high], np.arange(a, a + len(token)), side="right") - 1
        h = _contexts(params, contexts[low:high])
        group = class_of[token]
        value = np.einsum("ij,ij->i", h.take(place, axis=0), params["classes"].take(group, axis=0)) - norms[low:high][place]
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(edges)))
        for c in np.unique(group):
            low, high = edges[c], edges[c + 1]
            step = max(1, CELLS // int(high - low))
            for b in range(ends[c], ends[c + 1] if high > low + 1 else 0, step):
                at = order[b:min(b + step, ends[c + 1])]
                score = h.take(place[at], axis=0) @ params["output"][low:high].T
                own = score[np.arange(len(at)), token[at] - low]
                value[at] += own - _log_sum(score)
        out[a:a + PIECE] = value
    return out


def log_table(params: dict[str, np.ndarray]) -> np.ndarray:
    """The log-probabilities [two before, one before, token] of a small vocabulary."""
    v = len(params["output"])
    return log_probs(params, np.arange(v ** 3)).reshape(v, v, v)


def fit(docs: DataFrame, training: Column | None = None, text: str = "text",
        settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model and the table of word counts, from the texts for which ``training`` holds."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs if training is None else docs.filter(training)
    counts = materialize(count_words(texts, text), "words")
    n_texts = texts.select(F.lit(1)).count()
    total = counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") >= settings.least)).first()
    tokens, types = int(total[0] or 0), int(total[1])
    known = max(settings.words, int(total[2]))
    if known + 2 > MOST_OUTPUTS:
        raise ValueError(f"{known} words occur {settings.least} times; raise least so that fewer than {MOST_OUTPUTS} do")
    top = _most_frequent(counts, max(settings.local_words, known))
    local = dict(top)
    words = tuple([w for w, _ in top[:known]])
    del top
    pa.default_memory_pool().release_unused()
    held = sum(local[w] for w in words)
    # every output keeps some mass, seen or not
    unigram = np.array([n_texts, *(local[w] for w in words), tokens - held]) + 0.5
    unigram = unigram / unigram.sum()
    params = new_params(unigram, settings)
    shards = max(settings.shards, -(-(tokens + n_texts) // settings.shard_tokens))
    packed = count_contexts(texts, text, words, len(unigram), shards)
    with scratch_scope(spark) as scope:
        contexts = _merged_shards(packed, scope)
        # a task trains several shards and adds up their changes before these are shuffled
        contexts = contexts.coalesce(max(spark.sparkContext.defaultParallelism, -(-shards // TASK_SHARDS)))
        with _one_row_a_batch(spark):
            for turn in range(settings.rounds if n_texts else 0):
                shared = spark.sparkContext.broadcast(params)
                train = _round(shared, unigram, settings, turn)
                changes = contexts.mapInArrow(train, "name string, block int, rows binary, weight binary, change binary")
                changes = changes.groupBy("name", "block").applyInArrow(_average, "name string, rows binary, change binary")
                found = changes.collect()
                # nothing reads the old parameters any more, so that they need not be held beside the new ones
                shared.destroy()
                for c in found:
                    params[c["name"]][np.frombuffer(c["rows"], np.int32)] += _matrix(c["change"], params[c["name"]].shape[1])
                del found
    model = Model(words, local, tokens + n_texts, types + int(n_texts > 0), n_texts, tokens - held,
                  max(types - len(words), 0), params)
    return model, counts


@contextmanager
def _one_row_a_batch(spark: SparkSession) -> Iterator[None]:
    """Rows that hold a whole shard reach Python one at a time."""
    rows = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1")
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, rows)


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` frequent words in order, equal counts by word. How often each count occurs tells which count the
    last of them has; only words of that count or more reach the driver."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n", ascending=False)
    upto = sizes["words"].cumsum()
    enough = sizes["n"][upto >= most]
    least = int(enough.iloc[0]) if len(enough) else 0
    # of the words that tie for the last places the first in order are taken, as many as there is room for
    room = int(most - upto[sizes["n"] > least].max()) if (sizes["n"] > least).any() else most
    tied = counts.filter(F.col("n") == least).orderBy("word").limit(room) if least else counts.limit(0)
    found = counts.filter(F.col("n") > least).select("word", "n").union(tied.select("word", "n")).toArrow()
    pairs = zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def _dealt(contexts: DataFrame, shards: int) -> DataFrame:
    """(key, n, shard); a count above ``PART`` is cut in parts and frequent keys are dealt task by task, so that no
    context fills a shard."""
    last = F.floor((F.col("n") - 1) / PART).cast("int")
    task = F.when(F.col("n") > 16, F.spark_partition_id()).otherwise(0)
    parts = contexts.select("key", "n", task.alias("task"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.select("key", F.least(F.col("n") - F.col("part").cast("bigint") * PART, F.lit(PART)).alias("n"),
                        F.pmod(F.xxhash64("key", "part", "task"), F.lit(shards)).cast("int").alias("shard"))


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """How many sorted keys and tokens there are, then steps between keys and counts, compressed piece by piece."""
    packer = zstandard.ZstdCompressor(level=3).compressobj()
    out = [packer.compress(np.array([len(keys), n.sum()], np.int64).tobytes())]
    for a in range(0, len(keys), PIECE):
        out.append(packer.compress(np.diff(keys[a:a + PIECE], prepend=keys[a - 1] if a else 0).tobytes()))
        out.append(packer.compress(n[a:a + PIECE].tobytes()))
    return b"".join([*out, packer.flush()])


def _pieces(data: bytes | pa.Buffer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two numbers a packed row starts with, then its keys and counts piece by piece; never the whole of them."""
    with zstandard.ZstdDecompressor().stream_reader(memoryview(data)) as reader:
        def read(numbers: int) -> np.ndarray:
            found = reader.read(numbers * 8)
            if len(found) < numbers * 8:
                raise ValueError("packed row is cut short")
            return np.frombuffer(found, np.int64)

        keys, tokens = read(2).tolist()
        yield keys, tokens
        last = 0
        for a in range(0, keys, PIECE):
            number = min(PIECE, keys - a)
            piece = np.cumsum(read(number)) + last
            last = int(piece[-1])
            yield piece, read(number)


def _unpacked(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    pieces = _pieces(data)
    keys, n = np.empty((2, next(pieces)[0]), np.int64)
    a = 0
    for piece, times in pieces:
        keys[a:a + len(piece)], n[a:a + len(piece)] = piece, times
        a += len(piece)
    return keys, n


def _merged(parts: list[bytes | pa.Buffer]) -> bytes:
    """One packed row of several."""
    return _packed(*_merged_keys(parts))


def _merged_keys(parts: list[bytes | pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several packed rows. Tokens are sorted as one number each and counted again, so that memory
    follows the tokens of a shard, of which there are about ``shard_tokens``."""
    keys = np.concatenate([np.repeat(*_unpacked(p)) for p in parts])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=n[:-1])
    n[-1] = len(keys) - first[-1]
    keys = keys[first]
    return keys, n


def _met(keys: np.ndarray, n: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """How often the tokens of a shard meet each row of each parameter; keys are taken apart piece by piece."""
    v = int(edges[-1])
    token, context = np.zeros(v), np.zeros(v)
    for a in range(0, len(keys), PIECE):
        part, times = keys[a:a + PIECE], n[a:a + PIECE]
        token += np.bincount(part % v, times, v)
        context += np.bincount(part // v % v, times, v) + np.bincount(part // v // v, times, v)
    return {"output": token, "context": context, "classes": np.add.reduceat(token, edges[:-1]),
            "place": np.full(2, n.sum(), dtype=np.float64)}


def _packed_rows(keys: np.ndarray, n: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """(shard, data): what there is for each shard in one packed row."""
    order = np.lexsort((keys, shard))
    keys, n, shard = keys[order], n[order], shard[order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    parts = zip(np.split(keys, first[1:]), np.split(n, first[1:]), strict=True)
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard[first], pa.int32()),
                                       "data": pa.array([_packed(*p) for p in parts], pa.binary())})


def _shard_table(dealt: DataFrame) -> DataFrame:
    """``_merged_shards`` of the single keys of ``_dealt``, which tasks pack before they are shuffled."""
    limit = 1 << 20

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in ("key", "n", "shard")])
                size += batch.num_rows
            if size > limit:
                yield _packed_rows(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield _packed_rows(*map(np.concatenate, zip(*held, strict=True)))

    return _merged_shards(dealt.select("key", "n", "shard").mapInArrow(pack, "shard int, data binary"))


def _merged_shards(packed: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(number, tokens, data): one file per shard, so that rounds read their shard without a shuffle, with its number of
    tokens and a packed row for every ``PIECE`` keys, so that neither side of a Python step holds a shard as one value.
    Packed rows are shuffled and merged instead of single keys. The table belongs to ``scope``, if there is one."""
    def merge(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        keys, n = _merged_keys([d.as_buffer() for d in table["data"]])
        rows = [_packed(keys[a:a + PIECE], n[a:a + PIECE]) for a in range(0, len(keys), PIECE)]
        return pa.table({"shard": pa.array([number] * len(rows), pa.int32()), "number": pa.array([number] * len(rows), pa.int32()),
                         "tokens": pa.array([int(n.sum())] * len(rows), pa.int64()), "data": pa.array(rows, pa.binary())})

    spark, path = packed.sparkSession, scratch_path(packed.sparkSession, "contexts")
    if scope is not None:
        scope.paths.append(path)
    packed.groupBy("shard").applyInArrow(merge, "shard int, number int, tokens bigint, data binary").write.partitionBy("shard").parquet(path)
    return spark.read.schema("number int, tokens bigint, data binary").parquet(path).select("number", "tokens", "data")


class _Shard:
    """What the packed rows of a shard meet, and its tokens as ``_drawn`` has them, of which nothing is held twice."""

    def __init__(self, number: int, tokens: int, edges: np.ndarray, settings: Settings):
        self.number, self.edges, self.again, self.filled = number, edges, _passes(tokens, settings), 0
        self.drawn, self.met = np.empty(tokens * self.again, np.int64), None

    def add(self, data: pa.Buffer) -> None:
        keys, n = _unpacked(data)
        part = np.repeat(keys, n * self.again)
        self.drawn[self.filled:self.filled + len(part)] = part
        self.filled += len(part)
        times = _met(keys, n, self.edges)
        self.met = times if self.met is None else {k: x + times[k] for k, x in self.met.items()}


def _shards(batches: Iterator[pa.RecordBatch], edges: np.ndarray, settings: Settings) -> Iterator[_Shard]:
    """The shards of a task, whose rows lie one after the other."""
    shard = None
    for batch in batches:
        for number, tokens, data in zip(batch["number"].to_pylist(), batch["tokens"].to_pylist(), batch["data"], strict=True):
            if shard is not None and shard.number != number:
                yield shard
                shard = None
            if shard is None:
                shard = _Shard(number, tokens, edges, settings)
            shard.add(data.as_buffer())
    if shard is not None:
        yield shard


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float16).astype(np.float32).reshape(-1, width)


def _round(shared, unigram: np.ndarray, settings: Settings, turn: int):
    """What the shards of a task do in one round: the mean changes of the rows they met, block by block, and how often
    they met them."""
    def train(shard: _Shard, sums: dict[str, np.ndarray], weights: dict[str, np.ndarray]) -> None:
        params, met = shared.value, shard.met
        drawn, times = _together(shard.drawn[:shard.filled])
        # the next shard is read before this one is let go
        shard.drawn = None
        done = _train(drawn, params, unigram, settings, turn * 100_000 + shard.number, times)
        for name, times in met.items():
            width = params[name].shape[1]
            for a in range(0, len(times), BLOCK):
                at = slice(a, a + BLOCK)
                change = done[name][at, :width] - params[name][at]
                # less than once: as noise only
                weight = np.where(change.any(axis=1), np.maximum(times[at], 0.5), 0).astype(np.float32)
                sums[name][at] += change * weight[:, None]
                weights[name][at] += weight

    def blocks(sums: dict[str, np.ndarray], weights: dict[str, np.ndarray]) -> Iterator[tuple]:
        for name, total in sums.items():
            changed = np.flatnonzero(weights[name]).astype(np.int32)
            for block in np.unique(changed // BLOCK).tolist():
                rows = changed[changed // BLOCK == block]
                weight = weights[name][rows]
                yield name, block, rows.tobytes(), weight.tobytes(), (total[rows] / weight[:, None]).astype(np.float16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that has counted before keeps what Arrow held then
        pa.default_memory_pool().release_unused()
        sums = {k: np.zeros_like(x) for k, x in shared.value.items() if k != "edges"}
        weights = {k: np.zeros(len(x), np.float32) for k, x in sums.items()}
        for shard in _shards(batches, shared.value["edges"], settings):
            train(shard, sums, weights)
        names = {"name": pa.string(), "block": pa.int32(), "rows": pa.binary(), "weight": pa.binary(), "change": pa.binary()}
        for row in blocks(sums, weights):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, names.values(), strict=True)], list(names))

    return run


def _average(table: pa.Table) -> pa.Table:
    """Mean change of the rows of one block over the shards that met them."""
    parts = sorted((r["rows"], r["weight"], r["change"]) for r in table.to_pylist())
    start = int(table["block"][0].as_py()) * BLOCK
    total, weights = None, np.zeros((BLOCK, 1))
    for rows, weight, change in parts:
        at, w = np.frombuffer(rows, np.int32) - start, np.frombuffer(weight, np.float32)[:, None]
        change = _matrix(change, len(change) // 2 // len(at))
        total = np.zeros((BLOCK, change.shape[1])) if total is None else total
        total[at] += w * change
        weights[at] += w
    met = np.flatnonzero(weights[:, 0])
    mean = (total[met] / weights[met]).astype(np.float16)
    return pa.table({"name": pa.array([table["name"][0].as_py()], pa.string()),
                     "rows": pa.array([(met + start).astype(np.int32).tobytes()], pa.binary()),
                     "change": pa.array([mean.tobytes()], pa.binary())})


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[str] | None = None,
          settings: Settings = Settings()) -> DataFrame:
    """Struct ``row`` of the kept columns, n_tokens, n_known, base_score and score (log10) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    v = len(model.words) + 2

    def make():
        m = shared.value
        pa.default_memory_pool().release_unused()
        near, far = pa.array(list(m.local), pa.binary()), len(m.local)
        output = np.minimum(np.arange(1, far + 2), v - 1)
        logs = np.append(np.log10(np.array(list(m.local.values())) + 0.5), 0.0)
        base_norm = np.log10(m.tokens + 0.5 * (m.types + 1))
        other_norm = np.log10(m.other_tokens + 0.5 * (m.other_types + 1))
        end_log, end_known = np.log10(m.texts + 0.5), int(m.texts > 0)

        def compute(texts: list[bytes]):
            words, sizes = split_words(pa.array(texts, pa.binary()))
            at, text_of = word_places(words, near), np.repeat(np.arange(len(sizes)), sizes)

            def by_text(values: np.ndarray) -> np.ndarray:
                return np.bincount(text_of, values, len(sizes))

            keys, back = np.unique(_text_keys(output[at], sizes, v), return_inverse=True)
            model_log = np.add.reduceat(log_probs(m.params, keys)[back], np.cumsum(sizes + 1) - sizes - 1) / np.log(10)
            near_logs, rare = logs[at], output[at] == v - 1
            # how often each text has each word that is not counted here
            beyond = np.flatnonzero(at == far)
            coded = words.take(beyond).dictionary_encode()
            hashes = np.array([word_hash(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)
            pairs, times = np.unique(text_of[beyond] * len(hashes) + coded.indices.to_numpy(), return_counts=True)
            text, word = np.divmod(pairs, max(len(hashes), 1))
            cuts = np.searchsorted(text, np.arange(1, len(sizes)))
            return (sizes + 1, by_text(at < far).astype(np.int64) + end_known, by_text(near_logs) + end_log - base_norm * (sizes + 1),
                    model_log + by_text(near_logs * rare) - other_norm * by_text(rare),
                    np.split(hashes[word], cuts), np.split(times.astype(np.int32), cuts))

        return compute

    fields = [field("n_tokens", "bigint"), field("known", "bigint"), field("base", "double"), field("logp", "double"),
              field("hashes", "array<bigint>"), field("times", "array<int>")]
    scored = map_texts(docs, text, make, fields, keep=keep)
    # numbers of rows are fixed once the table is written
    local = materialize(scored.withColumn("_id", F.monotonically_increasing_id()), "scored")
    rest = local.filter(F.size("hashes") > 0).select("_id", F.inline(F.arrays_zip("hashes", "times")))
    found = rest.join(counts.select(F.col("hash").alias("hashes"), F.col("n").alias("c")), "hashes", "left")
    c = F.coalesce("c", F.lit(0))
    sums = found.groupBy("_id").agg(
        F.sum(F.log10(c + 0.5) * F.col("times")).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("met"))
    joined = local.drop("hashes", "times").join(sums, "_id", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select(
        "row", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        (F.col("base") + logs).alias("base_score"), (F.col("logp") + logs).alias("score"))
