"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a block of texts are laid end to end as symbols. An index maps every adjacent pair to all
its positions in the block; the active ranks are taken in ascending order, each merges all its positions at
once, and the lists of the pairs that appear beside a merged symbol are extended. A position whose symbols
have changed meanwhile is skipped when its pair's turn comes. Each distinct word is merged once per block and
its ids stay in a bounded cache; texts are then put together word by word. Work and memory follow the block
(``common.PIECE_BYTES``), not the partition.

The vocabulary file (a JSON model with normaliser, split pattern and word-end suffix) is read on the driver
and broadcast; its size does not depend on the data. Ids equal those of the public library without special
tokens added; strings of special tokens inside a text become their ids, as there. Decoding joins the symbols'
texts by one space, as a model without a decoder does.

Defined cases: NULL text is empty; an empty or blank text has no ids and decodes to the empty string; repeated
rows are encoded alike; of pairs with equal rank the leftmost is merged first; an empty table gives no rows; a very long
text is encoded whole in one task; the kept columns travel in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from quantframe.llm.common import chunks_of, field, map_texts

CACHE = 250_000
#: Ids decoded at a time.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What a vocabulary file says: symbol ids, merges in rank order, split pattern, special tokens."""

    ids: dict[str, int]
    merges: tuple[tuple[str, str], ...]
    pattern: str
    suffix: str
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None:
            raise ValueError(f"vocabulary with steps {steps} is not supported")
        merges = tuple(tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"])
        return Vocabulary(spec["model"]["vocab"], merges, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
                          spec["model"]["end_of_word_suffix"], {t["content"]: t["id"] for t in spec["added_tokens"]})

    @cached_property
    def texts(self) -> dict[int, str]:
        """Text of each id."""
        return {**{i: t for t, i in self.ids.items()}, **{i: t for t, i in self.special.items()}}

    @property
    def text_list(self) -> list[str]:
        """Texts in the order of ids, empty for ids without one."""
        return [self.texts.get(i, "") for i in range(max(self.texts, default=-1) + 1)]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairIndexEncoder:
    """Merges many words at once through an index from pairs to positions."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        ids = vocabulary.ids
        self.rank = {(ids[a] << 20) | ids[b]: r for r, (a, b) in enumerate(vocabulary.merges)}
        self.result = np.array([ids[a + b] for a, b in vocabulary.merges], dtype=np.int64)
        keys = np.array(list(self.rank), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), dtype=np.int64)[order]
        self.left, self.right = np.array([[ids[a], ids[b]] for a, b in vocabulary.merges], dtype=np.int64).T
        symbols = byte_symbols()
        self.first = np.array([ids[c] for c in symbols], dtype=np.int64)
        self.last = np.array([ids[c + vocabulary.suffix] for c in symbols], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it never merges."""
        pair = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], -1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words end to end, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(data)
        ends = np.cumsum(lengths)
        symbol = self.first[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        # neighbours inside a word; n stands for none
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[ends - 1] = n
        before[ends - lengths] = n
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        place = np.nonzero(follow < n)[0]
        rank = self._ranks(symbol[place], symbol[follow[place]])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(place: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            place, rank = place[keep], rank[keep]
            order = np.argsort(rank, kind="stable")
            place, rank = place[order], rank[order]
            cuts = np.nonzero(np.diff(rank))[0] + 1
            starts = np.concatenate([[0], cuts]) if len(rank) else cuts
            for a, b in zip(starts.tolist(), [*cuts.tolist(), len(rank)], strict=False):
                r = int(rank[a])
                if r in index:
                    index[r].append(place[a:b])
                else:
                    index[r] = [place[a:b]]
                    heapq.heappush(active, r)

        add(place, rank)
        left_of, right_of = self.left, self.right
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = left_of[r], right_of[r]
            after = follow[at]
            fits = alive[at] & (after < n) & (symbol[at] == a)
            at, after = at[fits], after[fits]
            fits = symbol[after] == b
            at, after = at[fits], after[fits]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # in a run of equal symbols every second position merges, from the left
                at = np.sort(at)
                after = follow[at]
                chained = np.concatenate([[False], after[:-1] == at[1:]])
                start = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
                odd = (np.arange(len(at)) - start) % 2 == 1
                at, after = at[~odd], after[~odd]
            symbol[at] = self.result[r]
            alive[after] = False
            beyond = follow[after]
            follow[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            prior = before[at]
            prior = prior[prior < n]
            fresh = np.unique(np.concatenate([prior, at[inside]]))
            if len(fresh):
                add(fresh, self._ranks(symbol[fresh], symbol[follow[fresh]]))
        left = alive[:n]
        return symbol[left], np.bincount(owner[left], minlength=len(words))


class TextEncoder:
    """Ids of whole texts. Each distinct chunk has one cached entry, its ids as 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.merge = vocabulary, PairIndexEncoder(vocabulary)
        # chunks are laid out one per line, so a line feed found beside the words ends a chunk
        self.split = regex.compile(vocabulary.pattern + r"|\n")
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.exact = pre_tokenizers.Split(Regex(vocabulary.pattern), "removed", invert=True)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.known: dict[bytes, bytes] = {b"": b""}

    @cached_property
    def texts(self) -> pa.Array:
        return pa.array(self.v.text_list, pa.string())

    def _words(self, text: str) -> list[str]:
        """Words of a text without special tokens, after the vocabulary's normalisation."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # one character at a time where a lower-case form depends on its place in the word
        lowered = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.split.findall(lowered)

    def _rare_words(self, chunk: str) -> list[str | int]:
        """Words of a chunk with a special token, or with letters that Unicode versions may class differently."""
        out, at = [], 0
        for m in [*self.special.finditer(chunk), None]:
            part = chunk[at:m.start()] if m else chunk[at:]
            out += [w for w, _ in self.exact.pre_tokenize_str(self.normal.normalize_str(part))] if part else []
            if m:
                out.append(self.v.special[m.group()])
                at = m.end()
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Add entries for chunks; their distinct words are merged in one block."""
        plain, rare = [], []
        for c in chunks:
            (rare if max(c) >= 0xC9 or b"<|" in c else plain).append(c)
        found = self._words(b"\n".join(plain).decode("utf-8", "replace")) if plain else []
        parts = [self._rare_words(c.decode("utf-8", "replace")) for c in rare]
        distinct = list({*found, *(w for ws in parts for w in ws if isinstance(w, str))}.difference(("\n",)))
        entries = dict(zip(distinct, self._entries(distinct), strict=True))
        for m in {w for ws in parts for w in ws if not isinstance(w, str)}:
            entries[m] = np.int32(m).tobytes()
        known, join = self.known, b"".join
        for c, ws in zip(rare, parts, strict=True):
            known[c] = join([entries[w] for w in ws])
        chunk, own = iter(plain), []
        for w in found:
            if w == "\n":
                known[next(chunk)] = own[0] if len(own) == 1 else join(own)
                own = []
            else:
                own.append(entries[w])
        if plain:
            known[next(chunk)] = join(own)

    def _entries(self, words: list[str]) -> list:
        if not words:
            return []
        ids, counts = self.merge([w.encode() for w in words])
        flat, ends = ids.astype(np.int32).tobytes(), (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def chunks(self, texts: list[bytes]) -> list[list[bytes]]:
        """Chunks of each text, all of them known on return."""
        cut = [chunks_of(t) for t in texts]
        used = set().union(*cut)
        used.add(b"")
        fresh = used.difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            # what this block uses stays
            self.known = {c: self.known[c] for c in used.difference(fresh)}
        self.learn(list(fresh))
        return cut


_ENCODERS: dict[tuple, TextEncoder] = {}


def _encoder(vocabulary: Vocabulary) -> TextEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    key = len(vocabulary.ids), hash(vocabulary.merges), vocabulary.pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(vocabulary)
    return _ENCODERS[key]


def _ids(encoder: TextEncoder, texts: list[bytes]) -> pa.Array:
    """Lists of the ids of each text."""
    ids = [b"".join(map(encoder.known.__getitem__, cs)) for cs in encoder.chunks(texts)]
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def _decoded(column: pa.Array, texts: pa.Array, block: int) -> pa.Array:
    """Text of each list of ids; NULL for NULL. About ``block`` ids are looked up and joined at a time."""
    done, start = [], 0
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy().astype(np.int64)
    upto = np.append(0, np.cumsum(sizes))
    while start < len(column):
        # rows of about ``block`` ids at a time, or one longer row
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + block, side="right")) - 1)
        part = column.slice(start, end - start)
        offsets = pa.array((upto[start:end + 1] - upto[start]).astype(np.int32))
        words = pa.ListArray.from_arrays(offsets, texts.take(part.flatten()))
        joined = pa.compute.binary_join(words, " ")
        done.append(pa.compute.if_else(part.is_valid(), joined, pa.scalar(None, pa.string())))
        start = end
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Struct ``row`` of the kept columns, and ``ids`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder = _encoder(shared.value)
        return lambda texts: [_ids(encoder, texts)]

    return map_texts(docs, text, make, [field("ids", "array<int>")], keep=keep, limit=1 << 20)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded", block: int = BLOCK) -> DataFrame:
    """The input with the text of each row's ids; NULL ids give NULL."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.text_list)

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return _decoded(column, pa.array(shared.value), block)

    return encoded.withColumn(out, text_of(ids))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``decode`` after ``encode`` in one Python step, so that a core holds one worker instead of two."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder = _encoder(shared.value)

        def compute(texts: list[bytes]):
            ids = _ids(encoder, texts)
            return [ids, _decoded(ids, encoder.texts, BLOCK)]

        return compute

    return map_texts(docs, text, make, [field("ids", "array<int>"), field("decoded", "string")], keep=keep, limit=1 << 20)


def digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Struct ``row``, ids, decoded text, n_tokens, and the digests of the ids as decimals and of the decoded text."""
    done = round_trip(docs, vocabulary, text, keep)
    return done.select("row", "ids", "decoded", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
