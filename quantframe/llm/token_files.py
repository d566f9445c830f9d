"""Token ids of documents in compact binary files, and back.

A file is a table of blocks in ascending document order. A block holds whole documents: their ids ranked by
frequency in the block, one to four bytes a rank (least significant first) in ``data``, and the byte counts in
``control``, two bits each, four to a byte, lowest bits first. ``ranked`` is the id of each rank, uint32
little-endian. Control bytes are decoded by one table lookup for four values, ranks by one more for ids.

    part int, seq int          place of the block: task, block within the task
    doc_ids array<bigint>      documents of the block in order
    lengths array<int>         ids of each
    n_ids bigint, ranked, control, data binary

Blocks are written through Spark's Parquet writer into a folder that all executors share, so a task run again
after a lost executor replaces its own output. Memory of a task follows the block (``block_ids`` or one
document) and a bounded cache of chunks.

Where a document starts is a running sum in two levels: over the parts, of which there are as many as tasks,
and over the blocks inside a part.

Defined cases: NULL text has the end id only; NULL doc_ids come first; documents of equal id stand side by
side, ordered by text; ids of equal frequency are ranked by id; a very long text is a block of its own; an empty
table gives a file without blocks; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantframe.llm.bpe import Vocabulary
from quantframe.llm.common import pieces, spaced_batch
from quantframe.session import ship_package

BLOCK_IDS = 1 << 19
CACHE = 500_000
SCHEMA = ("part int, seq int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, ranked binary, "
          "control binary, data binary")
_encoders: dict[int, ChunkEncoder] = {}

#: Byte counts of the four values behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of a run of ids."""
    if not len(ids):
        return b"", b"", b""
    counts = np.bincount(ids)
    present = np.nonzero(counts)[0]
    ranked = present[np.lexsort((present, -counts[present]))]
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[:len(ids)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) < size[:, None]
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used]
    return ranked.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids behind ``pack``."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    octets = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    ranks = octets[at].astype(np.uint32)
    for k in range(1, int(size.max())):
        ranks |= np.where(size > k, octets[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, dtype="<u4")[ranks]


class ChunkEncoder:
    """Ids of texts through the public library, which sees each distinct chunk between blanks once, as words never
    reach over blanks. Chunks met lately are kept in two generations of bounded size."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [c for c in chunks if c not in known]
        known.update((c, older[c]) for c in missing if c in older)
        fresh = [c for c in missing if c not in older]
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in fresh], add_special_tokens=False)
        known.update(zip(fresh, [array("I", e.ids).tobytes() for e in found], strict=True))

    def __call__(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it; where each text ends)."""
        if not texts:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        joined, ends = spaced_batch(texts)
        coded = pa.compute.split_pattern(pa.array([joined], pa.large_binary()), " ").values.dictionary_encode()
        places = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int64)[:len(coded.dictionary) + 1].tolist()
        octets = coded.dictionary.buffers()[2].to_pybytes()
        chunks = [octets[a:b] for a, b in pairwise(places)]
        self._learn(chunks)
        entries = list(map(self.known.__getitem__, chunks))
        pool = np.frombuffer(b"".join(entries), dtype=np.uint32)
        size = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        at = coded.indices.to_numpy()
        counts = size[at]
        upto = np.cumsum(counts)
        ids = pool[np.repeat((np.cumsum(size) - size)[at] - upto + counts, counts) + np.arange(int(upto[-1]) if len(upto) else 0)]
        ends = upto[ends - 1]
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(texts) + 1)


def _encoder(spec: str) -> ChunkEncoder:
    """One encoder per worker process, so that what it knows outlives a task."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(spec)
    return _encoders[key]


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 1, doc_id: str = "doc_id",
                      text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the blocks in ascending order of ``doc_id``.

    Only ids and texts are shuffled, once, by ranges of the id; encoding happens behind that shuffle. The vocabulary
    has to be one whose words end at blanks; another one is refused.
    """
    Vocabulary.read(vocabulary_path)
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(json.dumps(json.load(file)))
    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, encode = TaskContext.get().partitionId(), 0, _encoder(spec.value)
        ids, runs, held = [], [], 0

        def block() -> pa.RecordBatch:
            ranked, control, data = pack(np.concatenate(runs))
            row = {"part": part, "seq": seq, "doc_ids": ids, "lengths": [len(r) for r in runs], "n_ids": held,
                   "ranked": ranked, "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], BLOCK_ARROW)

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for a, b in pieces(texts):
                found, ends = encode([x or b"" for x in texts.slice(a, b - a).to_pylist()], end_id)
                for i, run in zip(batch.column(0).slice(a, b - a).to_pylist(), np.split(found, ends[:-1]), strict=True):
                    ids.append(i)
                    runs.append(run)
                    held += len(run)
                    if held >= block_ids:
                        yield block()
                        ids, runs, held, seq = [], [], 0, seq + 1
        if ids:
            yield block()

    ordered.mapInArrow(blocks, SCHEMA).write.parquet(path)


BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("n_ids", pa.int64()), ("ranked", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def _starts(blocks: DataFrame) -> DataFrame:
    """(part, seq, block_start): ids in all blocks before."""
    sizes = blocks.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("before", before).join(parts, "part").select(
        "part", "seq", (F.col("part_start") + F.col("before")).alias("block_start"))


def _read(spark: SparkSession, path: str, fields: str, values: Callable[[np.ndarray], list]) -> DataFrame:
    """Decode blocks; ``values`` gets the ids of one document and returns the columns named in ``fields``."""
    ship_package(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    schema = f"part int, seq int, doc_id bigint, within bigint, n_tokens bigint, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(row["n_ids"], row["ranked"], row["control"], row["data"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                columns = [values(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(ends), pa.int32()),
                    "seq": pa.array([row["seq"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": ends - lengths, "n_tokens": lengths,
                    **{n: [c[k] for c in columns] for k, n in enumerate(names)}})

    # a decoded block is a batch of its own; few blocks travel to Python at a time
    found = blocks.mapInArrow(decode, schema)
    return found.join(_starts(blocks), ["part", "seq"]).withColumn("start", F.col("block_start") + F.col("within"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document."""
    return _read(spark, path, "ids array<bigint>", lambda ids: [ids.tolist()]).select("doc_id", "start", "n_tokens", "ids")


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    return _read(spark, path, "ids_crc32 bigint", lambda ids: [zlib.crc32(ids.astype("<u4").tobytes())]).select(
        "doc_id", "start", "n_tokens", "ids_crc32")
