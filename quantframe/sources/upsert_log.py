"""A keep-last table as a log of batches: nothing stored is ever rewritten in place.

    path/data/<run>/        rows of one batch, or of several compacted ones
    path/versions/<n>.json  the runs that make up version n, oldest first, and the last batch of each stream

A merge writes the batch as a run of its own and then commits a version that lists it. The commit is one rename of a
small file, which fails where another writer has taken the number; the writer then starts from that version. A crash before the
commit leaves files that no version lists, a crash after it a finished merge: readers see either all of a batch or
nothing, and a batch that is handed in again is recognised by its number. Reads keep the last row of each key over
the listed runs.

Runs are compacted by size: a merge joins the newest runs once the older one is not more than twice as large as those
behind it together, so a row is rewritten as often as the table doubles and not once per batch. ``vacuum`` removes
runs that no recent version lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.plans.latest import keep_last
from quantframe.sources.history import read_table, union_batches, with_metadata

RUN = "_run"


@dataclass(frozen=True)
class Version:
    """``runs`` are (name, rows), oldest first; ``streams`` has the number of the last batch of each stream."""

    number: int = 0
    runs: tuple[tuple[str, int], ...] = ()
    streams: Mapping[str, int] = field(default_factory=dict)


class UpsertLog:
    """The table at ``path``, whose rows are told apart by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order_by: Sequence[str] = (), compact_from: int = 4):
        self.spark, self.path, self.key, self.order_by = spark, path.rstrip("/"), list(key), list(order_by)
        self.compact_from = compact_from

    # files

    def _at(self, *parts: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self) -> JavaObject:
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(), self._at(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The latest version, or an earlier one."""
        numbers = self._numbers() if number is None else [number]
        if not numbers:
            return Version()
        stream = self._files().open(self._at("versions", f"{numbers[-1]:012d}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(numbers[-1], tuple((n, r) for n, r in found["runs"]), found["streams"])

    def _commit(self, version: Version) -> bool:
        """Publish a version; false if its number is taken."""
        files = self._files()
        files.mkdirs(self._at("versions"))
        draft, final = self._at("versions", f"_{uuid.uuid4().hex}"), self._at("versions", f"{version.number:012d}.json")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"runs": version.runs, "streams": dict(version.streams)}).encode()))
        finally:
            out.close()
        if not files.exists(final) and files.rename(draft, final):
            return True
        files.delete(draft, False)
        return False

    # rows

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name, self.spark.read.parquet(f"{self.path}/data/{name}").count()

    def _merged(self, runs: Sequence[tuple[str, int]]) -> DataFrame:
        parts = [read_table(self.spark, f"{self.path}/data/{name}").withColumn(RUN, F.lit(i)) for i, (name, _) in enumerate(runs)]
        return keep_last(union_batches(*parts), self.key, [RUN]).drop(RUN)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The last row of each key in the latest or an earlier version; None while nothing is stored."""
        runs = self.version(number).runs
        return self._merged(runs) if runs else None

    def merge(self, batch: DataFrame, metadata: Mapping[str, object] | None = None, fetched_at: Column | None = None,
              stream: str = "", batch_id: int | None = None) -> bool:
        """Merge a batch, whose rows win over stored ones; ``order_by`` decides among its own. False if the stream's
        batch of this number, or a later one, is merged already, or if it has no rows."""
        def done(v: Version) -> bool:
            return batch_id is not None and batch_id <= v.streams.get(stream, -1)

        version = self.version()
        if done(version):
            return False
        rows = keep_last(with_metadata(batch, metadata or {}, fetched_at), self.key, self.order_by).drop(*self.order_by)
        run = self._write(rows)
        while not done(version):
            streams = {**version.streams, **({} if batch_id is None else {stream: batch_id})}
            runs = (*version.runs, run) if run[1] else version.runs
            if self._commit(Version(version.number + 1, runs, streams)):
                self.compact()
                return run[1] > 0
            version = self.version()  # another writer was faster
        return False

    def compact(self) -> bool:
        """Join the newest runs of like size into one. The result is dropped if a merge came in between."""
        version = self.version()
        start, behind = len(version.runs), 0
        while start and (start == len(version.runs) or version.runs[start - 1][1] <= 2 * behind):
            start -= 1
            behind += version.runs[start][1]
        if len(version.runs) - start < self.compact_from:
            return False
        joined = self._write(self._merged(version.runs[start:]))
        return self._commit(Version(version.number + 1, (*version.runs[:start], joined), version.streams))

    def vacuum(self, keep_versions: int = 2) -> list[str]:
        """Remove runs that none of the latest versions lists, and older versions. For times without writers: a run
        that is being written is in no version yet."""
        numbers = self._numbers()
        kept = numbers[-max(1, keep_versions):]
        listed = {name for n in kept for name, _ in self.version(n).runs}
        gone = [n for n in self._names("data") if n not in listed]
        for name in gone:
            self._files().delete(self._at("data", name), True)
        for n in numbers:
            if n not in kept:
                self._files().delete(self._at("versions", f"{n:012d}.json"), False)
        return gone
