"""Session helpers: scratch tables in the folder the cluster shares, and the package on executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_shipped: set[str] = set()
_scopes: list[Scope] = []


class Scope:
    """Scratch tables of one piece of work, removed together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Store a result so that it outlives this scope: it belongs to the scope around it, if there is one."""
        around = _scopes[_scopes.index(self) - 1] if self in _scopes and _scopes.index(self) else None
        return _stored(df, name, around)

    def drop(self) -> None:
        """Remove the tables, also those that a failed write left half done."""
        for path in self.paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = []


@contextmanager
def scratch_scope(spark: SparkSession, scope: Scope | None = None) -> Iterator[Scope]:
    """Tables that ``materialize`` makes inside the block belong to its scope, which is dropped at the end; a scope
    that is handed in is left to its owner."""
    own = scope or Scope(spark)
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        if scope is None:
            own.drop()


def _stored(df: DataFrame, name: str, scope: Scope | None) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    if scope is not None:
        scope.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Only a session without it, as in tests on one
    machine, gets a folder of its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quantframe-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new table path under the shared folder."""
    return f"{shared_dir(spark)}/quantframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Compute once and keep the result as a table in the shared folder, so that it outlives executors.
    Later steps read only the columns they need, and Spark knows the table's true size. Inside a
    ``scratch_scope`` the table belongs to that scope, else it stays."""
    return _stored(df, name, _scopes[-1] if _scopes else None)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application. Operators with Python steps call it, so that
    it need not be installed on the cluster."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quantframe-")) / package.name
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
