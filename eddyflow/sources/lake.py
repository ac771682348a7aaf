"""Versioned tables of Parquet files: snapshots, changes between versions, merges, exactly-once commits.

For clusters without a lake format's package. A table is a folder: a commit first
claims a version (a file that only one writer can create), writes its rows under
``data/version=N`` and then makes them visible by a file in ``log`` whose name tells
version, kind, and the writer's name and epoch. Rows without that file are never
read, so that a commit that fails half way leaves nothing. Merged rows carry ``_op``
(U or D) and are collapsed by key when read; ``compact`` writes the result as a new base.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyflow.errors import ConnectorError
from eddyflow.operators import changelog

VERSION, OP = "_version", "_op"
KINDS = ("append", "overwrite", "merge")


@dataclass(frozen=True)
class Commit:
    version: int
    kind: str
    writer: str
    epoch: int


class LakeTable:
    """One table; ``keys`` tell rows apart for merges."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ()):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    # ------------------------------------------------------------ files
    def _place(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._place(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def commits(self) -> list[Commit]:
        """All visible commits in order."""
        parts = [n.split("-", 3) for n in self._names("log")]
        return sorted((Commit(int(v), kind, writer, -1 if e == "none" else int(e)) for v, kind, e, writer in parts), key=lambda c: c.version)

    @property
    def version(self) -> int:
        """The last visible version; 0 for a new table."""
        return max((c.version for c in self.commits()), default=0)

    def _claim(self) -> int:
        """A version of this writer's own, greater than all that were claimed before."""
        n = max((int(x) for x in self._names("claims")), default=0)
        for _ in range(1000):
            n += 1
            p, fs = self._place(f"claims/{n}")
            try:
                fs.create(p, False).close()
            except Py4JJavaError:  # another writer was first
                continue
            return n
        raise ConnectorError(f"no version of {self.path} could be claimed")

    # ------------------------------------------------------------ write
    def prepare(self, df: DataFrame) -> int:
        """First phase: write rows under a version that nobody sees yet."""
        n = self._claim()
        df.write.mode("overwrite").parquet(f"{self.path}/data/version={n}")
        return n

    def commit(self, version: int, kind: str, writer: str = "batch", epoch: int = -1) -> int:
        """Second phase: make a prepared version visible, unless the writer's epoch already is."""
        if kind not in KINDS:
            raise ConnectorError(f"no commit of kind {kind!r}; only {KINDS}")
        if epoch >= 0 and any(c.writer == writer and c.epoch == epoch for c in self.commits()):
            return version
        p, fs = self._place(f"log/{version:020d}-{kind}-{epoch if epoch >= 0 else 'none'}-{writer}")
        fs.create(p, False).close()
        return version

    def append(self, df: DataFrame) -> int:
        return self.commit(self.prepare(df), "append")

    def overwrite(self, df: DataFrame) -> int:
        return self.commit(self.prepare(df), "overwrite")

    def merge(self, changes: DataFrame, order: str | None = None) -> int:
        """Upsert and delete by key: rows with ``_op`` (D goes, all else stays); without it all are upserts.

        ``order`` tells which of several changes of a key is the last; without it a key may change once.
        """
        return self.commit(self.prepare(self._changes(changes, order)), "merge")

    def _changes(self, changes: DataFrame, order: str | None) -> DataFrame:
        if not self.keys:
            raise ConnectorError(f"a merge into {self.path} needs keys")
        if OP not in changes.columns:
            changes = changes.withColumn(OP, F.lit("U"))
        if order is not None:
            return changelog.collapse(changes, self.keys, order)
        return changes.withColumn(OP, F.when(F.col(OP).isin("D", "U-"), "D").otherwise("U"))

    def sink(self, writer: str, mode: str = "append", order: str | None = None):
        """A function of (batch, epoch) for a continuous query: each epoch of ``writer`` is in the table once."""
        if mode not in KINDS:
            raise ConnectorError(f"no mode {mode!r}; only {KINDS}")

        def write(batch: DataFrame, epoch: int) -> None:
            if any(c.writer == writer and c.epoch == epoch for c in self.commits()):
                return
            self.commit(self.prepare(self._changes(batch, order) if mode == "merge" else batch), mode, writer, epoch)

        return write

    def compact(self) -> int:
        """The whole table as one new base; older versions stay readable."""
        return self.overwrite(self.read())

    # ------------------------------------------------------------ read
    def _load(self, commits: Sequence[Commit]) -> DataFrame:
        paths = [f"{self.path}/data/version={c.version}" for c in commits]
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths).withColumnRenamed("version", VERSION)

    def _until(self, version: int | None) -> list[Commit]:
        found = [c for c in self.commits() if version is None or c.version <= version]
        if not found:
            raise ConnectorError(f"{self.path} has no version {'yet' if version is None else version}")
        return found

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, or the last one."""
        found = self._until(version)
        base = max((i for i, c in enumerate(found) if c.kind == "overwrite"), default=0)
        df = self._load(found[base:])
        if not any(c.kind == "merge" for c in found[base:]):
            return df.drop(VERSION, OP)
        if OP not in df.columns:
            df = df.withColumn(OP, F.lit("U"))
        return changelog.collapse(df, self.keys, VERSION).filter(F.col(OP) == "U").drop(VERSION, OP)

    def changes(self, after: int, to: int | None = None) -> DataFrame:
        """Rows of the commits after a version (to another one), with ``_version`` and ``_op``: I for appended ones, else U or D."""
        found = [c for c in self._until(to) if c.version > after]
        if any(c.kind == "overwrite" for c in found):
            raise ConnectorError(f"{self.path} was overwritten after version {after}: read it as a whole")
        if not found:
            return self.read(to).limit(0).withColumn(VERSION, F.lit(0)).withColumn(OP, F.lit(""))
        df = self._load(found)
        return df.withColumn(OP, F.coalesce(F.col(OP), F.lit("I")) if OP in df.columns else F.lit("I"))
