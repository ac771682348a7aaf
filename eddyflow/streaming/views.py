"""Materialized views and subscriptions on files, by epoch (micro-batch number)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from eddyflow.errors import StreamError


class View:
    """What a continuous query has emitted, a folder for each epoch.

    ``replace`` keeps the last epoch only (an aggregate's whole result); ``append``
    keeps them all, or the last ``retain`` epochs. A batch that comes again overwrites
    its own epoch, so that a restart repeats nothing.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "append", retain: int | None = None):
        if mode not in ("append", "replace"):
            raise StreamError(f"no view mode: {mode!r}")
        self.spark, self.path, self.mode, self.retain = spark, path.rstrip("/"), mode, retain

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        keep = 1 if self.mode == "replace" else self.retain
        if keep:
            for old in self.epochs()[:-keep]:
                self._delete(f"{self.path}/epoch={old}")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        jvm, _, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)

    def epochs(self) -> list[int]:
        _, p, fs = self._fs()
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("epoch="))

    def cut(self, epoch: int) -> None:
        """Take away all epochs after ``epoch``."""
        for later in self.epochs():
            if later > epoch:
                self._delete(f"{self.path}/epoch={later}")

    def read(self) -> DataFrame:
        """The view's rows: of the last epoch, or of all."""
        found = self.epochs()
        if not found:
            raise StreamError("the view has no epoch yet")
        if self.mode == "replace":
            return self.spark.read.parquet(f"{self.path}/epoch={found[-1]}")
        return self.spark.read.option("basePath", self.path).option("mergeSchema", "true").parquet(*[f"{self.path}/epoch={e}" for e in found]).drop("epoch")

    def since(self, epoch: int) -> DataFrame:
        """All rows of epochs after ``epoch``, with their epoch; an error if some are not kept any more."""
        found = self.epochs()
        if found and found[0] > epoch + 1:
            raise StreamError(f"epochs {epoch + 1} to {found[0] - 1} are not retained")
        later = [f"{self.path}/epoch={e}" for e in found if e > epoch]
        if not later:
            return self.read().withColumn("epoch", F.lit(0)).limit(0)
        return self.spark.read.option("basePath", self.path).parquet(*later)


class Subscription:
    """A cursor over a view: rows in order of epoch, ``fetch`` at a time, from an epoch on, filtered."""

    def __init__(self, view: View, where: str | None = None, as_of: int | None = None):
        self.view, self.where, self.at = view, where, -1 if as_of is None else as_of
        self.rows: Iterator[Row] = iter(())
        self.open = True

    def fetch(self, n: int) -> list[Row]:
        """At most ``n`` rows; none if there is nothing new."""
        if not self.open:
            raise StreamError("the cursor is closed")
        out: list[Row] = []
        while len(out) < n:
            row = next(self.rows, None)
            if row is None:
                later = [e for e in self.view.epochs() if e > self.at]
                if not later:
                    break
                self.view.since(self.at)  # fails if epochs are missing
                df = self.view.spark.read.parquet(f"{self.view.path}/epoch={later[0]}")
                self.at = later[0]
                self.rows = (df.filter(self.where) if self.where else df).toLocalIterator()
                continue
            out.append(row)
        return out

    def frame(self) -> DataFrame:
        """All rows that are left, as a table: nothing is fetched to the driver."""
        if not self.open:
            raise StreamError("the cursor is closed")
        df = self.view.since(self.at)
        self.at, self.rows = max(self.view.epochs(), default=self.at), iter(())
        return (df.filter(self.where) if self.where else df).drop("epoch")

    def close(self) -> None:
        self.open = False
