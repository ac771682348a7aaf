"""Recovery of a stopped query from an older checkpoint, where the last one is damaged or unwanted."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from eddyflow.errors import StreamError
from eddyflow.streaming.views import View


class Log:
    """A folder of a checkpoint with one small file for each epoch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def file(self, epoch: int):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, str(epoch))

    def epochs(self) -> list[int]:
        if not self.fs.exists(self.path):
            return []
        return sorted(int(n) for s in self.fs.listStatus(self.path) if (n := s.getPath().getName()).isdigit())

    def whole(self, epoch: int) -> bool:
        """Whether an epoch's file can be read and has a version and an object of JSON."""
        try:
            stream = self.fs.open(self.file(epoch))
            try:
                text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError:
            return False
        return re.fullmatch(r"(?s)v\d+\s*\n\{.*\}\s*", text) is not None

    def cut(self, epoch: int) -> None:
        """Take away all files after an epoch's, the latest first."""
        for e in reversed(self.epochs()):
            if e > epoch:
                self.fs.delete(self.file(e), False)


def fall_back(spark: SparkSession, checkpoint: str, *, to: int | None = None, view: View | None = None) -> int:
    """Take a stopped query's checkpoint back to its last whole epoch, not after ``to``; that epoch.

    An epoch is whole if both its offsets and its commit can be read. What the
    checkpoint and ``view`` hold of later epochs goes, and the query runs them again
    from its sources when it starts. State is read as of the epoch kept, which Spark
    holds for the last ``spark.sql.streaming.minBatchesToRetain`` epochs. A view that
    no longer has the epochs up to the one kept, or keeps only the last, is made anew
    by the batches that follow.
    """
    offsets, commits = (Log(spark, f"{checkpoint.rstrip('/')}/{name}") for name in ("offsets", "commits"))
    kept = [e for e in sorted(set(offsets.epochs()) & set(commits.epochs()), reverse=True) if to is None or e <= to]
    epoch = next((e for e in kept if offsets.whole(e) and commits.whole(e)), None)
    if epoch is None:
        raise StreamError(f"no whole epoch in {checkpoint}")
    # commits go first: an epoch with offsets alone is one that has yet to run
    commits.cut(epoch)
    offsets.cut(epoch)
    if view is not None:
        view.cut(epoch)
    return epoch
