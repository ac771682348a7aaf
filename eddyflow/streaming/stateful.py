"""Stateful operators on streams: changelogs of running results, late rows, lags, temporal filters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eddyflow.operators.changelog import WEIGHT


def emit_changes(df: DataFrame, keys: list[str], value: str, *, idle: str | None = None) -> DataFrame:
    """Running count and sum of each group as a changelog: the old row retracted, the new one inserted.

    A group that did not change emits nothing. With ``idle`` (a duration of
    processing time) a group that gets no row for so long is retracted.
    """
    schema = df.select(*keys).schema.add("n", "long").add("total", "double").add(WEIGHT, "long")
    from eddyflow.operators.windows import micros

    wait = micros(idle) // 1000 if idle else None

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if old:
                yield pd.DataFrame([[*key, *old, -1]], columns=schema.names)
            return
        n, total = old or (0, 0.0)
        for x in rows:
            n, total = n + len(x), total + float(x[value].sum())
        state.update((n, total))
        if wait:
            state.setTimeoutDuration(wait)
        if old != (n, total):
            yield pd.DataFrame(([[*key, *old, -1]] if old else []) + [[*key, n, total, 1]], columns=schema.names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, "n long, total double", "append", timeout)


def lag(df: DataFrame, keys: list[str], ts: str, value: str, name: str = "previous") -> DataFrame:
    """The value before, of the same key, across micro-batches (rows of a batch in order of time)."""
    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields)).add(name, df.schema[value].dataType)
    kind = df.schema[value].dataType.simpleString()

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(ts, kind="stable")
        last = state.get[0] if state.exists else None
        before = x[value].shift(1)
        x[name] = before.astype(object).where(before.notna(), None)
        if len(x):
            x.iloc[0, x.columns.get_loc(name)] = last
            state.update((x[value].iloc[-1].item() if hasattr(x[value].iloc[-1], "item") else x[value].iloc[-1],))
        yield x[schema.names]

    return df.groupBy(*keys).applyInPandasWithState(run, schema, f"v {kind}", "append", GroupStateTimeout.NoTimeout)


def temporal_filter(df: DataFrame, key: str, ts: str, keep: str) -> DataFrame:
    """``ts > now() - keep`` as a changelog: a row is inserted when it comes, retracted when the watermark passes.

    ``df`` has a watermark on ``ts``; ``key`` and ``ts`` tell rows apart. Rows without a time, and those that have left
    before they come, give nothing. Spark moves the watermark after a batch: a row that leaves by the rows of the batch
    before its own is inserted and retracted in one epoch.
    """
    from eddyflow.operators.windows import micros

    leave = F.ceil((F.unix_millis(F.col(ts)) + micros(keep) // 1000) / 1000).cast("long") * 1000
    # The event time of what follows is when a row leaves, and state closes at the watermark: a millisecond later it has passed.
    closes = F.timestamp_millis(leave + 1).alias("_closes", metadata={"spark.watermarkDelayMs": 0})
    x = df.filter(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts)).alias("_at"), closes)
    come, gone = x.dropDuplicates(), x.groupBy(key, "_at", "_closes").agg(F.lit(-1).cast("long").alias(WEIGHT))
    come = come.withColumn(WEIGHT, F.lit(1).cast("long"))
    return come.union(gone).select(key, F.timestamp_micros("_at").alias(ts), WEIGHT)


def in_order(df: DataFrame, ts: str, bucket: str, order: list[str]) -> DataFrame:
    """Rows sorted by time as far as the watermark has passed: bucket by bucket, with their place in it.

    ``df`` has a watermark on ``ts``; a bucket comes out, sorted, once it is closed.
    """
    cols = [ts, *order, *(c for c in df.columns if c not in (ts, *order))]
    from eddyflow.operators import windows as w

    sorted_ = F.array_sort(F.collect_list(F.struct(*cols)))
    x = df.groupBy(w.tumble(ts, bucket).alias("_w")).agg(sorted_.alias("_rows"))
    return x.select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), F.posexplode("_rows").alias("place", "_r")).select("bucket", "place", "_r.*")


class LateSplit:
    """A sink that parts each micro-batch into rows on time and late rows (a side output).

    The bound is the greatest event time of earlier batches less the delay and the
    allowed lateness; null times are dropped and counted. With ``folder`` (in shared
    storage) the bound is kept there after each epoch, so that a restarted query, or a
    batch that comes again, has the bound that it had before.
    """

    def __init__(self, ts: str, delay_us: int, lateness_us: int, on_time, late, folder: str | None = None):
        self.ts, self.slack, self.on_time, self.late = ts, delay_us + lateness_us, on_time, late
        self.folder = folder
        self.bound: int | None = None
        self.nulls = 0
        self.dropped = 0

    def _kept(self, spark: SparkSession, epoch: int) -> int | None:
        """The bound after the last epoch before this one."""
        path, fs = self._place(spark, "")
        found = [s.getPath().getName().split("_") for s in fs.listStatus(path)] if fs.exists(path) else []
        return max(((int(e), int(b)) for _, e, b in found if int(e) < epoch), default=(0, None))[1]

    def _place(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.folder:
            self.bound = self._kept(batch.sparkSession, epoch)
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        top, nulls, n_late = batch.agg(F.max(us), F.count(F.when(F.col(self.ts).isNull(), 1)), F.count(F.when(us < (self.bound if self.bound is not None else -(1 << 62)), 1))).first()
        whole = batch.filter(F.col(self.ts).isNotNull())
        old = F.lit(False) if self.bound is None else us < self.bound
        self.on_time(whole.filter(~old), epoch)
        self.late(whole.filter(old), epoch)
        self.nulls += nulls
        self.dropped += n_late
        if top is not None:
            self.bound = max(self.bound if self.bound is not None else top - self.slack, top - self.slack)
        if self.folder and self.bound is not None:
            path, fs = self._place(batch.sparkSession, f"bound_{epoch}_{self.bound}")
            fs.create(path, True).close()
