"""Run a continuous query: emit mode, trigger, sink and checkpoint."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eddyflow.errors import StreamError
from eddyflow.operators.windows import interval, micros

#: Output mode of each emit strategy; changes are made of successive results.
EMIT = {"on window close": "append", "final": "append", "on update": "update", "after watermark": "update", "every": "update", "changes": "complete", None: "update"}


def with_watermark(df: DataFrame, ts: str, delay: str | int = "0 s") -> DataFrame:
    """Declare event time: a zone-less column becomes a timestamp (in UTC), as watermarks need it."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, interval(micros(delay)))


@dataclass
class Epoch:
    """One micro-batch of a sink: its number and rows."""

    id: int
    rows: list = field(default_factory=list)


def output_mode(emit: str | None, windowed: bool = True) -> str:
    emit = emit.lower() if emit else None
    kind = emit.split(" interval")[0].strip() if emit else None
    if kind and kind.startswith(("every", "periodically")):
        kind = "every"
    if kind == "on watermark":
        kind = "after watermark"
    if kind not in EMIT:
        raise StreamError(f"no emit strategy: {emit!r}")
    if kind in ("on window close", "final") and not windowed:
        raise StreamError(f"EMIT {emit.upper()} needs a window and a watermark")
    return EMIT[kind]


def trigger_of(emit: str | None, available: bool) -> dict:
    if available:
        return {"availableNow": True}
    if emit and (m := re.match(r"(?:every|periodically)\s+(?:interval\s+)?'?([^']+)'?", emit, re.I)):
        return {"processingTime": f"{micros(m[1]) // 1000} milliseconds"}
    return {"processingTime": "0 seconds"}


def start(
    df: DataFrame, *, emit: str | None = None, mode: str | None = None, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, fmt: str = "parquet", name: str | None = None,
    checkpoint: str | None = None, available: bool = False, windowed: bool = True,
) -> StreamingQuery:
    """Start a query into a function of (batch, epoch), files under ``path``, or a memory table ``name``.

    With a checkpoint the query resumes where it stopped; functions get a batch
    again after a failure, under the same epoch, and must overwrite it.
    """
    writer = df.writeStream.outputMode(mode or output_mode(emit, windowed)).trigger(**trigger_of(emit, available))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if sink is not None:
        return writer.foreachBatch(sink).start()
    if path is not None:
        return writer.format(fmt).start(path)
    if not name:
        raise StreamError("a query needs a sink, a path or a name")
    return writer.format("memory").start()


def drain(df: DataFrame, *, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run over all that is available now and return the result: a table of what was emitted.

    Rows, state and progress are files of the shared folder; none pass through the driver.
    """
    from eddyflow.streaming.views import View

    spark = df.sparkSession
    folder = folder or scratch(spark)
    view = View(spark, f"{folder}/out")
    start(df, mode=mode, sink=view, available=True, checkpoint=f"{folder}/checkpoint").awaitTermination()
    return view.read() if view.epochs() else spark.createDataFrame([], df.schema)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of the cluster; a local one only where everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise StreamError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
    return tempfile.mkdtemp(prefix="eddyflow-stream-")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 1, **options) -> DataFrame:
    """A stream of the files under a folder, ``files`` of them in each micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def replay(df: DataFrame, ts: str, parts: int, folder: str) -> DataFrame:
    """A stream of a table's rows in order of time: written as files, one in each micro-batch.

    Streams take files by time of change, so those are set in the order of their rows.
    """
    spark = df.sparkSession
    df.repartitionByRange(parts, ts).sortWithinPartitions(ts).write.mode("overwrite").parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName(), s.getPath(), s.getModificationTime()) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    for i, (_, file, at) in enumerate(names):
        fs.setTimes(file, at - 1000 * (len(names) - i), -1)
    return file_stream(spark, folder, df.schema)
