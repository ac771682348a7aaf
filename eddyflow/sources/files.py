"""File sources and sinks: CSV, TSV, JSON, text, binary, Parquet, ORC and Arrow IPC."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eddyflow.errors import ConnectorError

READERS = {"csv": "csv", "tsv": "csv", "json": "json", "text": "text", "raw": "binaryFile", "parquet": "parquet", "orc": "orc"}
MODES = {"null": "PERMISSIVE", "collect": "PERMISSIVE", "skip": "DROPMALFORMED", "reject": "FAILFAST"}


def options_of(fmt: str, options: dict) -> dict:
    """Reader options of our names: delimiter, header, null, mismatch, rejected (a column for bad rows), glob, metadata."""
    out = {"sep": "\t"} if fmt == "tsv" else {}
    names = {"delimiter": "sep", "header": "header", "null": "nullValue", "glob": "pathGlobFilter", "compression": "compression", "multiline": "multiLine", "rejected": "columnNameOfCorruptRecord"}
    for k, v in options.items():
        if k == "mismatch":
            if v not in MODES:
                raise ConnectorError(f"mismatch must be one of {sorted(MODES)}")
            out["mode"] = MODES[v]
        elif k in names:
            out[names[k]] = v
        else:
            out[k] = v
    return out


def read(spark: SparkSession, path: str, fmt: str, schema: str | StructType | None = None, *, metadata: bool = False, **options) -> DataFrame:
    """Read files; ``metadata`` adds the ``_metadata`` struct (path, name, size, time)."""
    if fmt == "arrow":
        return read_arrow(spark, path, schema)
    if fmt not in READERS:
        raise ConnectorError(f"no file format: {fmt!r}")
    reader = spark.read.format(READERS[fmt]).options(**options_of(fmt, options))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select("*", "_metadata") if metadata else df


def stream(spark: SparkSession, path: str, fmt: str, schema: str | StructType, *, files: int = 100, metadata: bool = False, **options) -> DataFrame:
    """New files as they come, at most ``files`` in a micro-batch."""
    if fmt not in READERS:
        raise ConnectorError(f"no streaming file format: {fmt!r}")
    df = spark.readStream.format(READERS[fmt]).schema(schema).option("maxFilesPerTrigger", files).options(**options_of(fmt, options)).load(path)
    return df.select("*", "_metadata") if metadata else df


def write(df: DataFrame, path: str, fmt: str, *, mode: str = "append", rows_per_file: int | None = None, partition: list[str] | None = None, **options) -> None:
    """Write files; ``rows_per_file`` rotates them."""
    if fmt == "arrow":
        return write_arrow(df, path, mode)
    if fmt not in READERS or fmt == "raw":
        raise ConnectorError(f"no file format to write: {fmt!r}")
    if rows_per_file:
        options["maxRecordsPerFile"] = rows_per_file
    writer = df.write.format(READERS[fmt]).mode(mode).options(**options_of(fmt, options))
    (writer.partitionBy(*partition) if partition else writer).save(path)


def read_arrow(spark: SparkSession, path: str, schema: str | StructType | None) -> DataFrame:
    """Arrow IPC files, each decoded by the executor that reads it."""
    if schema is None:
        raise ConnectorError("Arrow files need a schema")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                with pa.ipc.open_stream(pa.BufferReader(blob.as_py())) as reader:
                    for part in reader:
                        yield part.select(kind.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow*").load(path).select("content").mapInArrow(decode, kind)


def write_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    """One Arrow IPC stream for each batch of rows, through Spark's own committer.

    The streams are the rows of a Parquet-free sequence: a folder of binary files
    is written as text in base64, one stream a line, so that a lost task leaves no
    partial file.
    """
    import base64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(sink.getvalue().to_pybytes()).decode()])], names=["value"])

    df.mapInArrow(encode, "value string").write.mode(mode).option("lineSep", "\n").text(f"{path}/arrow64")


def read_arrow64(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_arrow`` wrote."""
    kind = StructType.fromDDL(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                with pa.ipc.open_stream(pa.BufferReader(blob.as_py())) as reader:
                    yield from reader

    return spark.read.text(f"{path}/arrow64").select(F.unbase64("value").alias("b")).mapInArrow(decode, kind)


def generator(spark: SparkSession, rows: int, *, start_ms: int = 0, step_ms: int = 1000) -> DataFrame:
    """A table of ``seq``, ``ts_ms`` and ``value``."""
    return spark.range(rows).select(F.col("id").alias("seq"), (F.lit(start_ms) + F.col("id") * step_ms).cast("long").alias("ts_ms"), F.concat(F.lit("value-"), F.col("id").cast("string")).alias("value"))


def generator_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """The same as a stream, at a rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("seq"), F.floor(F.unix_micros("timestamp") / 1000).cast("long").alias("ts_ms"), F.concat(F.lit("value-"), F.col("value").cast("string")).alias("value"))
