"""Decoding of messages: JSON, CSV, raw, Debezium, change capture and telemetry envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eddyflow.errors import ConnectorError, SchemaError

POLICIES = ("null", "reject")
# Fixed schemas of telemetry records.
OTEL = {
    "traces": "traceId STRING, spanId STRING, parentSpanId STRING, name STRING, kind INT, startTimeUnixNano STRING, endTimeUnixNano STRING, attributes STRING, status STRUCT<code: INT, message: STRING>",
    "metrics": "name STRING, unit STRING, description STRING, timeUnixNano STRING, asDouble DOUBLE, asInt STRING, attributes STRING",
    "logs": "timeUnixNano STRING, severityNumber INT, severityText STRING, body STRING, attributes STRING, traceId STRING, spanId STRING",
}


def json(df: DataFrame, column: str, ddl: str, *, root: str | None = None, explode: str | None = None, paths: dict[str, str] | None = None, mismatch: str = "null", unknown: str = "ignore", rest: str = "_rest") -> DataFrame:
    """Rows of JSON messages.

    ``root`` is the path of the record in the message, ``explode`` that of an array
    whose items are records; ``paths`` gives single columns their own path.
    ``mismatch`` sets wrong types null or fails; ``unknown`` fields are ignored,
    collected in ``rest`` as JSON, or rejected.
    """
    if mismatch not in POLICIES or unknown not in ("ignore", "collect", "reject"):
        raise ConnectorError(f"json policies: {mismatch!r}, {unknown!r}")
    schema = StructType.fromDDL(ddl)
    x = df.withColumn("_j", F.col(column) if root is None else F.get_json_object(column, root))
    if explode:
        items = F.from_json(F.get_json_object("_j", explode), "array<variant>")
        x = x.withColumn("_j", F.explode(items)).withColumn("_j", F.to_json("_j"))
    x = x.withColumn("_v", F.from_json("_j", schema, {"mode": "FAILFAST" if mismatch == "reject" else "PERMISSIVE"}))
    names = F.array(*map(F.lit, schema.names))
    more = F.array_except(F.coalesce(F.json_object_keys("_j"), F.array().cast("array<string>")), names)
    if unknown == "reject":
        x = x.withColumn("_v", F.when(F.size(more) > 0, F.raise_error(F.concat(F.lit(str(SchemaError("unknown fields: "))), F.array_join(more, ", ")))).otherwise(F.col("_v")))
    cols = [F.get_json_object("_j", paths[f.name]).cast(f.dataType).alias(f.name) if paths and f.name in paths else F.col(f"_v.{f.name}") for f in schema.fields]
    if unknown == "collect":
        cols.append(F.to_json(F.map_filter(F.from_json("_j", "map<string,variant>"), lambda k, v: ~F.array_contains(names, k))).alias(rest))
    return x.select(*[c for c in df.columns if c != column], *cols)


def csv(df: DataFrame, column: str, ddl: str, *, delimiter: str = ",", null: str = "", mismatch: str = "null") -> DataFrame:
    """Rows of CSV lines."""
    v = F.from_csv(F.col(column), ddl, {"sep": delimiter, "nullValue": null, "mode": "FAILFAST" if mismatch == "reject" else "PERMISSIVE"})
    return df.withColumn("_v", v).select(*[c for c in df.columns if c != column], "_v.*")


def raw(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], F.col(column).cast("binary").alias("payload"))


def debezium(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """The row of a change envelope: ``after`` of c, u and r, ``before`` of d; with ``__op`` and ``__ts_ms``."""
    env = f"before STRUCT<{ddl_fields(ddl)}>, after STRUCT<{ddl_fields(ddl)}>, op STRING, ts_ms BIGINT"
    v = F.from_json(F.coalesce(F.get_json_object(column, "$.payload"), F.col(column)), env)
    x = df.withColumn("_v", v).withColumn("_row", F.when(F.col("_v.op") == "d", F.col("_v.before")).otherwise(F.col("_v.after")))
    return x.select(*[c for c in df.columns if c != column], "_row.*", F.col("_v.op").alias("__op"), F.col("_v.ts_ms").alias("__ts_ms"))


def ddl_fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def postgres(df: DataFrame, ddl: str) -> DataFrame:
    """Rows of a Postgres change stream (``_table, _op, _lsn, _ts_ms, _before, _after``)."""
    x = df.withColumn("_row", F.from_json(F.when(F.col("_op") == "D", F.col("_before")).otherwise(F.col("_after")), ddl))
    return x.select("_row.*", "_table", "_op", "_lsn", "_ts_ms")


def mysql(df: DataFrame, ddl: str) -> DataFrame:
    """Rows of a MySQL change stream: its rows beside ``_table, _op, _ts_ms, _binlog_file, _binlog_pos, _gtid``."""
    names = StructType.fromDDL(ddl)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in names.fields], "_table", "_op", "_ts_ms", "_binlog_file", "_binlog_pos", "_gtid")


def mongodb(df: DataFrame, ddl: str) -> DataFrame:
    """Rows of a MongoDB change stream: the full document, or the key alone of a delete, with ``_op`` I, U or D."""
    op = F.when(F.col("_op") == "insert", "I").when(F.col("_op") == "delete", "D").otherwise("U")
    doc = F.from_json(F.coalesce("_full_document", "_document_key"), ddl)
    return df.select(doc.alias("_d"), op.alias("_op"), "_namespace", "_wall_time_ms").select("_d.*", "_op", "_namespace", "_wall_time_ms")


def otel(df: DataFrame, column: str, signal: str) -> DataFrame:
    """Telemetry records of one signal (traces, metrics or logs) from JSON lines; times in microseconds, zone-less."""
    if signal not in OTEL:
        raise ConnectorError(f"no telemetry signal: {signal!r}")
    x = df.select(F.from_json(column, OTEL[signal]).alias("_v")).select("_v.*")
    for name in [c for c in x.columns if c.endswith("UnixNano")]:
        x = x.withColumn(name.replace("UnixNano", ""), F.timestamp_micros(F.expr(f"CAST({name} AS BIGINT) div 1000")).cast("timestamp_ntz")).drop(name)
    return x


DECODERS = {"json": json, "csv": csv, "raw": raw, "debezium": debezium}


def decode(df: DataFrame, column: str, fmt: str, *args, **options) -> DataFrame:
    """Decode a message column in a format by name."""
    if fmt == "avro":
        raise ConnectorError("avro needs the spark-avro package on the cluster")
    if fmt not in DECODERS:
        raise ConnectorError(f"no format: {fmt!r}")
    return DECODERS[fmt](df, column, *args, **options)
