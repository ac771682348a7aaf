"""Connectors by name: readers and writers, their options checked, custom ones registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eddyflow.errors import ConnectorError
from eddyflow.sources import files, lake

Source = Callable[..., DataFrame]
Sink = Callable[..., object]
SOURCES: dict[str, Source] = {}
SINKS: dict[str, Sink] = {}


def register_source(name: str, f: Source) -> None:
    """``f(spark, schema, options, streaming)`` returns a DataFrame."""
    SOURCES[name.lower()] = f


def register_sink(name: str, f: Sink) -> None:
    """``f(df, options)`` writes a batch."""
    SINKS[name.lower()] = f


def source(spark: SparkSession, name: str, schema, options: dict, streaming: bool = False) -> DataFrame:
    if name.lower() not in SOURCES:
        raise ConnectorError(f"no source connector: {name!r}")
    return SOURCES[name.lower()](spark, schema, options, streaming)


def sink(df: DataFrame, name: str, options: dict) -> object:
    if name.lower() not in SINKS:
        raise ConnectorError(f"no sink connector: {name!r}")
    return SINKS[name.lower()](df, options)


def needed(options: dict, *names: str) -> list:
    missing = [n for n in names if n not in options]
    if missing:
        raise ConnectorError(f"missing options: {missing}")
    return [options[n] for n in names]


def _files(spark: SparkSession, schema, options: dict, streaming: bool) -> DataFrame:
    path, fmt = needed(options, "path", "format")
    rest = {k: v for k, v in options.items() if k not in ("path", "format")}
    return files.stream(spark, path, fmt, schema, **rest) if streaming else files.read(spark, path, fmt, schema, **rest)


def _generator(spark: SparkSession, schema, options: dict, streaming: bool) -> DataFrame:
    if streaming:
        return files.generator_stream(spark, int(options.get("rate", 1)))
    return files.generator(spark, int(options.get("rows", 100)), start_ms=int(options.get("start_ms", 0)), step_ms=int(options.get("step_ms", 1000)))


def kafka_options(options: dict) -> dict:
    """Options of Spark's Kafka source from ours: brokers, topic or pattern, startup mode, offsets."""
    (brokers,) = needed(options, "brokers")
    out = {"kafka.bootstrap.servers": brokers}
    if ("topic" in options) == ("pattern" in options):
        raise ConnectorError("give either a topic or a pattern")
    out |= {"subscribe": options["topic"]} if "topic" in options else {"subscribePattern": options["pattern"]}
    start = options.get("startup", "latest")
    if start in ("earliest", "latest"):
        out["startingOffsets"] = start
    elif start == "offsets":
        out["startingOffsets"] = needed(options, "offsets")[0]
    elif start == "timestamp":
        out["startingTimestamp"] = str(needed(options, "timestamp_ms")[0])
    elif start != "group":
        raise ConnectorError(f"no startup mode: {start!r}")
    if "group" in options:
        out["kafka.group.id"] = options["group"]
    if "max_records" in options:
        out["maxOffsetsPerTrigger"] = str(options["max_records"])
    return out | {f"kafka.{k}": v for k, v in options.items() if k.startswith(("security.", "sasl.", "ssl."))}


def _kafka(spark: SparkSession, schema, options: dict, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**kafka_options(options)).load()


def _jdbc(spark: SparkSession, schema, options: dict, streaming: bool) -> DataFrame:
    url, table = needed(options, "url", "table")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **{k: v for k, v in options.items() if k not in ("url", "table")}).load()


def _lake(fmt: str) -> Source:
    def read(spark: SparkSession, schema, options: dict, streaming: bool) -> DataFrame:
        (path,) = needed(options, "path")
        rest = {k: v for k, v in options.items() if k != "path"}
        return (spark.readStream if streaming else spark.read).format(fmt).options(**rest).load(path)

    return read


def _write_files(df: DataFrame, options: dict) -> None:
    path, fmt = needed(options, "path", "format")
    files.write(df, path, fmt, **{k: v for k, v in options.items() if k not in ("path", "format")})


def _write_kafka(df: DataFrame, options: dict) -> None:
    brokers, topic = needed(options, "brokers", "topic")
    df.selectExpr("CAST(NULL AS STRING) AS key" if "key" not in options else f"CAST({options['key']} AS STRING) AS key", "to_json(struct(*)) AS value").write.format("kafka").options(**{"kafka.bootstrap.servers": brokers, "topic": topic}).save()


def _versions(spark: SparkSession, schema, options: dict, streaming: bool) -> DataFrame:
    """A versioned Parquet table: whole, as of ``version``, or what changed ``after`` one."""
    (path,) = needed(options, "path")
    t = lake.LakeTable(spark, path, [k.strip() for k in options.get("keys", "").split(",") if k.strip()])
    to = int(options["version"]) if "version" in options else None
    return t.changes(int(options["after"]), to) if "after" in options else t.read(to)


def _write_versions(df: DataFrame, options: dict) -> int:
    (path,) = needed(options, "path")
    t = lake.LakeTable(df.sparkSession, path, [k.strip() for k in options.get("keys", "").split(",") if k.strip()])
    mode = options.get("mode", "append")
    if mode not in lake.KINDS:
        raise ConnectorError(f"no mode {mode!r}; only {lake.KINDS}")
    return {"append": t.append, "overwrite": t.overwrite, "merge": lambda x: t.merge(x, options.get("order"))}[mode](df)


def upsert_statements(table: str, columns: list[str], keys: list[str]) -> tuple[str, str]:
    """The statements (upsert, delete) that a keyed Postgres table takes for one changed key."""
    if not keys or not set(keys) <= set(columns):
        raise ConnectorError(f"an upsert into {table} needs keys among its columns")
    q = lambda c: '"' + c.replace('"', '""') + '"'
    rest = [c for c in columns if c not in keys]
    on = f"ON CONFLICT ({', '.join(map(q, keys))}) DO " + (f"UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}" if rest else "NOTHING")
    return f"INSERT INTO {table} ({', '.join(map(q, columns))}) VALUES ({', '.join(['%s'] * len(columns))}) {on}", f"DELETE FROM {table} WHERE {' AND '.join(f'{q(k)} = %s' for k in keys)}"


def upsert_sink(connect: Callable[[], object], table: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A function of (batch, epoch): a changelog's net changes as upserts and deletes, a transaction for each partition.

    ``connect`` opens a DB-API connection on the executor. A batch that comes again makes the same changes.
    """
    from eddyflow.operators import changelog

    def write(batch: DataFrame, epoch: int) -> None:
        net = changelog.upserts(batch if changelog.WEIGHT in batch.columns else changelog.encode(batch), keys)
        columns = [c for c in net.columns if c != "_op"]
        upsert, delete = upsert_statements(table, columns, keys)

        def send(rows) -> None:
            con = connect()
            try:
                cur = con.cursor()
                for r in rows:
                    if r["_op"] == "D":
                        cur.execute(delete, [r[k] for k in keys])
                    else:
                        cur.execute(upsert, [r[c] for c in columns])
                con.commit()
            finally:
                con.close()

        net.foreachPartition(send)

    return write


for _name in ("files", "file"):
    register_source(_name, _files)
    register_sink(_name, _write_files)
register_source("generator", _generator)
register_source("kafka", _kafka)
register_sink("kafka", _write_kafka)
for _name in ("jdbc", "postgres", "mysql"):
    register_source(_name, _jdbc)
register_source("lake", _versions)
register_sink("lake", _write_versions)
for _name in ("delta", "iceberg"):
    register_source(_name, _lake(_name))
