import sqlite3

import pytest
from pyspark.sql import functions as F

from eddyflow.errors import ConnectorError
from eddyflow.sources import connectors
from eddyflow.sources.lake import LakeTable


def keyed(t):
    return sorted((r["k"], r["v"]) for r in t.collect())


def test_versions(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t", ["k"])
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    with pytest.raises(ConnectorError):
        t.read()
    assert t.append(rows((1, "a"), (2, "b"))) == 1
    changes = spark.createDataFrame([(1, "x", "U", 1), (1, "y", "U", 2), (2, "b", "D", 1), (3, "c", "I", 1)], "k long, v string, _op string, n int")
    assert t.merge(changes, order="n") == 2
    assert keyed(t.read()) == [(1, "y"), (3, "c")] and keyed(t.read(1)) == [(1, "a"), (2, "b")]
    assert sorted((r["k"], r["_op"], r["_version"]) for r in t.changes(1).collect()) == [(1, "U", 2), (2, "D", 2), (3, "U", 2)]
    assert t.changes(2).count() == 0
    # a prepared version is unseen, and takes no other writer's number
    lost = t.prepare(rows((9, "z")))
    other = LakeTable(spark, t.path, ["k"])
    assert other.append(rows((4, "d"))) == lost + 1 and keyed(other.read()) == [(1, "y"), (3, "c"), (4, "d")]
    assert t.commit(lost, "append") == lost and len(keyed(t.read())) == 4
    assert t.compact() == 5 and keyed(t.read()) == [(1, "y"), (3, "c"), (4, "d"), (9, "z")]
    with pytest.raises(ConnectorError):
        t.changes(1)  # across an overwrite
    with pytest.raises(ConnectorError):
        LakeTable(spark, t.path).merge(rows((1, "q")))
    sink = t.sink("job", "merge")
    for _ in range(2):
        sink(rows((1, "again")), 7)
    assert [c.epoch for c in t.commits() if c.writer == "job"] == [7] and keyed(t.read())[0] == (1, "again")


def test_upserts_into_a_database(spark, tmp_path):
    path = str(tmp_path / "db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (2, "b")])

    class Cursor:
        def __init__(self, cur):
            self.cur = cur

        def execute(self, sql, values):
            self.cur.execute(sql.replace("%s", "?"), values)

    class Connection:
        def __init__(self):
            self.con = sqlite3.connect(path, timeout=60)

        def cursor(self):
            return Cursor(self.con.cursor())

        def __getattr__(self, name):
            return getattr(self.con, name)

    sink = connectors.upsert_sink(Connection, "t", ["k"])
    changes = spark.createDataFrame([(1, "a", -1), (1, "x", 1), (2, "b", -1), (3, "c", 1), (4, "d", 1), (4, "d", -1)], "k long, v string, __weight long").coalesce(1)
    for _ in range(2):  # a batch that comes again
        sink(changes, 0)
    with sqlite3.connect(path) as con:
        assert sorted(con.execute("SELECT k, v FROM t")) == [(1, "x"), (3, "c")]
    assert connectors.upsert_statements("s.t", ["k"], ["k"])[0] == 'INSERT INTO s.t ("k") VALUES (%s) ON CONFLICT ("k") DO NOTHING'
    with pytest.raises(ConnectorError):
        connectors.upsert_statements("t", ["v"], ["k"])


def test_kafka_options():
    base = {"brokers": "h:9092", "topic": "t"}
    assert connectors.kafka_options(base) == {"kafka.bootstrap.servers": "h:9092", "subscribe": "t", "startingOffsets": "latest"}
    assert connectors.kafka_options({"brokers": "h", "pattern": "t.*", "startup": "earliest"})["subscribePattern"] == "t.*"
    assert "startingOffsets" not in connectors.kafka_options(base | {"startup": "group", "group": "g"}) and connectors.kafka_options(base | {"group": "g"})["kafka.group.id"] == "g"
    assert connectors.kafka_options(base | {"startup": "offsets", "offsets": '{"t":{"0":5}}'})["startingOffsets"] == '{"t":{"0":5}}'
    assert connectors.kafka_options(base | {"startup": "timestamp", "timestamp_ms": 12})["startingTimestamp"] == "12"
    assert connectors.kafka_options(base | {"max_records": 100})["maxOffsetsPerTrigger"] == "100" and connectors.kafka_options(base | {"sasl.mechanism": "PLAIN"})["kafka.sasl.mechanism"] == "PLAIN"
    for bad in ({"topic": "t"}, {"brokers": "h"}, base | {"pattern": "p"}, base | {"startup": "never"}, base | {"startup": "offsets"}):
        with pytest.raises(ConnectorError):
            connectors.kafka_options(bad)


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    from eddyflow.errors import StreamError
    from eddyflow.streaming import run

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(StreamError):
        run.scratch(Session())


def test_late_bound_survives_a_restart(spark, tmp_path):
    from eddyflow.streaming.stateful import LateSplit

    seen = {"on": [], "late": []}
    make = lambda: LateSplit("ts", 0, 0, lambda df, _: seen["on"].append(df.count()), lambda df, _: seen["late"].append(df.count()), f"file://{tmp_path}/bounds")
    batch = lambda *days: spark.createDataFrame([(f"2024-01-{d:02d}",) for d in days], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    make()(batch(10, 11), 0)
    make()(batch(9, 12), 1)  # another process
    make()(batch(9, 12), 1)  # the same batch again
    assert seen == {"on": [2, 1, 1], "late": [0, 1, 1]}
