import pytest
from pyspark.sql import functions as F

from eddyflow.engine import Engine
from eddyflow.errors import CatalogError, ConnectorError, EngineError, JoinError, SchemaError, SqlError, StreamError, WindowError
from eddyflow.sources import connectors, files, formats
from eddyflow.sources.schema import History, infer_json, type_of, verdict, widened
from eddyflow.sql import lex, rewrite

DDL = "CREATE SOURCE trades (symbol VARCHAR NOT NULL, price DOUBLE, volume BIGINT, ts TIMESTAMP, WATERMARK FOR ts AS ts - INTERVAL '1' SECOND);"
ROWS = "INSERT INTO trades VALUES ('A', 10.0, 1, TIMESTAMP_NTZ '2024-01-01 00:00:00.1'), ('A', 20.0, 2, TIMESTAMP_NTZ '2024-01-01 00:00:04'), ('B', 5.0, 3, TIMESTAMP_NTZ '2024-01-01 00:00:06');"


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.execute(DDL + ROWS)
    return e


def test_stream_and_cascade(engine):
    engine.execute("""CREATE STREAM bars AS SELECT symbol, tumble(ts, INTERVAL '5' SECOND) AS ws, SUM(volume) AS v FROM trades GROUP BY symbol, tumble(ts, INTERVAL '5' SECOND);
      CREATE MATERIALIZED VIEW total AS SELECT SUM(v) AS v FROM bars""")
    assert engine.sql("SELECT v FROM total").first()[0] == 6
    engine.execute("INSERT INTO trades VALUES ('C', 1.0, 10, TIMESTAMP_NTZ '2024-01-01 00:00:07')")
    assert engine.sql("SELECT v FROM total").first()[0] == 16
    with pytest.raises(CatalogError, match="depend"):
        engine.execute("DROP STREAM bars")
    engine.execute("DROP STREAM bars CASCADE")
    assert engine.execute("SHOW MATERIALIZED VIEWS").count() == 0


def test_emit_on_window_close(engine):
    q = "SELECT symbol, window_start, COUNT(*) AS n FROM trades GROUP BY symbol, TUMBLE(ts, INTERVAL '5' SECOND) EMIT ON WINDOW CLOSE"
    assert [(r["symbol"], r["n"]) for r in engine.sql(q).collect()] == [("A", 2)]
    engine.advance("trades", 1_704_067_300_000_000)
    assert engine.sql(q).count() == 2
    with pytest.raises(WindowError):
        engine.sql("SELECT COUNT(*) FROM trades EMIT ON WINDOW CLOSE")


def test_slowest_source_holds_windows_open(engine):
    engine.execute("CREATE SOURCE news (symbol VARCHAR, nts TIMESTAMP, WATERMARK FOR nts AS nts)")
    q = "SELECT window_start, COUNT(*) AS n FROM (SELECT t.ts FROM trades t LEFT JOIN news w ON t.symbol = w.symbol) GROUP BY TUMBLE(ts, INTERVAL '5' SECOND) EMIT ON WINDOW CLOSE"
    assert engine.sql(q).count() == 0
    engine.execute("INSERT INTO news VALUES ('Z', TIMESTAMP_NTZ '2024-01-01 00:01:00')")
    assert engine.sql(q).count() == 1


def test_late_and_null_rows_are_dropped(engine):
    engine.execute("INSERT INTO trades VALUES ('L', 1.0, 1, TIMESTAMP_NTZ '2024-01-01 00:00:01'), ('N', 1.0, 1, NULL)")
    assert engine.sql("SELECT COUNT(*) FROM trades").first()[0] == 3
    assert engine.metrics["trades"] == {"rows": 3, "late": 1, "null_time": 1}
    before = engine.watermark("trades")
    engine.execute("INSERT INTO trades VALUES ('F', 1.0, 1, TIMESTAMP_NTZ '2999-01-01 00:00:00')")
    assert engine.watermark("trades") == before  # a clock far ahead moves nothing


def test_asof_sql(spark):
    e = Engine(spark)
    e.execute("""CREATE SOURCE quotes (sym VARCHAR, price DOUBLE, qts TIMESTAMP); CREATE SOURCE hits (sym VARCHAR, tts TIMESTAMP);
      INSERT INTO quotes VALUES ('A', 1.0, TIMESTAMP_NTZ '2024-01-01 00:00:01'), ('A', 2.0, TIMESTAMP_NTZ '2024-01-01 00:00:05');
      INSERT INTO hits VALUES ('A', TIMESTAMP_NTZ '2024-01-01 00:00:04'), ('A', TIMESTAMP_NTZ '2024-01-01 00:00:09'), ('B', TIMESTAMP_NTZ '2024-01-01 00:00:09')""")
    got = e.sql("SELECT t.sym, q.price FROM hits t ASOF JOIN quotes q MATCH_CONDITION(t.tts >= q.qts AND t.tts - q.qts <= INTERVAL '3' SECOND) ON t.sym = q.sym")
    assert {(r[0], r[1]) for r in got.collect()} == {("A", 1.0), ("A", None), ("B", None)}
    near = e.sql("SELECT t.tts, q.price FROM hits t ASOF JOIN quotes q ON t.sym = q.sym AND MATCH_CONDITION(NEAREST(t.tts, q.qts)) WHERE t.sym = 'A' ORDER BY t.tts")
    assert [r[1] for r in near.collect()] == [2.0, 2.0]
    for op in (">", "<"):
        with pytest.raises(JoinError):
            e.sql(f"SELECT t.sym FROM hits t ASOF JOIN quotes q MATCH_CONDITION(t.tts {op} q.qts) ON t.sym = q.sym")
    e.execute("CREATE MATERIALIZED VIEW m AS SELECT t.sym, q.price FROM hits t ASOF JOIN quotes q MATCH_CONDITION(t.tts >= q.qts) ON t.sym = q.sym")
    assert sorted((r[0], r[1]) for r in e.sql("SELECT * FROM m").collect() if r[1]) == [("A", 1.0), ("A", 2.0)]
    probe = e.sql("SELECT t.sym, p.offset_ms, q.price FROM hits t TEMPORAL PROBE JOIN quotes q ON (sym) TIMESTAMPS (tts, qts) LIST (0s, 5s) AS p WHERE t.sym = 'A'")
    assert sorted((r[1], r[2]) for r in probe.collect()) == [(0, 1.0), (0, 2.0), (5000, 2.0), (5000, 2.0)]
    with pytest.raises(JoinError):
        e.sql("SELECT 1 FROM hits t ASOF JOIN quotes q ON t.sym = q.sym")


def test_tables_and_introspection(engine):
    engine.execute("CREATE TABLE dims (symbol VARCHAR PRIMARY KEY, name VARCHAR); INSERT INTO dims VALUES ('A', 'x'); INSERT INTO dims VALUES ('A', 'y')")
    assert engine.sql("SELECT t.symbol, d.name FROM trades t JOIN dims d ON t.symbol = d.symbol").distinct().first() == ("A", "y")
    assert engine.execute("SHOW CREATE SOURCE trades").first()[0].startswith("CREATE SOURCE")
    assert [r["column"] for r in engine.execute("DESCRIBE trades").filter("watermark").collect()] == ["ts"]
    assert engine.execute("EXPLAIN ANALYZE SELECT * FROM trades").first()["rows_produced"] == 3
    assert "Physical Plan" in engine.execute("EXPLAIN SELECT * FROM trades").first()[0]
    engine.execute("ALTER SOURCE trades ADD COLUMN venue VARCHAR")
    assert "venue" in engine.sql("SELECT * FROM trades").columns
    engine.execute("CREATE TABLE copy AS SELECT * FROM dims")
    assert engine.sql("SELECT * FROM copy").count() == 1
    with pytest.raises(CatalogError):
        engine.execute("CREATE TABLE dims (a INT)")
    engine.execute("CREATE TABLE IF NOT EXISTS dims (a INT); DROP TABLE IF EXISTS nothing")
    assert engine.topology()[0][0] == "trades"


def test_rejections(engine):
    for sql, error in (
        ("CREATE STREAM s AS SELECT * FROM trades ORDER BY price", SqlError), ("CREATE STREAM s AS SELECT * FROM trades a CROSS JOIN trades b", JoinError), ("CREATE STREAM s AS SELECT SUM(price) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) FROM trades", WindowError),
        ("CREATE THING x", SqlError), ("DROP SOURCE none", CatalogError), ("CREATE SOURCE w (a INT, WATERMARK FOR b AS b - INTERVAL '1' SECOND)", SqlError), ("SELECT COUNT(*) FROM trades GROUP BY HOP(ts, INTERVAL '10' SECOND, INTERVAL '5' SECOND)", WindowError),
    ):
        with pytest.raises(error):
            engine.execute(sql)
    assert issubclass(WindowError, EngineError) and str(WindowError("x")).startswith("[EF-3000]")


def test_sinks_and_subscriptions(engine, tmp_path):
    engine.execute(f"CREATE STREAM big AS SELECT symbol, price FROM trades WHERE price >= 10; CREATE SINK out FROM big WHERE price > 15 INTO files (path = '{tmp_path}/o', format = 'json')")
    assert engine.flush("out") == 1
    assert engine.spark.read.json(f"{tmp_path}/o").first()["price"] == 20.0
    engine.run_cycle("big")
    engine.execute("DECLARE c CURSOR FOR SUBSCRIBE big WHERE price > 15")
    assert [r["price"] for r in engine.execute("FETCH FORWARD 10 FROM c")] == [20.0]
    engine.run_cycle("big")
    assert len(engine.execute("FETCH FORWARD 10 FROM c")) == 1
    engine.execute("CLOSE c")
    with pytest.raises(CatalogError):
        engine.execute("FETCH 1 FROM c")
    assert len(engine.execute("SUBSCRIBE big AS OF EPOCH 0").fetch(10)) == 2


def test_run_as_stream(spark, tmp_path):
    e = Engine(spark)
    e.execute(DDL + "CREATE STREAM bars AS SELECT symbol, tumble(ts, INTERVAL '5' SECOND) AS ws, SUM(volume) AS v FROM trades GROUP BY symbol, tumble(ts, INTERVAL '5' SECOND) EMIT ON WINDOW CLOSE")
    rows = spark.createDataFrame([("A", 1.0, k, 1000 * k) for k in range(20)], "symbol string, price double, volume long, t long").select("symbol", "price", "volume", F.timestamp_millis("t").alias("ts"))
    from eddyflow.streaming import run

    e.view("bars", str(tmp_path / "v"))
    e.start("bars", run.replay(rows, "ts", 4, str(tmp_path / "in")), checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = {str(r["ws"])[11:]: r["v"] for r in e.view("bars").read().collect()}
    assert got == {"00:00:00": 10, "00:00:05": 35, "00:00:10": 60}
    e.shutdown()


def test_lexer_and_rewrites(spark):
    assert lex.statements("a; -- x;\nb ';' /* ; */") == ["a", "-- x;\nb ';' /* ; */"]
    assert rewrite.split_emit("SELECT 1 EMIT EVERY INTERVAL '5' SECOND").emit == "every 5000 ms"
    assert rewrite.split_with("SELECT 1 WITH ('retain_history' = '64mb')") == ("SELECT 1", {"retain_history": "64mb"})
    assert spark.sql(rewrite.dialect("SELECT array_filter(array(1, 2), 'x > 1') AS a")).first()[0] == [2]
    assert spark.sql(rewrite.qualify("SELECT id FROM range(5) QUALIFY row_number() OVER (ORDER BY id DESC) <= 2")).count() == 2
    with pytest.raises(SqlError):
        lex.tokens("(a")


def test_schemas(spark):
    from pyspark.sql.types import StructType

    old, new = StructType.fromDDL("a INT, b STRING"), StructType.fromDDL("a BIGINT, b STRING, c DOUBLE")
    assert verdict(old, new) == "requires_migration" and verdict(new, old, "forward") == "incompatible"
    assert widened(old, new).simpleString() == "struct<a:bigint,b:string,c:double>"
    h = History("full")
    h.evolve(old)
    with pytest.raises(SchemaError):
        h.evolve(new)
    assert infer_json(spark, ['{"a":1,"b":"x"}', '{"a":1.5,"b":true,"c":null}']).simpleString() == "struct<a:double,b:string,c:string>"
    assert [type_of(t) for t in ("DECIMAL", "NUMERIC(5)", "VARCHAR(10)", "INT[]", "TIMESTAMP")] == ["DECIMAL(38,9)", "DECIMAL(5,0)", "STRING", "ARRAY<INT>", "TIMESTAMP_NTZ"]


def test_formats(spark, tmp_path):
    x = spark.createDataFrame([('{"op":"d","ts_ms":5,"before":{"id":1,"v":"a"},"after":null}',), ('{"op":"c","ts_ms":6,"before":null,"after":{"id":2,"v":"b"}}',)], "m string")
    assert [tuple(r) for r in formats.debezium(x, "m", "id INT, v STRING").collect()] == [(1, "a", "d", 5), (2, "b", "c", 6)]
    y = spark.createDataFrame([('{"r":{"items":[{"a":1,"z":2},{"a":"bad"}]}}',)], "m string")
    got = formats.json(y, "m", "a INT", root="$.r", explode="$.items", unknown="collect").collect()
    assert [(r["a"], r["_rest"]) for r in got] == [(1, '{"z":2}'), (None, "{}")]
    with pytest.raises(Exception, match="unknown fields"):
        formats.json(y, "m", "q INT", unknown="reject").collect()
    mongo = spark.createDataFrame([("ns", "insert", '{"_id":1}', '{"_id":1,"n":2}', 5), ("ns", "delete", '{"_id":1}', None, 6)], "_namespace string, _op string, _document_key string, _full_document string, _wall_time_ms long")
    assert [(r["_id"], r["n"], r["_op"]) for r in formats.mongodb(mongo, "_id INT, n INT").collect()] == [(1, 2, "I"), (1, None, "D")]
    pg = spark.createDataFrame([("t", "D", "0/1", 5, '{"id":1}', None)], "_table string, _op string, _lsn string, _ts_ms long, _before string, _after string")
    assert formats.postgres(pg, "id INT").first()["id"] == 1
    for fmt in ("csv", "json", "parquet"):
        files.write(spark.range(7), f"{tmp_path}/{fmt}", fmt, rows_per_file=3)
        assert files.read(spark, f"{tmp_path}/{fmt}", fmt, "id BIGINT", metadata=True).select("_metadata.file_name").count() == 7
    with pytest.raises(ConnectorError):
        files.read(spark, "x", "xml")
    with pytest.raises(ConnectorError):
        formats.decode(x, "m", "avro")


def test_connectors(spark):
    assert connectors.kafka_options({"brokers": "b:1", "topic": "t", "startup": "earliest"})["startingOffsets"] == "earliest"
    with pytest.raises(ConnectorError):
        connectors.kafka_options({"brokers": "b:1"})
    connectors.register_source("seven", lambda spark, schema, options, streaming: spark.range(7))
    e = Engine(spark)
    e.execute("CREATE SOURCE s7 (id BIGINT) FROM seven (a = 'b'); CREATE SOURCE gen (seq BIGINT, ts_ms BIGINT, value VARCHAR) FROM generator (rows = '5')")
    assert e.sql("SELECT COUNT(*) FROM s7").first()[0] == 7 and e.sql("SELECT * FROM gen").count() == 5
    with pytest.raises(ConnectorError):
        connectors.source(spark, "nowhere", None, {})


def test_retention(spark, tmp_path):
    from eddyflow.streaming.views import Subscription, View

    v = View(spark, str(tmp_path / "v"), retain=2)
    for k in range(4):
        v(spark.range(k, k + 1), k)
    assert v.epochs() == [2, 3]
    assert [r["id"] for r in Subscription(v, as_of=1).fetch(5)] == [2, 3]
    with pytest.raises(StreamError, match="not retained"):
        v.since(0)
