"""Queries through the SQL front end: declared sources, extensions of SELECT, cascades."""

from __future__ import annotations

from eddyflow.engine import Engine
from eddyflow.plans.registry import query, table
from eddyflow.sources import files, formats


def engine(spark, d) -> Engine:
    """An engine with the events as a source, clicks and purchases as streams."""
    e = Engine(spark)
    e.execute(f"""CREATE OR REPLACE SOURCE trades (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR, WATERMARK FOR ts AS ts - INTERVAL '1' HOUR)
      FROM files (path = '{d}/events.parquet', format = 'parquet');
      CREATE STREAM clicks AS SELECT event_id, user_id, ts, value FROM trades WHERE event_type = 'click';
      CREATE STREAM buys AS SELECT event_id, user_id, ts, value FROM trades WHERE event_type = 'purchase'""")
    return e


def front(name: str, ours: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, d):
        return engine(spark, d).execute(ours)


B = "time_bucket(INTERVAL '{0}', ts, TIMESTAMP '1970-01-01')"
DAY = B.format("1 day")
front("API6_tumble", "SELECT event_type, tumble(ts, INTERVAL '1' DAY) AS window_start, COUNT(*) AS n, MAX(value) AS hi FROM trades GROUP BY event_type, tumble(ts, INTERVAL '1' DAY)", f"SELECT event_type, {DAY} AS window_start, count(*) AS n, max(value) AS hi FROM events GROUP BY ALL")
front(
    "API6_emit_on_close",
    "SELECT event_type, window_start, COUNT(*) AS n FROM trades GROUP BY event_type, TUMBLE(ts, INTERVAL '1' DAY) EMIT ON WINDOW CLOSE",
    f"SELECT event_type, w AS window_start, count(*) AS n FROM (SELECT *, {DAY} AS w, (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS wm FROM events) GROUP BY event_type, w, wm HAVING w + INTERVAL 1 DAY <= wm",
)
front("API6_hop", "SELECT HOP(ts, INTERVAL '12' HOUR, INTERVAL '1' DAY) AS window_start, COUNT(*) AS n FROM trades GROUP BY HOP(ts, INTERVAL '12' HOUR, INTERVAL '1' DAY)", f"SELECT b - k * INTERVAL '12 hours' AS window_start, count(*) AS n FROM (SELECT {B.format('12 hours')} AS b, unnest([0, 1]) AS k FROM events) GROUP BY 1")
front("API6_session", "SELECT user_id, COUNT(*) AS burst, SUM(event_id) AS ids FROM trades GROUP BY user_id, SESSION(ts, INTERVAL '6' HOUR)", "SELECT user_id, count(*) AS burst, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, sid")
front("API6_cumulate", "SELECT window_start, window_end, COUNT(*) AS n FROM trades GROUP BY CUMULATE(ts, INTERVAL '6' HOUR, INTERVAL '1' DAY)", f"SELECT b AS window_start, b + k * INTERVAL '6 hours' AS window_end, count(*) AS n FROM (SELECT ts, {DAY} AS b, unnest(generate_series(1, 4)) AS k FROM events) WHERE ts < b + k * INTERVAL '6 hours' GROUP BY ALL")
SIDES = "WITH clicks AS (SELECT * FROM events WHERE event_type = 'click'), buys AS (SELECT * FROM events WHERE event_type = 'purchase') "
front("API6_asof", "SELECT c.event_id, b.event_id AS buy, b.value FROM clicks c ASOF JOIN buys b MATCH_CONDITION(c.ts >= b.ts) ON c.user_id = b.user_id", SIDES + "SELECT c.event_id, b.event_id AS buy, b.value FROM clicks c ASOF LEFT JOIN buys b ON c.user_id = b.user_id AND c.ts >= b.ts")
front("API6_asof_on", "SELECT c.event_id, b.event_id AS buy FROM clicks c ASOF JOIN buys b ON c.user_id = b.user_id AND c.ts <= b.ts WHERE b.event_id IS NOT NULL", SIDES + "SELECT c.event_id, b.event_id AS buy FROM clicks c ASOF JOIN buys b ON c.user_id = b.user_id AND c.ts <= b.ts")
front("API6_probe", "SELECT c.event_id, p.offset_ms, b.event_id AS buy FROM clicks c TEMPORAL PROBE JOIN buys b ON (user_id) TIMESTAMPS (ts, ts) RANGE FROM 0s TO 2h STEP 1h AS p", SIDES + ", q AS (SELECT *, unnest([0, 3600000, 7200000])::BIGINT AS offset_ms FROM clicks) SELECT q.event_id, q.offset_ms, b.event_id AS buy FROM (SELECT *, ts + offset_ms * INTERVAL 1 MILLISECOND AS pt FROM q) q ASOF LEFT JOIN buys b ON q.user_id = b.user_id AND q.pt >= b.ts")
front("API6_system_time", "SELECT c.event_id, v.event_id AS version FROM clicks c LEFT JOIN buys FOR SYSTEM_TIME AS OF c.ts AS v ON c.user_id = v.user_id", SIDES + "SELECT c.event_id, b.event_id AS version FROM clicks c ASOF LEFT JOIN buys b ON c.user_id = b.user_id AND c.ts >= b.ts")
front("API6_interval", "SELECT c.event_id, b.event_id AS buy FROM clicks c INNER JOIN buys b ON c.user_id = b.user_id AND b.ts BETWEEN c.ts AND c.ts + INTERVAL '6' HOUR", SIDES + "SELECT c.event_id, b.event_id AS buy FROM clicks c JOIN buys b ON c.user_id = b.user_id AND b.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR")
front("API6_qualify", "SELECT user_id, event_id, value FROM trades QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")
front("API6_date_bin", "SELECT date_bin(INTERVAL '15 minutes', ts) AS bin, approx_distinct(event_type) >= 1 AS some, COUNT(*) AS n FROM trades GROUP BY date_bin(INTERVAL '15 minutes', ts)", f"SELECT {B.format('15 minutes')} AS bin, true AS some, count(*) AS n FROM events GROUP BY ALL")
front("API6_json_operators", "SELECT event_id, props->>'k' AS k FROM trades", "SELECT event_id, props->>'$.k' AS k FROM events")
front("API6_string_lambdas", "SELECT event_id, array_join(array_transform(array(1, 2, 3), 'x * 2'), ',') AS a, array_reduce(array(1, 2, 3), 0, 'acc + x') AS b FROM trades", "SELECT event_id, '2,4,6' AS a, CAST(6 AS INT) AS b FROM events")


@query("API6_cascade", f"WITH h AS (SELECT user_id, {B.format('1 hour')} AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, CAST(max(n) AS BIGINT) AS busiest FROM h GROUP BY user_id")
def cascade(spark, d):
    """A view over a stream over a source."""
    e = engine(spark, d)
    e.execute("""CREATE STREAM hourly AS SELECT user_id, tumble(ts, INTERVAL '1' HOUR) AS hour, COUNT(*) AS n FROM trades GROUP BY user_id, tumble(ts, INTERVAL '1' HOUR);
      CREATE MATERIALIZED VIEW busiest AS SELECT user_id, MAX(n) AS busiest FROM hourly GROUP BY user_id""")
    return e.sql("SELECT * FROM busiest")


@query("API1_insert_upsert", "SELECT * FROM (VALUES (1, 'a2'), (2, 'b'), (3, 'c')) t(id, name)")
def insert_upsert(spark, d):
    e = Engine(spark)
    e.execute("CREATE TABLE dims (id INT PRIMARY KEY, name VARCHAR); INSERT INTO dims VALUES (1, 'a'), (2, 'b'); INSERT INTO dims VALUES (1, 'a2'), (3, 'c')")
    return e.sql("SELECT * FROM dims")


@query("API6_lookup_table", "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def lookup_table(spark, d):
    e = engine(spark, d)
    e.execute(f"CREATE LOOKUP TABLE dim (c_custkey BIGINT, c_name VARCHAR, PRIMARY KEY (c_custkey)) FROM files (path = '{d}/customer.parquet', format = 'parquet')")
    return e.sql("SELECT t.event_id, c.c_name FROM trades t JOIN dim c ON t.user_id = c.c_custkey")


@query("API6_show_sources", "SELECT * FROM (VALUES ('trades', 'files', 'ts')) t(name, connector, watermark)")
def show_sources(spark, d):
    return engine(spark, d).execute("SHOW SOURCES").select("name", "connector", "watermark")


# ---------------------------------------------------------------- sources, sinks, formats
@query("S05_generator", "SELECT i AS seq, 1000 + i * 10 AS ts_ms, 'value-' || i AS value FROM generate_series(0, 99) t(i)")
def generator(spark, d):
    return files.generator(spark, 100, start_ms=1000, step_ms=10)


@query("S17_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200 AND o_totalprice > 1000")
def pushdown(spark, d):
    return files.read(spark, f"{d}/orders.parquet", "parquet").filter("o_orderkey BETWEEN 100 AND 200 AND o_totalprice > 1000").select("o_orderkey", "o_totalprice")


def round_trip(name: str, fmt: str, sql: str, **options) -> None:
    @query(name, sql)
    def run(spark, d):
        from eddyflow.streaming.run import scratch

        folder = scratch(spark)
        df = table(spark, d, "nation")
        files.write(df, folder, fmt, mode="overwrite", **options)
        if fmt == "arrow":
            return files.read_arrow64(spark, folder, "n_nationkey INT, n_name STRING, n_regionkey INT")
        return files.read(spark, folder, fmt, df.schema, **{k: v for k, v in options.items() if k in ("header", "delimiter")})


for _name, _fmt, _options in (("S04_csv", "csv", {"header": "true"}), ("S04_tsv", "tsv", {"header": "true"}), ("S04_json", "json", {}), ("S04_parquet", "parquet", {}), ("S04_orc", "orc", {}), ("F05_arrow", "arrow", {}), ("K02_rolling_files", "parquet", {"rows_per_file": 5})):
    round_trip(_name, _fmt, "SELECT n_nationkey, n_name, n_regionkey FROM nation", **_options)


@query("F01_json_decode", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_decode(spark, d):
    return formats.json(table(spark, d, "events").select("event_id", "props"), "props", "k BIGINT")


@query("F02_csv_decode", "SELECT event_id, user_id AS u, event_type AS t FROM events")
def csv_decode(spark, d):
    lines = table(spark, d, "events").selectExpr("event_id", "concat_ws(';', user_id, event_type) AS line")
    return formats.csv(lines, "line", "u BIGINT, t STRING", delimiter=";")


@query("F07_debezium", "SELECT o_orderkey AS id, o_totalprice AS v, CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 'u' END AS __op, o_orderkey * 10 AS __ts_ms FROM orders")
def debezium(spark, d):
    x = table(spark, d, "orders").selectExpr("""to_json(named_struct('op', IF(o_orderkey % 3 = 0, 'd', 'u'), 'ts_ms', o_orderkey * 10, 'before', named_struct('id', o_orderkey, 'v', o_totalprice), 'after', IF(o_orderkey % 3 = 0, NULL, named_struct('id', o_orderkey, 'v', o_totalprice)))) AS m""")
    return formats.debezium(x, "m", "id BIGINT, v DOUBLE")


@query("S09_otel_logs", "SELECT event_type AS body, ts AS time FROM events")
def otel_logs(spark, d):
    x = table(spark, d, "events").selectExpr("to_json(named_struct('timeUnixNano', CAST(unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS STRING), 'body', event_type)) AS m")
    return formats.otel(x, "m", "logs").select("body", "time")


@query("K09_sink_filter", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50")
def sink_filter(spark, d):
    from eddyflow.streaming.run import scratch

    folder = scratch(spark)
    e = engine(spark, d)
    e.execute(f"CREATE SINK out FROM clicks WHERE value > 50 INTO files (path = '{folder}', format = 'parquet')")
    e.flush("out")
    return spark.read.parquet(folder).select("event_id", "value")
