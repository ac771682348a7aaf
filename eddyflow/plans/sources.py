"""Sources, sinks, emit modes and the engine's surface, each held against SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.engine import Engine
from eddyflow.functions import ai
from eddyflow.operators import windows as w
from eddyflow.plans.front import engine
from eddyflow.plans.registry import query, table, text
from eddyflow.plans.streams import stream
from eddyflow.sources import connectors, files, formats, lake
from eddyflow.streaming import run, stateful, views
from eddyflow.streaming.run import scratch

c = F.col
text("TM03_now", "SELECT count(*) AS n FROM $events WHERE ts < now()", "SELECT count(*) AS n FROM $events WHERE ts < now()::TIMESTAMP")
text("U05_union_of_slices", "SELECT event_id FROM (SELECT * FROM $events WHERE user_id % 2 = 0 UNION ALL SELECT * FROM $events WHERE user_id % 2 = 1) t WHERE value > 50")
text("F04_parquet_pruning", "SELECT l_orderkey, l_tax FROM $lineitem WHERE l_orderkey < 50")


@query("S01_push", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def push(spark, d):
    """Rows pushed into a declared source."""
    e = Engine(spark)
    e.execute("CREATE SOURCE pushed (event_id BIGINT, event_type VARCHAR)")
    e.insert("pushed", table(spark, d, "events").select("event_id", "event_type"))
    return e.sql("SELECT event_type, COUNT(*) AS n FROM pushed GROUP BY event_type")


@query("S02_live_scan", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def live_scan(spark, d):
    """A view over a source sees rows that come after it was made."""
    e = Engine(spark)
    e.execute("CREATE SOURCE live (event_id BIGINT); CREATE STREAM counted AS SELECT COUNT(*) AS n, SUM(event_id) AS ids FROM live")
    for k in range(3):
        e.insert("live", table(spark, d, "events").filter(c("event_id") % 3 == k).select("event_id"))
    return e.sql("SELECT n, ids FROM counted")


@query("S03_stream_scan", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE value > 10")
def stream_scan(spark, d):
    return run.drain(stream(spark, d).filter("value > 10").select("event_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("S10_postgres_cdc", "SELECT o_orderkey AS id, o_totalprice AS v, CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'U' END AS _op FROM orders")
def postgres_cdc(spark, d):
    row = F.to_json(F.struct(c("o_orderkey").alias("id"), c("o_totalprice").alias("v")))
    gone = c("o_orderkey") % 3 == 0
    feed = table(spark, d, "orders").select(F.lit("orders").alias("_table"), F.when(gone, "D").otherwise("U").alias("_op"), F.lit("0/1").alias("_lsn"), F.lit(1).cast("long").alias("_ts_ms"), F.when(gone, row).alias("_before"), F.when(~gone, row).alias("_after"))
    return formats.postgres(feed, "id BIGINT, v DOUBLE").select("id", "v", "_op")


@query("S11_mysql_cdc", "SELECT o_orderkey, o_totalprice, 'I' AS _op, o_orderkey AS _binlog_pos FROM orders")
def mysql_cdc(spark, d):
    feed = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("orders").alias("_table"), F.lit("I").alias("_op"), F.lit(1).cast("long").alias("_ts_ms"), F.lit("bin.1").alias("_binlog_file"), c("o_orderkey").alias("_binlog_pos"), F.lit("g").alias("_gtid"))
    return formats.mysql(feed, "o_orderkey BIGINT, o_totalprice DOUBLE").select("o_orderkey", "o_totalprice", "_op", "_binlog_pos")


@query("S12_mongodb_cdc", "SELECT c_custkey AS _id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END AS _op FROM customer")
def mongodb_cdc(spark, d):
    k = c("c_custkey") % 4
    op = F.when(k == 0, "delete").when(k == 1, "insert").when(k == 2, "update").otherwise("replace")
    feed = table(spark, d, "customer").select(F.lit("db.c").alias("_namespace"), op.alias("_op"), F.to_json(F.struct(c("c_custkey").alias("_id"))).alias("_document_key"), F.lit(1).cast("long").alias("_wall_time_ms"), F.when(k != 0, F.to_json(F.struct(c("c_custkey").alias("_id"), c("c_name").alias("name")))).alias("_full_document"))
    return formats.mongodb(feed, "_id BIGINT, name STRING").select("_id", "name", "_op")


@query("S16_lookup_source", "SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def lookup_source(spark, d):
    connectors.register_source("customers", lambda s, schema, options, streaming: table(s, d, "customer").select("c_custkey", "c_name"))
    e = engine(spark, d)
    e.execute("CREATE LOOKUP TABLE people (c_custkey BIGINT, c_name VARCHAR, PRIMARY KEY (c_custkey)) FROM customers (strategy = 'on_demand')")
    return e.sql("SELECT t.event_id, p.c_name FROM trades t LEFT JOIN people p ON t.user_id = p.c_custkey")


@query("S18_snapshot_of_view", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 10")
def snapshot_of_view(spark, d):
    e = engine(spark, d)
    e.execute("CREATE MATERIALIZED VIEW kinds AS SELECT event_type, COUNT(*) AS n FROM trades GROUP BY event_type")
    return e.sql("SELECT * FROM kinds WHERE n > 10")


@query("K01_subscription", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 90")
def subscription(spark, d):
    """Rows of a stream's first epoch, through a subscription with a filter."""
    e = engine(spark, d)
    e.run_cycle("clicks")
    return e.subscribe("clicks", "value > 90").frame().select("event_id")


@query("K11_idempotent_epochs", "SELECT count(*) AS n FROM events")
def idempotent_epochs(spark, d):
    """A batch that comes twice is written once."""
    view = views.View(spark, scratch(spark))
    for epoch in (0, 1, 1):
        view(table(spark, d, "events").filter(c("event_id") % 2 == epoch), epoch)
    return view.read().agg(F.count(F.lit(1)).alias("n"))


@query("F06_text_raw", "SELECT n_name AS value, octet_length(n_name::BLOB) AS size FROM nation")
def text_raw(spark, d):
    folder = scratch(spark)
    files.write(table(spark, d, "nation").select("n_name"), folder, "text", mode="overwrite")
    lines = files.read(spark, folder, "text")
    return formats.raw(lines.withColumn("m", c("value")), "m").select("value", F.octet_length("payload").cast("long").alias("size"))


@query("F08_format_registry", "SELECT event_id, user_id AS u FROM events")
def format_registry(spark, d):
    x = table(spark, d, "events").select("event_id", F.to_json(F.struct(c("user_id").alias("u"))).alias("m"))
    return formats.decode(x, "m", "json", "u BIGINT")


@query("E01_running_state", "SELECT event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY event_type")
def running_state(spark, d):
    """No emit clause: running groups, of which the last state counts."""
    got = run.drain(stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi")), mode=run.output_mode(None))
    return got.groupBy("event_type").agg(F.max("n").alias("n"), F.max("hi").alias("hi"))


@query("E04_every", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def every(spark, d):
    """Running groups, emitted at each turn of a clock; each group's last state counts all its rows."""
    folder = scratch(spark)
    view = views.View(spark, f"{folder}/view")
    x = stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    q = run.start(x, emit="every interval '200 milliseconds'", sink=view, checkpoint=f"{folder}/cp")
    q.processAllAvailable()
    q.stop()
    return view.since(-1).groupBy("event_type").agg(F.max_by("n", "epoch").alias("n"), F.max_by("total", "epoch").alias("total"))


@query("E06_final", "SELECT event_type, w AS window_start, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS wm FROM events) GROUP BY event_type, w, wm HAVING w + INTERVAL 1 DAY <= wm")
def final(spark, d):
    return engine(spark, d).sql("SELECT event_type, window_start, COUNT(*) AS n FROM trades GROUP BY event_type, TUMBLE(ts, INTERVAL '1' DAY) EMIT FINAL")


@query("L04_watermark_sort", "SELECT bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) - 1 AS INT) AS place, event_id FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS bucket FROM events) WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def watermark_sort(spark, d):
    e = run.with_watermark(stream(spark, d), "ts", "1 hour")
    return run.drain(stateful.in_order(e, "ts", "1 day", ["event_id"])).select("bucket", "place", "event_id")


@query("P06_stream_temporal_filter", """WITH x AS (SELECT event_id, CAST(ceil((epoch_us(ts) // 1000 + 86400000) / 1000.0) * 1000 AS BIGINT) AS leaves FROM events), m AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS wm FROM events)
    SELECT event_id, CAST(1 AS BIGINT) AS weight FROM x UNION ALL SELECT event_id, -1 FROM x, m WHERE leaves < wm""")
def stream_temporal_filter(spark, d):
    """Each event enters once; each that the watermark has passed by a day is retracted."""
    e = run.with_watermark(stream(spark, d).select("event_id", "ts"), "ts", "1 hour")
    return run.drain(stateful.temporal_filter(e, "event_id", "ts", "1 day")).select("event_id", c("__weight").alias("weight"))


@query("ST09_late_in_window", "SELECT count(*) AS n FROM events WHERE event_id % 2 = 0")
def late_in_window(spark, d):
    """Rows that come after their window has closed are not counted in it."""
    folder, e = scratch(spark), table(spark, d, "events")
    old = e.filter("event_id % 2 = 1").withColumn("ts", c("ts") - F.expr("INTERVAL 400 DAYS"))
    for part in (e.filter("event_id % 2 = 0"), e.filter("event_id < 0"), old):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    x = run.with_watermark(run.file_stream(spark, f"{folder}/in", e.schema), "ts", "1 hour").groupBy(w.tumble("ts", "1 day").alias("window")).agg(F.count(F.lit(1)).alias("n"))
    got = run.drain(x, mode="update")
    return got.groupBy("window").agg(F.max("n").alias("n")).agg(F.sum("n").alias("n"))


@query("ST12_rate_limit", "SELECT CAST(4 AS BIGINT) AS epochs, (SELECT count(*) FROM events) AS n")
def rate_limit(spark, d):
    """One file in a micro-batch: as many epochs as files."""
    folder = scratch(spark)
    view = views.View(spark, f"{folder}/view")
    run.start(stream(spark, d), mode="append", sink=view, available=True, checkpoint=f"{folder}/cp").awaitTermination()
    return view.since(-1).agg(F.countDistinct("epoch").alias("epochs"), F.count(F.lit(1)).alias("n"))


@query("ST17_cursor", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def cursor(spark, d):
    e = engine(spark, d)
    e.run_cycle("buys")
    e.execute("DECLARE c CURSOR FOR SUBSCRIBE buys")
    rows = e.execute("FETCH ALL FROM c")
    e.execute("CLOSE c")
    return rows.select("event_id")


@query("ST18_hot_add_drop", "SELECT event_id FROM events WHERE value > 50")
def hot_add_drop(spark, d):
    """While one stream runs another is added, and the first dropped; the second goes on."""
    e = Engine(spark)
    e.execute("CREATE SOURCE ev (event_id BIGINT, event_type VARCHAR, value DOUBLE); CREATE STREAM first AS SELECT event_id FROM ev WHERE event_type = 'click'")
    source = lambda: stream(spark, d, columns=["event_id", "event_type", "value", "ts"]).select("event_id", "event_type", "value")
    e.start("first", source(), available=False, checkpoint=scratch(spark))
    e.execute("CREATE STREAM second AS SELECT event_id FROM ev WHERE value > 50")
    e.start("second", source(), available=False, checkpoint=scratch(spark))
    e.execute("DROP STREAM first")
    e.checkpoint()
    assert list(e.running) == ["second"]
    e.shutdown()
    return e.view("second").read()


@query("UD3_custom_connector", "SELECT i AS id, i * 2 AS twice FROM generate_series(0, 49) t(i)")
def custom_connector(spark, d):
    connectors.register_source("numbers", lambda s, schema, options, streaming: s.range(int(options["n"])).selectExpr("id", "id * 2 AS twice"))
    e = Engine(spark)
    e.execute("CREATE SOURCE numbers (id BIGINT, twice BIGINT) FROM numbers (n = '50')")
    return e.sql("SELECT * FROM numbers")


@query("AI04_pluggable", "SELECT event_id, upper(event_type) AS said FROM events")
def pluggable(spark, d):
    ai.register("complete", lambda t, **_: t.upper(), "string")
    return ai.infer(table(spark, d, "events"), "complete", "event_type", "said").select("event_id", "said")


@query("API9_metrics", """WITH m AS (SELECT max(ts) FILTER (WHERE event_id % 2 = 0) - INTERVAL '1 hour' AS wm FROM events) SELECT count(*) FILTER (WHERE event_id % 2 = 0 OR (event_id % 5 > 0 AND ts >= wm)) AS n_rows, count(*) FILTER (WHERE event_id % 2 = 1 AND event_id % 5 > 0 AND ts < wm) AS late, count(*) FILTER (WHERE event_id % 2 = 1 AND event_id % 5 = 0) AS null_time FROM events, m""")
def metrics(spark, d):
    """What a source counts: rows taken, late ones and those without a time; odd events come after even ones, every fifth of them timeless."""
    e, x = Engine(spark), table(spark, d, "events").select("event_id", "ts")
    e.execute("CREATE SOURCE m (event_id BIGINT, ts TIMESTAMP, WATERMARK FOR ts AS ts - INTERVAL '1' HOUR)")
    e.insert("m", x.filter("event_id % 2 = 0"))
    e.insert("m", x.filter("event_id % 2 = 1").withColumn("ts", F.when(c("event_id") % 5 > 0, c("ts"))))
    got = e.metrics["m"]
    return spark.createDataFrame([(got["rows"], got["late"], got["null_time"])], "n_rows long, late long, null_time long")


# ---------------------------------------------------------------- watermarks of declared sources
DAY = "time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')"
CLOSED = f"SELECT event_type, {DAY} AS window_start, count(*) AS n FROM events, m GROUP BY event_type, {DAY}, wm HAVING {DAY} + INTERVAL '1 day' <= wm"
DAYS = "SELECT event_type, window_start, COUNT(*) AS n FROM {} GROUP BY event_type, TUMBLE(ts, INTERVAL '1' DAY) EMIT ON WINDOW CLOSE"


def declared(spark, *sources: str) -> Engine:
    """An engine with sources (name, watermark and options) of the events' columns."""
    e = Engine(spark)
    for s in sources:
        name, _, tail = s.partition(" ")
        mark, _, options = tail.partition(" WITH ")
        e.execute(f"CREATE SOURCE {name} (event_id BIGINT, event_type VARCHAR, ts TIMESTAMP, WATERMARK FOR ts AS {mark})" + (f" WITH {options}" if options else ""))
    return e


def events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "ts")


@query("ST02_skew_guard", "WITH m AS (SELECT max(ts) - INTERVAL '1 hour' AS wm FROM events) " + CLOSED)
def skew_guard(spark, d):
    """An event far ahead of the clock does not close the windows of the others."""
    e = declared(spark, "ev ts - INTERVAL '1' HOUR")
    e.insert("ev", spark.sql("SELECT -1L AS event_id, 'far' AS event_type, TIMESTAMP_NTZ '2999-01-01 00:00:00' AS ts"))
    e.insert("ev", events(spark, d))
    return e.sql(DAYS.format("ev"))


@query("ST03_ascending", "WITH m AS (SELECT max(ts) AS wm FROM events) " + CLOSED)
def ascending(spark, d):
    """Event times that never go back: the watermark is the last of them."""
    e = declared(spark, "ev ts")
    e.insert("ev", events(spark, d))
    return e.sql(DAYS.format("ev"))


@query("ST03_source_provided", "WITH m AS (SELECT max(ts) + INTERVAL '2 days' AS wm FROM events) " + CLOSED)
def source_provided(spark, d):
    """The source says how far it has come."""
    e = declared(spark, "ev ts - INTERVAL '1' HOUR")
    e.insert("ev", events(spark, d))
    e.advance("ev", int(events(spark, d).agg(F.max(F.unix_micros(c("ts").cast("timestamp")))).first()[0]) + 2 * 86_400_000_000)
    return e.sql(DAYS.format("ev"))


@query("ST05_slowest_source", "WITH h AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half FROM events), k AS (SELECT events.* FROM events, h WHERE event_id % 2 = 0 OR ts < half), m AS (SELECT least(max(ts) FILTER (WHERE event_id % 2 = 0), max(ts) FILTER (WHERE event_id % 2 = 1)) - INTERVAL '1 hour' AS wm FROM k) " + CLOSED.replace("FROM events, m", "FROM k, m"))
def slowest_source(spark, d):
    """Of two sources the one that has come less far holds the windows open."""
    e, x = declared(spark, "a ts - INTERVAL '1' HOUR", "b ts - INTERVAL '1' HOUR"), events(spark, d)
    e.execute("CREATE STREAM both AS SELECT * FROM a UNION ALL SELECT * FROM b")
    us = F.unix_micros(c("ts").cast("timestamp"))
    lo, hi = x.agg(F.min(us), F.max(us)).first()
    e.insert("a", x.filter("event_id % 2 = 0"))
    e.insert("b", x.filter("event_id % 2 = 1").filter(us < lo + (hi - lo) // 2))
    return e.sql(DAYS.format("both"))


@query("ST05_idle_source", "WITH m AS (SELECT max(ts) - INTERVAL '1 hour' AS wm FROM events) " + CLOSED)
def idle_source(spark, d):
    """A source that gets no rows, and may be idle, holds nothing open."""
    e = declared(spark, "a ts - INTERVAL '1' HOUR", "b ts - INTERVAL '1' HOUR WITH (idle_timeout = '1 second')")
    e.execute("CREATE STREAM both AS SELECT * FROM a UNION ALL SELECT * FROM b")
    e.insert("a", events(spark, d))
    return e.sql(DAYS.format("both"))


# ---------------------------------------------------------------- versioned tables
def thirds(spark, d) -> lake.LakeTable:
    """The events in three commits."""
    t = lake.LakeTable(spark, scratch(spark))
    for k in range(3):
        t.append(table(spark, d, "events").filter(c("event_id") % 3 == k).select("event_id", "value"))
    return t


@query("S13_lake_snapshot", "SELECT event_id, value FROM events WHERE event_id % 3 < 2")
def lake_snapshot(spark, d):
    """A table as of its second version."""
    return connectors.source(spark, "lake", None, {"path": thirds(spark, d).path, "version": "2"})


@query("S13_lake_incremental", "SELECT event_id, value, CAST(event_id % 3 + 1 AS INT) AS version FROM events WHERE event_id % 3 > 0")
def lake_incremental(spark, d):
    """What came after the first version."""
    got = connectors.source(spark, "lake", None, {"path": thirds(spark, d).path, "after": "1"})
    return got.select("event_id", "value", c("_version").alias("version"))


@query("K05_lake_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey - 1, 0 FROM orders WHERE o_orderkey % 11 = 0")
def lake_merge(spark, d):
    """Updates, deletes and new rows merged by key; of two changes of a key the later one counts."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    t = lake.LakeTable(spark, scratch(spark), ["o_orderkey"])
    t.append(rows)
    change = lambda where, key, price, op, n: rows.filter(where).select(key.alias("o_orderkey"), price.cast("double").alias("o_totalprice"), F.lit(op).alias("_op"), F.lit(n).alias("n"))
    k, price = c("o_orderkey"), c("o_totalprice")
    new = change("o_orderkey % 5 = 0", k, price + 1, "U", 1).unionAll(change("o_orderkey % 7 = 0", k, price, "D", 2)).unionAll(change("o_orderkey % 11 = 0", -k - 1, F.lit(0), "I", 1))
    t.merge(new, order="n")
    t.compact()
    return t.read().select("o_orderkey", "o_totalprice")


@query("K05_lake_exactly_once", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def lake_exactly_once(spark, d):
    """A continuous query into a table; a batch that comes again, and one that was never committed, leave nothing."""
    t, folder = lake.LakeTable(spark, scratch(spark)), scratch(spark)
    sink = t.sink("events")
    run.start(stream(spark, d).select("event_id"), mode="append", sink=sink, available=True, checkpoint=f"{folder}/cp").awaitTermination()
    sink(table(spark, d, "events").select("event_id"), 0)
    t.prepare(table(spark, d, "events").select("event_id"))
    return t.read().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))
