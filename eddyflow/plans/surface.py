"""Windows as tables, processing time, watermarks through operators, recovery and the engine's calls, each against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.engine import Engine, open_engine
from eddyflow.errors import EngineError
from eddyflow.operators import windows as w
from eddyflow.plans.front import B, DAY, engine, front
from eddyflow.plans.registry import query, table
from eddyflow.plans.streams import stream
from eddyflow.streaming import recovery, run, views
from eddyflow.streaming.run import scratch

c = F.col
SPANS = {"TUMBLE": "TUMBLE(trades, ts, INTERVAL '12' HOUR)", "HOP": "HOP(trades, ts, INTERVAL '6' HOUR, INTERVAL '1' DAY)", "CUMULATE": "CUMULATE(trades, ts, INTERVAL '6' HOUR, INTERVAL '1' DAY)"}
GROUPS = "SELECT window_start, window_end, event_type, COUNT(*) AS n, MAX(value) AS hi FROM {} GROUP BY window_start, window_end, event_type"

# ---------------------------------------------------------------- windows as tables
front("W13_tumble_in_from", GROUPS.format(SPANS["TUMBLE"]), GROUPS.format(f"(SELECT *, {B.format('12 hours')} AS window_start, window_start + INTERVAL '12 hours' AS window_end FROM events)"))
front("W13_hop_in_from", GROUPS.format(SPANS["HOP"]), GROUPS.format(f"(SELECT * EXCLUDE (b, k), b - k * INTERVAL '6 hours' AS window_start, b - k * INTERVAL '6 hours' + INTERVAL '1 day' AS window_end FROM (SELECT *, {B.format('6 hours')} AS b, unnest([0, 1, 2, 3]) AS k FROM events))"))
front("W13_cumulate_in_from", GROUPS.format(SPANS["CUMULATE"]), GROUPS.format(f"(SELECT * EXCLUDE (b, k), b AS window_start, b + k * INTERVAL '6 hours' AS window_end FROM (SELECT *, {DAY} AS b, unnest(generate_series(1, 4)) AS k FROM events) WHERE ts < b + k * INTERVAL '6 hours')"))
front(
    "W13_closed_in_from",
    "SELECT t.window_end, COUNT(*) AS n FROM TUMBLE(trades, ts, INTERVAL '1' DAY) t WHERE t.value > 10 GROUP BY t.window_end EMIT ON WINDOW CLOSE",
    f"SELECT {DAY} + INTERVAL '1 day' AS window_end, count(*) AS n FROM events WHERE value > 10 GROUP BY 1 HAVING {DAY} + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)".replace("GROUP BY 1 HAVING", f"GROUP BY {DAY} HAVING"),
)


# ---------------------------------------------------------------- time and watermarks
@query("ST04_proctime", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS late FROM events")
def proctime(spark, d):
    """A source in processing time has no late rows: the older half comes last, and stays."""
    e, x = Engine(spark), table(spark, d, "events").select("event_id", "ts")
    e.execute("CREATE SOURCE pt (event_id BIGINT, ts TIMESTAMP, WATERMARK FOR ts AS PROCTIME())")
    us = F.unix_micros(c("ts").cast("timestamp"))
    lo, hi = x.agg(F.min(us), F.max(us)).first()
    for half in (us >= (lo + hi) // 2, us < (lo + hi) // 2):
        e.insert("pt", x.filter(half))
    return e.sql("SELECT COUNT(*) AS n, SUM(event_id) AS ids FROM pt").withColumn("late", F.lit(e.metrics["pt"]["late"]).cast("long"))


@query(
    "ST06_propagated_watermark",
    """WITH h AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS half FROM events), k AS (SELECT events.* FROM events, h WHERE event_id % 2 = 0 OR epoch_us(ts) < half),
    m AS (SELECT least(max(ts) FILTER (WHERE event_id % 2 = 0), max(ts) FILTER (WHERE event_id % 2 = 1)) - INTERVAL '1 hour' AS wm FROM k), hourly AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM k GROUP BY ALL)
    SELECT date_trunc('day', hour)::TIMESTAMP AS window_start, max(n) AS busiest, CAST(sum(n) AS BIGINT) AS n FROM hourly, m GROUP BY date_trunc('day', hour), wm HAVING date_trunc('day', hour) + INTERVAL '1 day' <= wm""",
)
def propagated_watermark(spark, d):
    """Two inputs, windows, and windows of those: every operator waits for the slower input."""
    x = table(spark, d, "events").select("event_id", "ts")
    us = F.unix_micros(c("ts").cast("timestamp"))
    lo, hi = x.agg(F.min(us), F.max(us)).first()
    side = lambda rows: run.with_watermark(run.replay(rows, "ts", 4, scratch(spark) + "/in"), "ts", "1 hour")
    both = side(x.filter("event_id % 2 = 0")).unionAll(side(x.filter("event_id % 2 = 1").filter(us < lo + (hi - lo) // 2)))
    hourly = both.groupBy(w.tumble("ts", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    daily = hourly.groupBy(F.window(F.window_time("hour"), "1 day").alias("window")).agg(F.max("n").alias("busiest"), F.sum("n").alias("n"))
    return run.drain(daily.select(w.bounds()[0], "busiest", "n"))


@query("W10_incremental_on_close", f"WITH m AS (SELECT max(ts) - INTERVAL '1 hour' AS wm FROM events) SELECT event_type, {DAY} AS window_start, count(*) AS n, max(value) - min(value) AS spread FROM events, m GROUP BY event_type, {DAY}, wm HAVING {DAY} + INTERVAL '1 day' <= wm AND count(*) > 1")
def incremental_on_close(spark, d):
    """A declared stream over four micro-batches: every closed window comes once, with a condition and arithmetic over its aggregates."""
    e = Engine(spark)
    e.execute("""CREATE SOURCE ev (event_type VARCHAR, ts TIMESTAMP, value DOUBLE, WATERMARK FOR ts AS ts - INTERVAL '1' HOUR);
      CREATE STREAM daily AS SELECT event_type, TUMBLE(ts, INTERVAL '1' DAY) AS window_start, COUNT(*) AS n, MAX(value) - MIN(value) AS spread FROM ev
        GROUP BY event_type, TUMBLE(ts, INTERVAL '1' DAY) HAVING COUNT(*) > 1 EMIT ON WINDOW CLOSE""")
    e.start("daily", stream(spark, d, columns=["event_type", "ts", "value"]), checkpoint=scratch(spark)).awaitTermination()
    return e.view("daily").read()


# ---------------------------------------------------------------- recovery
@query("ST14_fall_back", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(1 AS INT) AS kept FROM events GROUP BY event_type")
def fall_back(spark, d):
    """The commits of the last two of four epochs are damaged: the query falls back to the second and counts every event once."""
    folder = scratch(spark)
    view = views.View(spark, f"{folder}/view")
    x = stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    again = lambda: run.start(x, mode="update", sink=view, available=True, checkpoint=f"{folder}/cp").awaitTermination()
    again()
    log = recovery.Log(spark, f"{folder}/cp/commits")
    for epoch in log.epochs()[2:]:
        log.fs.create(log.file(epoch), True).close()
    kept = recovery.fall_back(spark, f"{folder}/cp", view=view)
    again()
    return view.since(-1).groupBy("event_type").agg(F.max_by("n", "epoch").alias("n"), F.max_by("ids", "epoch").alias("ids")).withColumn("kept", F.lit(kept))


# ---------------------------------------------------------------- the engine's calls
@query("API2_connection", "SELECT * FROM (VALUES ('trades', 'source', ''), ('clicks', 'stream', 'trades'), ('buys', 'stream', 'trades'), ('per_user', 'view', 'clicks')) t(name, kind, inputs)")
def connection(spark, d):
    """What a catalog lists, and how its objects hang together."""
    e = engine(spark, d)
    e.execute("CREATE MATERIALIZED VIEW per_user AS SELECT user_id, COUNT(*) AS n FROM clicks GROUP BY user_id")
    return spark.createDataFrame([(n, k, ",".join(i)) for n, k, i in e.topology()], "name string, kind string, inputs string")


@query("API7_open_insert_sql", "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def open_insert_sql(spark, d):
    """Open, declare, insert rows of Python, query, shut down."""
    e = open_engine(spark)
    e.execute("CREATE SOURCE places (n_name VARCHAR, n_regionkey BIGINT)")
    e.insert("places", [(r.n_name, r.n_regionkey) for r in table(spark, d, "nation").select("n_name", "n_regionkey").toLocalIterator()])
    out = e.sql("SELECT n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM places GROUP BY n_regionkey")
    e.shutdown()
    return out


#: Statements that are refused, and the code of each refusal.
REFUSED = {
    "CREATE STREAM s AS SELECT event_id FROM trades ORDER BY ts": "EF-2000",
    "DROP SOURCE missing": "EF-2100",
    "SELECT COUNT(*) AS n FROM trades GROUP BY HOP(ts, INTERVAL '2' DAY, INTERVAL '1' DAY)": "EF-3000",
    "SELECT COUNT(*) AS n FROM trades EMIT ON WINDOW CLOSE": "EF-3000",
    "CREATE STREAM s AS SELECT a.event_id FROM clicks a CROSS JOIN buys b": "EF-4000",
    "SELECT c.event_id FROM clicks c ASOF JOIN buys b ON c.user_id = b.user_id AND c.ts > b.ts": "EF-4000",
    "CREATE SOURCE s (a BIGINT) FROM nowhere": "EF-7000",
    "RESTORE FROM CHECKPOINT 1": "EF-8000",
}


@query("API10_error_codes", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(s.replace("'", "''"), code) for s, code in REFUSED.items()) + ") t(statement, code)")
def error_codes(spark, d):
    e, got = engine(spark, d), []
    for statement in REFUSED:
        try:
            e.execute(statement)
            got.append((statement, "none"))
        except EngineError as error:
            got.append((statement, error.code))
    return spark.createDataFrame(got, "statement string, code string")
