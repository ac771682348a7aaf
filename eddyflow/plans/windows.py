"""Event-time windows and emit modes on batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.operators import windows as w
from eddyflow.plans.registry import query, table

SUMS = [("count(*)", "n"), ("round(sum(value), 4)", "total")]


def sums():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


@query(
    "W01_tumble",
    """SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS window_end,
    count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL""",
)
def tumble(spark, d):
    more = [F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    return w.aggregate(table(spark, d, "events"), w.tumble("ts", "1 day"), ["event_type"], sums() + more)


@query(
    "W01_tumble_offset",
    """SELECT time_bucket(INTERVAL '6 hours', ts - INTERVAL '90 minutes', TIMESTAMP '1970-01-01') + INTERVAL '90 minutes' AS window_start, time_bucket(INTERVAL '6 hours', ts - INTERVAL '90 minutes', TIMESTAMP '1970-01-01') + INTERVAL '450 minutes' AS window_end,
    count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def tumble_offset(spark, d):
    return w.aggregate(table(spark, d, "events"), w.tumble("ts", "6 hours", "90 minutes"), [], sums())


HOP = """WITH x AS (SELECT *, unnest([0, 1, 2, 3]) AS k, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b FROM events)
SELECT event_type, b - k * INTERVAL '6 hours' AS window_start, b - k * INTERVAL '6 hours' + INTERVAL '1 day' AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL"""


@query("W02_hop", HOP)
def hop(spark, d):
    return w.aggregate(table(spark, d, "events"), w.hop("ts", "6 hours", "1 day"), ["event_type"], sums())


@query(
    "W03_session",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""",
)
def session(spark, d):
    return w.aggregate(table(spark, d, "events"), w.session("ts", "6 hours"), ["user_id"], sums())


@query(
    "W04_cumulate",
    """WITH x AS (SELECT *, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS b FROM events), y AS (SELECT *, unnest(generate_series(1, 4)) AS k FROM x)
    SELECT b AS window_start, b + k * INTERVAL '6 hours' AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM y WHERE ts < b + k * INTERVAL '6 hours' GROUP BY ALL""",
)
def cumulate(spark, d):
    return w.assign_cumulate(table(spark, d, "events"), "ts", "6 hours", "1 day").groupBy("window_start", "window_end").agg(*sums())


@query("W05_tumble_scalar", "SELECT event_id, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS a, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') + INTERVAL '5 minutes' AS b FROM events")
def tumble_scalar(spark, d):
    return table(spark, d, "events").select("event_id", w.tumble_start(F.col("ts"), "5m").alias("a"), w.tumble_end(F.col("ts"), "5m").alias("b"))


@query("W06_hop_scalar", "SELECT event_id, time_bucket(INTERVAL '5 minutes', ts - INTERVAL '5 minutes', TIMESTAMP '1970-01-01') AS a, time_bucket(INTERVAL '5 minutes', ts - INTERVAL '5 minutes', TIMESTAMP '1970-01-01') + INTERVAL '10 minutes' AS b FROM events")
def hop_scalar(spark, d):
    return table(spark, d, "events").select("event_id", w.hop_start(F.col("ts"), "5m", "10m").alias("a"), w.hop_end(F.col("ts"), "5m", "10m").alias("b"))


@query("W07_session_scalar", "SELECT event_id, ts AS a FROM events")
def session_scalar(spark, d):
    return table(spark, d, "events").select("event_id", w.session_key(F.col("ts"), "30m").alias("a"))


@query("W08_cumulate_scalar", "SELECT event_id, date_trunc('hour', ts) AS a, date_trunc('hour', ts) + INTERVAL '1 hour' AS b FROM events")
def cumulate_scalar(spark, d):
    return table(spark, d, "events").select("event_id", w.cumulate_start(F.col("ts"), "5m", "1h").alias("a"), w.cumulate_end(F.col("ts"), "5m", "1h").alias("b"))


CLOSED = """WITH x AS (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, value, ts FROM events), m AS (SELECT max(ts) - INTERVAL '{delay}' AS wm FROM events)
SELECT window_start, window_start + INTERVAL '1 day' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x, m GROUP BY window_start, event_type, wm HAVING window_start + INTERVAL '1 day' + INTERVAL '{late}' <= wm"""


@query("E02_on_window_close", CLOSED.format(delay="1 hour", late="0 hours"))
def on_window_close(spark, d):
    """What a watermark of the last event less an hour has closed."""
    e = table(spark, d, "events")
    found = w.aggregate(e, w.tumble("ts", "1 day"), ["event_type"], sums())
    mark = e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("wm"))
    return w.closed(found.crossJoin(F.broadcast(mark)), F.col("wm")).drop("wm")


@query("ST10_allowed_lateness", CLOSED.format(delay="1 hour", late="36 hours"))
def allowed_lateness(spark, d):
    e = table(spark, d, "events")
    found = w.aggregate(e, w.tumble("ts", "1 day"), ["event_type"], sums())
    mark = e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("wm"))
    return w.closed(found.crossJoin(F.broadcast(mark)), F.col("wm"), "36 hours").drop("wm")


@query(
    "W11_having_projection",
    """SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, round(sum(value) / count(*), 6) AS vwap FROM events GROUP BY 1 HAVING count(*) > 300""",
)
def having_projection(spark, d):
    x = w.aggregate(table(spark, d, "events"), w.tumble("ts", "1 day"), [], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")])
    return x.filter("n > 300").select("window_start", F.round(F.col("s") / F.col("n"), 6).alias("vwap"))


@query(
    "W12_cascade",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT date_trunc('day', hour) AS window_start, max(n) AS busiest, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1""",
)
def cascade(spark, d):
    h = w.aggregate(table(spark, d, "events"), w.tumble("ts", "1 hour"), ["user_id"], [F.count(F.lit(1)).alias("n")])
    return w.aggregate(h.withColumnsRenamed({"window_start": "hour", "window_end": "hour_end"}), w.tumble("hour", "1 day"), [], [F.max("n").alias("busiest"), F.sum("n").alias("n")]).drop("window_end")


@query(
    "A06_ohlc",
    """SELECT event_type, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') AS window_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY ALL""",
)
def ohlc(spark, d):
    a = [F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close")]
    return w.aggregate(table(spark, d, "events"), w.tumble("ts", "12 hours"), ["event_type"], a).drop("window_end")
