"""Continuous queries run over replayed tables; results equal those of the batch, where windows have closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.operators import changelog as cl
from eddyflow.operators import windows as w
from eddyflow.plans.registry import query, table
from eddyflow.streaming import run, stateful, views
from eddyflow.streaming.run import scratch


def stream(spark, d, parts=4, columns="*"):
    return run.replay(table(spark, d, "events").selectExpr(columns if isinstance(columns, str) else columns), "ts", parts, scratch(spark) + "/in")


CLOSED = "WITH m AS (SELECT max(ts) - INTERVAL '{delay}' AS wm FROM events) "


DAY = "time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')"


@query("ST01_stream_tumble", CLOSED.format(delay="1 hour") + f"SELECT event_type, {DAY} AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events, m GROUP BY event_type, {DAY}, wm HAVING {DAY} + INTERVAL '1 day' <= wm")
def stream_tumble(spark, d):
    e = run.with_watermark(stream(spark, d), "ts", "1 hour")
    x = e.groupBy(w.tumble("ts", "1 day").alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return run.drain(x.select("event_type", w.bounds()[0], "n", "total"))


@query(
    "W02_stream_hop",
    CLOSED.format(delay="1 hour") + """, x AS (SELECT *, unnest([0, 1]) AS k, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') AS b FROM events)
    SELECT window_start, count(*) AS n FROM (SELECT b - k * INTERVAL '12 hours' AS window_start, wm FROM x, m) GROUP BY window_start, wm HAVING window_start + INTERVAL '1 day' <= wm""",
)
def stream_hop(spark, d):
    e = run.with_watermark(stream(spark, d), "ts", "1 hour")
    return run.drain(e.groupBy(w.hop("ts", "12 hours", "1 day").alias("window")).agg(F.count(F.lit(1)).alias("n")).select(w.bounds()[0], "n"))


@query(
    "W03_stream_session",
    CLOSED.format(delay="1 hour") + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
    k AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS e, count(*) AS n FROM s GROUP BY user_id, sid) SELECT user_id, window_start, n FROM k, m WHERE e <= wm""",
)
def stream_session(spark, d):
    e = run.with_watermark(stream(spark, d), "ts", "1 hour")
    return run.drain(e.groupBy(w.session("ts", "6 hours").alias("window"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", w.bounds()[0], "n"))


@query("J07_stream_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def stream_interval_join(spark, d):
    side = lambda kind, p: run.with_watermark(stream(spark, d), "ts", "1 hour").filter(F.col("event_type") == kind).select(F.col("event_id").alias(p), F.col("user_id").alias(f"u{p}"), F.col("ts").alias(f"t{p}"))
    near = F.expr("ua = ub AND tb >= ta AND tb <= ta + INTERVAL 6 HOURS")
    return run.drain(side("click", "a").join(side("purchase", "b"), near).select("a", "b"))


@query("ST08_late_rows", "SELECT 'on time' AS kind, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'late', count(*) FROM events WHERE event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL '1 day' UNION ALL SELECT 'on time', count(*) FROM events WHERE event_id % 2 = 1 AND ts >= (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL '1 day'")
def late_rows(spark, d):
    """Even rows come first; odd rows older than the watermark of those go to the side output."""
    folder = scratch(spark)
    e = table(spark, d, "events")
    for k in (0, 1):
        e.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    src = run.file_stream(spark, f"{folder}/in/*", e.schema)
    on_time, late = views.View(spark, f"{folder}/on_time"), views.View(spark, f"{folder}/late")
    q = run.start(src, mode="append", sink=stateful.LateSplit("ts", w.micros("1 day"), 0, on_time, late, f"{folder}/bounds"), available=True, checkpoint=f"{folder}/cp")
    q.awaitTermination()
    part = lambda v, kind: spark.read.option("basePath", v.path).parquet(v.path).groupBy("epoch").count().select(F.lit(kind).alias("kind"), F.col("count").alias("n"))
    return part(on_time, "on time").unionAll(part(late, "late").filter("n > 0"))


@query("E03_on_update", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def on_update(spark, d):
    """Running counts; of the updates of each group the last counts all its rows."""
    got = run.drain(stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), mode="update")
    return got.groupBy("event_type").agg(F.max("n").alias("n"))


@query("E05_stream_changes", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_changes(spark, d):
    """The changelog of running results sums up to the last result."""
    got = run.drain(stateful.emit_changes(stream(spark, d), ["event_type"], "value"))
    return cl.consolidate(got).filter("__weight = 1").select("event_type", "n", F.round("total", 4).alias("total"))


@query("O01_stream_lag", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events")
def stream_lag(spark, d):
    return run.drain(stateful.lag(stream(spark, d), ["user_id"], "ts", "value")).select("event_id", "previous")


@query("P08_stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    return run.drain(stream(spark, d).select("user_id", "event_type").distinct())


@query("W12_stream_cascade", "WITH m AS (SELECT max(ts) - INTERVAL '1 hour' AS wm FROM events), h AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT date_trunc('day', hour) AS window_start, CAST(sum(n) AS BIGINT) AS n FROM h, m GROUP BY date_trunc('day', hour), wm HAVING date_trunc('day', hour) + INTERVAL '1 day' <= wm")
def stream_cascade(spark, d):
    """Windows of windows, both in one continuous query."""
    e = run.with_watermark(stream(spark, d), "ts", "1 hour")
    h = e.groupBy(w.tumble("ts", "1 hour").alias("hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    day = h.groupBy(F.window(F.window_time("hour"), "1 day").alias("window")).agg(F.sum("n").alias("n"))
    return run.drain(day.select(w.bounds()[0], "n"))


@query("ST16_view_replay", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def view_replay(spark, d):
    """A view of appended epochs, replayed from its first one."""
    folder = scratch(spark)
    view = views.View(spark, f"{folder}/view")
    run.start(stream(spark, d), mode="append", sink=view, available=True, checkpoint=f"{folder}/cp").awaitTermination()
    return view.since(-1).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ST13_resume", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def resume(spark, d):
    """A query stopped half way and started again on its checkpoint reads every file once."""
    folder = scratch(spark)
    e = table(spark, d, "events")
    view = views.View(spark, f"{folder}/view")
    for k in (0, 1):
        e.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run.start(run.file_stream(spark, f"{folder}/in", e.schema), mode="append", sink=view, available=True, checkpoint=f"{folder}/cp").awaitTermination()
    return view.read().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("K02_mv_replace", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def mv_replace(spark, d):
    """An aggregate's view keeps the last whole result."""
    folder = scratch(spark)
    view = views.View(spark, f"{folder}/view", mode="replace")
    x = stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    run.start(x, mode="complete", sink=view, available=True, checkpoint=f"{folder}/cp").awaitTermination()
    return view.read()


SIDES = """WITH l AS (SELECT event_id AS l_id, user_id AS l_user, ts AS l_ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS r_id, user_id AS r_user, ts AS r_ts FROM events WHERE event_type = 'purchase'), m AS (SELECT max(ts) - INTERVAL '2 hours' AS wm FROM events) """


def sides(spark, d):
    part = lambda kind, p: stream(spark, d).filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
    return part("click", "l"), part("purchase", "r")


def settled(spark, d, at: str):
    """Up to where the watermark is sure to have come: two hours before the last event, one of them the delay."""
    last = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return F.expr(at) <= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 2 HOURS")


@query("J09_stream_asof", SIDES + "SELECT l_id, r_id FROM l ASOF LEFT JOIN r ON l.l_user = r.r_user AND l.l_ts >= r.r_ts, m WHERE l_ts <= wm")
def stream_asof(spark, d):
    from eddyflow.streaming import joins

    got = run.drain(joins.asof(*sides(spark, d), [("l_user", "r_user")], "l_ts", "r_ts", delay="1 hour"))
    return got.filter(settled(spark, d, "l.l_ts")).select("l.l_id", "r.r_id")


@query("J10_stream_probe", SIDES + ", q AS (SELECT *, unnest([0, 3600000])::BIGINT AS o FROM l), p AS (SELECT *, l_ts + o * INTERVAL 1 MILLISECOND AS pt FROM q) SELECT l_id, o AS p_offset_ms, r_id FROM p ASOF LEFT JOIN r ON p.l_user = r.r_user AND p.pt >= r.r_ts, m WHERE pt <= wm")
def stream_probe(spark, d):
    from eddyflow.streaming import joins

    got = run.drain(joins.probe(*sides(spark, d), [("l_user", "r_user")], "l_ts", "r_ts", [0, 3_600_000], delay="1 hour"))
    return got.filter(settled(spark, d, "l.l_ts + make_dt_interval(0, 0, 0, l.p_offset_ms / 1000)")).select("l.l_id", "l.p_offset_ms", "r.r_id")
