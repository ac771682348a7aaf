"""Interval, as-of, temporal, probe, lookup and window joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.operators import joins
from eddyflow.operators import windows as w
from eddyflow.plans.registry import query, table

SIDES = """WITH l AS (SELECT event_id AS l_id, user_id AS l_user, ts AS l_ts, value AS l_value FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS r_id, user_id AS r_user, ts AS r_ts, value AS r_value FROM events WHERE event_type = 'purchase') """
ON = "ON l.l_user = r.r_user AND r.r_ts BETWEEN l.l_ts AND l.l_ts + INTERVAL 6 HOUR"


def side(spark, d, kind, p):
    return table(spark, d, "events").filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"), F.col("value").alias(f"{p}_value"))


def interval_query(name, how, sql, before="0 s", after="6 hours"):
    @query(name, SIDES + sql)
    def run(spark, d):
        x = joins.interval_join(side(spark, d, "click", "l"), side(spark, d, "purchase", "r"), [("l_user", "r_user")], "l_ts", "r_ts", before=before, after=after, how=how)
        return x.select([c for c in ("l_id", "l_value", "r_id", "r_value") if c in x.columns])


interval_query("J07_interval_inner", "inner", f"SELECT l_id, l_value, r_id, r_value FROM l JOIN r {ON}")
interval_query("J07_interval_left", "left", f"SELECT l_id, l_value, r_id, r_value FROM l LEFT JOIN r {ON}")
interval_query("J07_interval_right", "right", f"SELECT l_id, l_value, r_id, r_value FROM l RIGHT JOIN r {ON}")
interval_query("J07_interval_full", "full", f"SELECT l_id, l_value, r_id, r_value FROM l FULL JOIN r {ON}")
interval_query("J07_interval_semi", "left_semi", f"SELECT l_id, l_value FROM l WHERE EXISTS (SELECT 1 FROM r WHERE {ON[3:]})")
interval_query("J07_interval_anti", "left_anti", f"SELECT l_id, l_value FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE {ON[3:]})")
interval_query("J07_interval_symmetric", "inner", "SELECT l_id, l_value, r_id, r_value FROM l JOIN r ON l.l_user = r.r_user AND r.r_ts BETWEEN l.l_ts - INTERVAL 3 HOUR AND l.l_ts + INTERVAL 3 HOUR", "3 hours", "3 hours")


@query("J08_self_interval", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR AND a.event_type = 'view' AND b.event_type = 'click' AND a.value > 20")
def self_interval(spark, d):
    x = joins.interval_join(side(spark, d, "view", "l").filter("l_value > 20"), side(spark, d, "click", "r"), [("l_user", "r_user")], "l_ts", "r_ts", after="2 hours")
    return x.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def asof_query(name, sql, **options):
    @query(name, SIDES + sql)
    def run(spark, d):
        x = joins.asof_join(side(spark, d, "click", "l"), side(spark, d, "purchase", "r"), [("l_user", "r_user")], "l_ts", "r_ts", bucket="7 days", **options)
        return x.select("l_id", "r_id", "r_value")


BACK, AHEAD = "l ASOF LEFT JOIN r ON l.l_user = r.r_user AND l.l_ts >= r.r_ts", "l ASOF LEFT JOIN r ON l.l_user = r.r_user AND l.l_ts <= r.r_ts"
asof_query("J09_asof_backward", f"SELECT l_id, r_id, r_value FROM {BACK}")
asof_query("J09_asof_forward", f"SELECT l_id, r_id, r_value FROM {AHEAD}", direction="forward")
asof_query("J09_asof_inner", "SELECT l_id, r_id, r_value FROM l ASOF JOIN r ON l.l_user = r.r_user AND l.l_ts >= r.r_ts", how="inner")
asof_query("J09_asof_tolerance", f"SELECT l_id, CASE WHEN l_ts - r_ts <= INTERVAL 12 HOUR THEN r_id END AS r_id, CASE WHEN l_ts - r_ts <= INTERVAL 12 HOUR THEN r_value END AS r_value FROM {BACK}", tolerance="12 hours")
asof_query(
    "J09_asof_nearest",
    f""", b AS (SELECT l_id, l_ts, r_id AS b_id, r_ts AS b_ts, r_value AS b_value FROM {BACK}), a AS (SELECT l_id, r_id AS a_id, r_ts AS a_ts, r_value AS a_value FROM {AHEAD})
    SELECT l_id, CASE WHEN b_id IS NULL OR a_ts - l_ts < l_ts - b_ts THEN a_id ELSE b_id END AS r_id, CASE WHEN b_id IS NULL OR a_ts - l_ts < l_ts - b_ts THEN a_value ELSE b_value END AS r_value FROM b JOIN a USING (l_id)""",
    direction="nearest",
)


@query(
    "J10_temporal_probe",
    SIDES + """, p AS (SELECT *, unnest([-3600000, 0, 3600000, 21600000]) AS p_offset_ms FROM l), q AS (SELECT *, l_ts + p_offset_ms * INTERVAL 1 MILLISECOND AS pt FROM p)
    SELECT l_id, p_offset_ms, CAST(epoch_us(pt) // 1000 AS BIGINT) AS p_probe_ts, r_id, r_value FROM q ASOF LEFT JOIN r ON q.l_user = r.r_user AND q.pt >= r.r_ts""",
)
def probe(spark, d):
    offsets = joins.probe_offsets(["-1 hour", "0 s", "1 hour", "6 hours"])
    x = joins.temporal_probe_join(side(spark, d, "click", "l"), side(spark, d, "purchase", "r"), [("l_user", "r_user")], "l_ts", "r_ts", offsets, bucket="7 days")
    return x.select("l_id", F.col("p_offset_ms").cast("int"), "p_probe_ts", "r_id", "r_value")


VERSIONS = "SELECT o_custkey, o_orderdate, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey, o_orderdate"


def temporal_query(name, how, sql):
    @query(name, sql)
    def run(spark, d):
        e = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("INTERVAL 100 DAYS")).alias("at"))
        v = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("version"))
        return joins.temporal_join(e, v, [("o_custkey", "k")], "at", "o_orderdate", how=how, order="version", bucket="365 days").select("o_orderkey", "priority")


temporal_query("J11_temporal_inner", "inner", f"WITH v AS ({VERSIONS}), e AS (SELECT o_orderkey, o_custkey, o_orderdate - INTERVAL 100 DAY AS at FROM orders) SELECT e.o_orderkey, v.priority FROM e ASOF JOIN v ON e.o_custkey = v.o_custkey AND e.at >= v.o_orderdate")
temporal_query("J11_temporal_left", "left", f"WITH v AS ({VERSIONS}), e AS (SELECT o_orderkey, o_custkey, o_orderdate - INTERVAL 100 DAY AS at FROM orders) SELECT e.o_orderkey, v.priority FROM e ASOF LEFT JOIN v ON e.o_custkey = v.o_custkey AND e.at >= v.o_orderdate")


@query("J12_lookup_inner", "SELECT e.event_id, c.c_name, n.n_name FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def lookup_inner(spark, d):
    x = joins.lookup_join(table(spark, d, "events"), table(spark, d, "customer"), [("user_id", "c_custkey")])
    return joins.lookup_join(x, table(spark, d, "nation"), [("c_nationkey", "n_nationkey")]).select("event_id", "c_name", "n_name")


@query("J13_lookup_left", "SELECT e.event_id, c.c_name FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey")
def lookup_left(spark, d):
    return joins.lookup_join(table(spark, d, "events"), table(spark, d, "customer"), [("user_id", "c_custkey")], how="left", where=F.col("c_acctbal") > 0).select("event_id", "c_name")


@query(
    "J14_window_join",
    """WITH a AS (SELECT user_id, date_trunc('day', ts) AS s, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, date_trunc('day', ts) AS s, count(*) AS buys FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT a.user_id, a.s AS window_start, clicks, buys FROM a JOIN b ON a.user_id = b.user_id AND a.s = b.s""",
)
def window_join(spark, d):
    e = table(spark, d, "events")
    part = lambda kind, name: w.aggregate(e.filter(F.col("event_type") == kind), w.tumble("ts", "1 day"), ["user_id"], [F.count(F.lit(1)).alias(name)])
    return joins.window_join(part("click", "clicks"), part("purchase", "buys"), ["user_id"]).select("user_id", "window_start", "clicks", "buys")
