"""Changelogs, change capture and the temporal filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.operators import changelog as cl
from eddyflow.plans.registry import query, table

CHANGES = """WITH c AS (SELECT o_orderstatus AS status, o_custkey % 50 AS cust, o_totalprice AS price, 1 AS w FROM orders UNION ALL SELECT o_orderstatus, o_custkey % 50, o_totalprice, -1 FROM orders WHERE o_orderkey % 3 = 0) """


def changes(spark, d):
    """All orders inserted, every third retracted again."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).alias("cust"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return cl.encode(o.drop("o_orderkey")).unionAll(cl.encode(o.filter("o_orderkey % 3 = 0").drop("o_orderkey"), -1))


@query("X01_encode", "SELECT event_id, CAST(1 AS BIGINT) AS __weight FROM events")
def encode(spark, d):
    return cl.encode(table(spark, d, "events").select("event_id"))


CDC = "SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS v, CASE o_orderkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'I' WHEN 2 THEN 'U+' ELSE 'U-' END AS _op FROM orders"


def capture(spark, d):
    k = F.col("o_orderkey") % 4
    op = F.when(k == 0, "D").when(k == 1, "I").when(k == 2, "U+").otherwise("U-")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"), op.alias("_op"))


@query("X02_split", f"WITH c AS ({CDC}) SELECT k, seq, _op IN ('I', 'U+') AS comes FROM c")
def split(spark, d):
    comes, goes = cl.split(capture(spark, d))
    return comes.select("k", "seq", F.lit(True).alias("comes")).unionAll(goes.select("k", "seq", F.lit(False).alias("comes")))


@query("X03_consolidate", CHANGES + "SELECT status, cust, price, CAST(sum(w) AS BIGINT) AS __weight FROM c GROUP BY ALL HAVING sum(w) <> 0")
def consolidate(spark, d):
    return cl.consolidate(changes(spark, d))


@query("X04_collapse", f"WITH c AS ({CDC}) SELECT k, max(seq) AS seq, arg_max(v, seq) AS v, CASE WHEN arg_max(_op, seq) IN ('D', 'U-') THEN 'D' ELSE 'U' END AS _op FROM c GROUP BY k")
def collapse(spark, d):
    return cl.collapse(capture(spark, d), ["k"], "seq")


@query(
    "X05_upserts",
    """WITH o AS (SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 0) AS old, count(*) AS new FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN user_id % 5 = 0 THEN old ELSE new END AS n, CASE WHEN user_id % 5 = 0 THEN 'D' ELSE 'U' END AS _op FROM o WHERE user_id % 5 = 0 AND old > 0 OR user_id % 5 <> 0 AND new <> old""",
)
def upserts(spark, d):
    """A running count that was retracted and inserted anew; every fifth user went."""
    e = table(spark, d, "events")
    old = e.groupBy("user_id").agg(F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("n")).filter("n > 0 OR user_id % 5 <> 0")
    new = e.filter("user_id % 5 <> 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return cl.upserts(cl.encode(old, -1).unionAll(cl.encode(new)), ["user_id"])


@query("X06_change_feed", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 4 < 2 THEN -1 ELSE 1 END::BIGINT AS __weight FROM orders")
def change_feed(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("delete", "update_preimage", "update_postimage", "insert"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return cl.from_change_feed(table(spark, d, "orders").select("o_orderkey", "o_totalprice", kind.alias("_change_type")))


@query("K10_positive_rows", CHANGES + "SELECT status, cust, price FROM c WHERE w > 0")
def positive_rows(spark, d):
    return cl.positive(changes(spark, d))


@query("A33_retractable", CHANGES + ", k AS (SELECT status, price, cust, sum(w) AS w FROM c GROUP BY ALL HAVING sum(w) > 0) SELECT status, CAST(sum(w) AS BIGINT) AS n, round(sum(price * w), 2) AS total, round(sum(price * w) / sum(w), 4) AS mean, min(price) AS lo, max(price) AS hi FROM k GROUP BY status")
def retractable(spark, d):
    x = cl.aggregate(changes(spark, d), ["status"], {"n": ("count", None), "total": ("sum", "price"), "mean": ("avg", "price"), "lo": ("min", "price"), "hi": ("max", "price")})
    return x.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query(
    "A31_emit_changes",
    """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 06:00:00' GROUP BY user_id)
    SELECT user_id, n, CAST(-1 AS BIGINT) AS __weight FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, n, 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def emit_changes(spark, d):
    e = table(spark, d, "events")
    count = lambda until: e.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return cl.diff(count("2024-01-15"), count("2024-01-15 06:00:00"), ["user_id"])


@query("A32_idle_eviction", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)")
def idle_eviction(spark, d):
    """Groups that were idle longer than their time to live are gone."""
    e = table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 12 HOURS")).alias("edge"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).crossJoin(F.broadcast(last)).filter("last >= edge").select("user_id", "n")


@query(
    "P06_temporal_filter",
    """WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS t, (SELECT max(epoch_us(ts) // 1000) FROM events) AS m FROM events)
    SELECT event_id, CAST(1 AS BIGINT) AS __weight, CAST(t AS BIGINT) AS __at FROM x UNION ALL SELECT event_id, -1, CAST(ceil((t + 86400000) / 1000.0) * 1000 AS BIGINT) FROM x WHERE ceil((t + 86400000) / 1000.0) * 1000 <= m""",
)
def temporal_filter(spark, d):
    """``ts > now() - 1 day``: in with the event, out when the watermark passes a day later."""
    e = table(spark, d, "events")
    until = e.agg(F.max("ts")).first()[0]
    return cl.temporal_filter(e.select("event_id", "ts"), "ts", lower="-1 day", lower_strict=True, until=F.lit(until).cast("timestamp_ntz")).drop("ts")


@query("S15_upsert_table", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_table(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cl.upsert_table(c, c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])
