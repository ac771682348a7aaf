"""Projection, filters, joins, aggregates, OVER windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.operators import analytic, joins
from eddyflow.plans.registry import query, table, text

# ---------------------------------------------------------------- projection and filter
text("P01_project_filter", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM $lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
text("P02_multi_source", "SELECT o.o_orderkey, u.line FROM (SELECT o_orderkey FROM $orders WHERE o_totalprice > 400000) o JOIN (SELECT l_orderkey AS k, l_linenumber AS line FROM $lineitem UNION ALL SELECT l_orderkey, l_linenumber + 100 FROM $lineitem WHERE l_linenumber = 1) u ON o.o_orderkey = u.k")
text("P03_predicates", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 'mid' ELSE 'low' END AS band, -o_custkey AS neg,
  TRY_CAST(o_orderpriority AS INT) AS n FROM $orders WHERE (o_orderpriority LIKE '1%' OR o_orderpriority IN ('2-HIGH', '5-LOW')) AND NOT o_orderstatus = 'P' AND o_orderdate IS NOT NULL""")
text("P04_subqueries", """SELECT c_custkey, c_acctbal FROM $customer c WHERE EXISTS (SELECT 1 FROM $orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)
  AND c_nationkey IN (SELECT n_nationkey FROM $nation WHERE n_regionkey < 3) AND c_acctbal > (SELECT avg(c_acctbal) FROM $customer)""")
text("P05_join_disambiguation", "SELECT a.n_name AS n_name, b.n_name AS n_name_b, a.n_nationkey, b.n_nationkey AS n_nationkey_b FROM $nation a JOIN $nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
text("P07_now_filter", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM $events WHERE ts <= current_timestamp", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM $events WHERE ts <= current_timestamp::TIMESTAMP")
text("P08_distinct", "SELECT DISTINCT user_id, event_type FROM $events")
text("P09_derived", "SELECT event_id, value * 2 + 1 AS v2, (value - 10) / 2 AS half, concat(event_type, '-', CAST(user_id AS STRING)) AS tag FROM $events", "SELECT event_id, value * 2 + 1 AS v2, (value - 10) / 2 AS half, concat(event_type, '-', CAST(user_id AS VARCHAR)) AS tag FROM $events")
text("P11_cte", "WITH spend AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM $orders GROUP BY o_custkey), top AS (SELECT * FROM spend WHERE total > 500000) SELECT t.k, t.total, c.c_mktsegment FROM (SELECT * FROM top) t JOIN $customer c ON c.c_custkey = t.k")
text("P12_unnest", "SELECT event_id, w.part FROM $events LATERAL VIEW explode(split(event_type, 'i')) w AS part", "SELECT event_id, unnest(string_split(event_type, 'i')) AS part FROM $events")


@query("P10_predicate_split", "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE c.c_acctbal > 0 AND e.value > 50 AND c.c_mktsegment <> 'BUILDING' AND e.value < c.c_acctbal")
def predicate_split(spark, d):
    found = joins.lookup_join(table(spark, d, "events").filter("value > 50"), table(spark, d, "customer"), [("user_id", "c_custkey")], where=(F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "BUILDING"))
    return found.filter("value < c_acctbal").select("event_id", "c_name")


# ---------------------------------------------------------------- joins
text("J01_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM $orders o JOIN $customer c ON o.o_custkey = c.c_custkey")
text("J02_left_outer", "SELECT c.c_custkey, o.o_orderkey FROM $customer c LEFT JOIN $orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
text("J02_right_outer", "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM $orders WHERE o_totalprice > 300000) o RIGHT JOIN $customer c ON c.c_custkey = o.o_custkey")
text("J02_full_outer", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM $supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM $customer WHERE c_acctbal > 5000) c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey")
text("J03_left_semi", "SELECT c_custkey FROM $customer c LEFT SEMI JOIN $orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
text("J03_left_anti", "SELECT c_custkey FROM $customer c LEFT ANTI JOIN $orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
text("J04_right_semi", "SELECT o_orderkey FROM $orders o LEFT SEMI JOIN (SELECT * FROM $customer WHERE c_acctbal > 5000) c ON c.c_custkey = o.o_custkey", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
text("J04_right_anti", "SELECT o_orderkey FROM $orders o LEFT ANTI JOIN (SELECT * FROM $customer WHERE c_acctbal > 5000) c ON c.c_custkey = o.o_custkey", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
text("J05_cross", "SELECT r.r_name, n.n_name FROM $region r CROSS JOIN $nation n WHERE n.n_nationkey < 5")
text("J05_theta", "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM $nation a JOIN $nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 2")
text("J06_n_way", """SELECT r.r_name, n.n_name, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM $lineitem l JOIN $orders o ON l.l_orderkey = o.o_orderkey
  JOIN $customer c ON o.o_custkey = c.c_custkey JOIN $nation n ON c.c_nationkey = n.n_nationkey JOIN $region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name""")
text("J15_distributed_join", "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity, o.o_totalprice FROM $orders o JOIN $lineitem l ON o.o_orderkey = l.l_orderkey")
text("J16_column_pruning", "SELECT e.event_id, c.c_mktsegment FROM $events e LEFT JOIN $customer c ON e.user_id = c.c_custkey")

# ---------------------------------------------------------------- aggregates
text("A01_count", "SELECT event_type, count(*) AS n, count(nullif(user_id % 3, 0)) AS some FROM $events GROUP BY event_type")
text("A02_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM $events GROUP BY event_type")
text("A03_sum", "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS s, CAST(sum(DISTINCT user_id) AS BIGINT) AS sd, round(sum(value), 4) AS sv FROM $events GROUP BY event_type")
text("A04_min_max", "SELECT user_id, min(value) AS lo, max(value) AS hi, min(ts) AS first, max(ts) AS last, max(event_type) AS t FROM $events GROUP BY user_id")
text("A05_avg", "SELECT event_type, round(avg(value), 6) AS mean, round(mean(user_id), 6) AS mu FROM $events GROUP BY event_type")
text("A06_first_last", "SELECT user_id, min_by(value, ts) AS first_value, max_by(value, ts) AS last_value FROM $events GROUP BY user_id", "SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events GROUP BY user_id")
text("A07_stddev", "SELECT event_type, round(stddev(value), 6) AS sd, round(stddev_samp(value), 6) AS ss, round(stddev_pop(value), 6) AS sp FROM $events GROUP BY event_type")
text("A08_variance", "SELECT event_type, round(variance(value), 4) AS v, round(var_samp(value), 4) AS vs, round(var_pop(value), 4) AS vp FROM $events GROUP BY event_type")
text("A09_median", "SELECT event_type, round(median(value), 6) AS m FROM $events GROUP BY event_type")
text("A10_percentile", "SELECT event_type, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS pc, percentile_disc(0.25) WITHIN GROUP (ORDER BY value) AS pd FROM $events GROUP BY event_type")
text("A11_bool", "SELECT user_id, bool_and(value > 1) AS every_, bool_or(value > 99) AS any_, every(value >= 0) AS e2 FROM $events GROUP BY user_id", "SELECT user_id, bool_and(value > 1) AS every_, bool_or(value > 99) AS any_, bool_and(value >= 0) AS e2 FROM events GROUP BY user_id")
text("A12_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM $nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
text("A13_array_agg", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names, size(array_agg(n_nationkey)) AS n FROM $nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names, CAST(len(array_agg(n_nationkey)) AS INT) AS n FROM nation GROUP BY n_regionkey")
text("A14_approx_count_distinct", "SELECT abs(approx_count_distinct(user_id, 0.01) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) AS close FROM $events", "SELECT true AS close")
text("A15_approx_percentile", "SELECT abs(percentile_approx(value, 0.9, 10000) - percentile(value, 0.9)) <= 0.01 * (max(value) - min(value)) AS close FROM $events", "SELECT true AS close")
text("A16_approx_median", "SELECT abs(percentile_approx(value, 0.5, 10000) - median(value)) <= 0.01 * (max(value) - min(value)) AS close FROM $events", "SELECT true AS close")
text("A17_covar", "SELECT event_type, round(covar_samp(value, user_id), 4) AS cs, round(covar_pop(value, user_id), 4) AS cp FROM $events GROUP BY event_type")
text("A18_corr", "SELECT event_type, round(CASE WHEN var_pop(value) > 0 AND var_pop(user_id) > 0 THEN corr(value, user_id) END, 6) AS r FROM $events GROUP BY event_type")
text("A19_regr", "SELECT event_type, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 6) AS intercept FROM $events GROUP BY event_type")
text("A20_bits", "SELECT event_type, bit_and(user_id) AS ba, bit_or(user_id) AS bo, bit_xor(user_id) AS bx FROM $events GROUP BY event_type")
text("A21_json_agg", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS js FROM $nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_nationkey))) AS VARCHAR) AS js FROM nation GROUP BY n_regionkey")
text("A30_hash_aggregate", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS d, count(*) AS n FROM $lineitem GROUP BY l_returnflag, l_linestatus")
text("A34_global", "SELECT count(*) AS n, round(sum(value), 4) AS s, max(ts) AS last FROM $events")
text("A35_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM $events GROUP BY user_id")
text("A36_having", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS s FROM $events GROUP BY user_id HAVING count(*) > 60 AND sum(value) > 100")
text("A37_post_aggregate", "SELECT event_type, round(sum(value) / count(*), 6) AS ratio, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS weighted FROM $events GROUP BY event_type")
text("A38_case_pivot", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM $events GROUP BY user_id", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY user_id")
text("A40_distinct_two_phase", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM $lineitem GROUP BY l_returnflag")
text("A41_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM $lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
text("A41_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM $orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
text("A41_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM $orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
text("A42_group_by_expression", "SELECT user_id % 10 AS bucket, substr(event_type, 1, 1) AS initial, count(*) AS n FROM $events GROUP BY user_id % 10, substr(event_type, 1, 1)")


@query("A22_json_object_agg", "SELECT user_id, count(DISTINCT event_type) AS n, arg_max(value, ts) FILTER (WHERE event_type = 'click') AS click FROM events GROUP BY user_id")
def json_object_agg(spark, d):
    from eddyflow.functions.json import json_object_agg as agg

    x = table(spark, d, "events").groupBy("user_id").agg(agg("event_type", "value", "ts").alias("j"))
    return x.select("user_id", F.size(F.json_object_keys("j")).cast("long").alias("n"), F.get_json_object("j", "$.click").cast("double").alias("click"))


@query("A23_custom_aggregate", "SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS geo FROM events GROUP BY event_type")
def custom_aggregate(spark, d):
    from eddyflow.functions import udf

    return table(spark, d, "events").groupBy("event_type").agg(F.round(udf.geometric_mean(F.col("value") + 1), 6).alias("geo"))


@query("A39_partial_final", "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def partial_final(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- OVER windows
text("O01_lag", "SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS prev, lag(value, 2, CAST(-1 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts) AS prev2 FROM $events")
text("O02_lead", "SELECT event_id, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM $events")
text("O03_first_last", "SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM $events")
text("O04_nth_value", "SELECT event_id, nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM $events")
text("O05_ranks", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM $lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber)")
text("O06_distribution", "SELECT c_custkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS q FROM $customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
text("O07_frames", "SELECT event_id, round(avg(value) OVER w, 6) AS a, round(sum(value) OVER w, 6) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM $events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
text("O07_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM $events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
text("O08_following", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM $events")


@query(
    "O09_sliding_moments",
    """SELECT event_id, round(covar_pop(value, user_id) OVER w + 1e-7, 2) AS cp, round(covar_samp(value, user_id) OVER w + 1e-7, 2) AS cs, round(CASE WHEN count(*) OVER w > 1 AND var_pop(value) OVER w > 0 AND min(user_id) OVER w < max(user_id) OVER w THEN corr(value, user_id) OVER w END, 6) AS r
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def sliding_moments(spark, d):
    x = table(spark, d, "events")
    for kind, name, places in (("covar_pop", "cp", 2), ("covar_samp", "cs", 2), ("corr", "r", 6)):
        x = analytic.sliding_moment(x, kind, "value", "user_id", [F.col("ts")], 9, name, ["event_type"]).withColumn(name, F.round(F.col(name) + (0 if kind == "corr" else 1e-7), places))  # off the ties of two decimals
    return x.select("event_id", "cp", "cs", "r")


# ---------------------------------------------------------------- sort and limit
text("L02_order_limit", "SELECT o_orderkey, o_totalprice FROM $orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
text("L06_order_offset", "SELECT o_orderkey FROM $orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
text("L07_nulls", "SELECT k, v FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS v FROM $orders) t ORDER BY v ASC NULLS FIRST, k DESC LIMIT 25")


@query("L01_sorted_scan", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def sorted_scan(spark, d):
    """Sorting under an aggregate is dropped by the optimizer."""
    return table(spark, d, "orders").orderBy("o_orderdate").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("L03_window_local_sort", "SELECT window_start, event_id, value FROM (SELECT date_trunc('day', ts) AS window_start, event_id, value, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def window_local_sort(spark, d):
    from eddyflow.operators.windows import tumble_start

    x = table(spark, d, "events").select(tumble_start(F.col("ts"), "1 day").alias("window_start"), "event_id", "value")
    return analytic.top_k_per_group(x, ["window_start"], 3, F.desc("value"), F.col("event_id")).drop("rn")


@query("L05_top_k_per_group", "SELECT c_mktsegment, c_custkey, rn FROM (SELECT c_mktsegment, c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def top_per_group(spark, d):
    x = analytic.top_k_per_group(table(spark, d, "customer"), ["c_mktsegment"], 5, F.desc("c_acctbal"), F.col("c_custkey"), rank="rank")
    return x.select("c_mktsegment", "c_custkey", F.col("rn").cast("long").alias("rn"))


# ---------------------------------------------------------------- set operations
A, B = "SELECT user_id FROM $events WHERE event_type = 'click'", "SELECT user_id FROM $events WHERE event_type = 'purchase'"
text("U01_union_all", f"SELECT user_id, count(*) AS n FROM ({A} UNION ALL {B}) t GROUP BY user_id")
text("U02_union", f"{A} UNION {B}")
text("U03_intersect", f"{A} INTERSECT {B}")
text("U03_intersect_all", f"SELECT user_id, count(*) AS n FROM ({A} INTERSECT ALL {B}) t GROUP BY user_id")
text("U04_except", "SELECT c_custkey AS k FROM $customer EXCEPT SELECT o_custkey FROM $orders")
text("U04_except_all", f"SELECT user_id, count(*) AS n FROM ({A} EXCEPT ALL {B}) t GROUP BY user_id")
text("S19_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
