"""JSON, struct, map, array, time and inherited scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyflow.functions import ai, complex, json, scalar, time, udf
from eddyflow.plans.registry import query, table, text

J = """json_object('k', CAST(props->>'$.k' AS INT), 'type', event_type, 'n', json_object('u', user_id, 'tags', json_array(event_type, 'x')), 'ok', user_id % 2 = 0, 'nil', NULL)"""


def events(spark, d):
    """Events with a nested JSON text ``j``."""
    e = table(spark, d, "events")
    n = F.struct(F.col("user_id").alias("u"), F.array("event_type", F.lit("x")).alias("tags"))
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"), n.alias("n"), (F.col("user_id") % 2 == 0).alias("ok"), F.lit(None).cast("string").alias("nil")), {"ignoreNullFields": "false"})
    return e.withColumn("j", j)


def pick(name, sql, **columns):
    @query(name, f"SELECT event_id, {sql} FROM (SELECT *, {J} AS j FROM events)")
    def run(spark, d):
        return events(spark, d).select("event_id", *[f().alias(c) for c, f in columns.items()])


c = F.col
pick("JS01_get", "CAST(j->'k' AS VARCHAR) AS a, CAST(j->'n'->'u' AS VARCHAR) AS b", a=lambda: json.get(c("j"), "k"), b=lambda: json.get(json.get(c("j"), "n"), "u"))
pick("JS02_get_idx", "CAST(j->'n'->'tags'->1 AS VARCHAR) AS a", a=lambda: json.get_idx(json.get_path(c("j"), ["n", "tags"]), 1))
pick("JS03_get_text", "j->>'type' AS a, j->>'none' AS b", a=lambda: json.get_text(c("j"), "type"), b=lambda: json.get_text(c("j"), "none"))
pick("JS04_get_text_idx", "j->'n'->'tags'->>0 AS a", a=lambda: json.get_text_idx(json.get_path(c("j"), ["n", "tags"]), 0))
pick("JS05_get_path", "CAST(j->'$.n.u' AS VARCHAR) AS a", a=lambda: json.get_path(c("j"), ["n", "u"]))
pick("JS06_get_path_text", "j->>'$.n.tags[0]' AS a", a=lambda: json.get_path_text(c("j"), ["n", "tags", "0"]))
pick("JS07_exists", "json_exists(j, '$.nil') AS a, json_exists(j, '$.zzz') AS b", a=lambda: json.exists(c("j"), "nil"), b=lambda: json.exists(c("j"), "zzz"))
pick("JS08_exists_any", "true AS a, false AS b", a=lambda: json.exists_any(c("j"), ["zzz", "k"]), b=lambda: json.exists_any(c("j"), ["zzz", "y"]))
pick("JS09_exists_all", "true AS a, false AS b", a=lambda: json.exists_all(c("j"), ["k", "n"]), b=lambda: json.exists_all(c("j"), ["k", "zzz"]))
pick("JS10_contains", "user_id = 7 AND event_type = 'click' AS a, true AS b", a=lambda: json.contains(c("j"), F.lit('{"n":{"u":7},"type":"click"}')), b=lambda: json.contains(c("j"), F.lit('{"n":{"tags":["x"]}}')))
pick("JS11_contained_by", "CAST(props->>'$.k' AS INT) = 5 AS a", a=lambda: json.contained_by(c("props"), F.lit('{"k":5,"z":[1]}')))
pick("JS12_typeof", "'number' AS a, 'object' AS b, 'array' AS c, 'boolean' AS d, 'null' AS e, 'string' AS f", a=lambda: json.typeof(json.get(c("j"), "k")), b=lambda: json.typeof(c("j")), c=lambda: json.typeof(json.get_path(c("j"), ["n", "tags"])), d=lambda: json.typeof(json.get(c("j"), "ok")), e=lambda: json.typeof(F.lit("null")), f=lambda: json.typeof(json.get(c("j"), "type")))
pick("JS13_build_object", "CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS a", a=lambda: json.build_object("id", c("event_id"), "type", c("event_type")))
pick("JS14_build_array", "CAST(json_array(event_id, event_type, NULL) AS VARCHAR) AS a", a=lambda: json.build_array(c("event_id"), c("event_type"), F.lit(None).cast("string")))
pick("JS15_to_jsonb", "CAST(to_json(event_type) AS VARCHAR) AS a, CAST(to_json(user_id) AS VARCHAR) AS b", a=lambda: json.to_json(c("event_type")), b=lambda: json.to_json(c("user_id")))
pick("JS16_merge", "CAST(json_object('k', 0, 'z', event_id) AS VARCHAR) AS a", a=lambda: json.merge(c("props"), json.build_object("k", F.lit(0), "z", c("event_id"))))
pick("JS17_deep_merge", "CAST(json_object('n', json_object('u', user_id, 'v', 1), 'w', 2) AS VARCHAR) AS a", a=lambda: json.deep_merge(json.build_object("n", F.struct(c("user_id").alias("u"))), F.lit('{"n":{"v":1},"w":2}')))
pick("JS18_strip_nulls", "json_exists(j, '$.k') AND NOT false AS a", a=lambda: ~json.exists(json.strip_nulls(c("j")), "nil"))
pick("JS19_rename_keys", "CAST(json_object('key', CAST(props->>'$.k' AS INT)) AS VARCHAR) AS a", a=lambda: json.rename_keys(c("props"), {"k": "key"}))
pick("JS20_pick", "CAST(json_object('type', event_type) AS VARCHAR) AS a", a=lambda: json.pick(c("j"), ["type", "none"]))
pick("JS21_except", "CAST(json_object('type', event_type) AS VARCHAR) AS a", a=lambda: json.drop(c("j"), ["k", "n", "ok", "nil"]))
pick("JS22_flatten", "CAST(json_object('u', user_id, 'tags.0', event_type, 'tags.1', 'x') AS VARCHAR) AS a", a=lambda: json.flatten(json.build_object("u", c("user_id"), "tags", F.array("event_type", F.lit("x"))), "."))
pick("JS23_unflatten", "CAST(json_object('a', json_object('b', user_id)) AS VARCHAR) AS a", a=lambda: json.unflatten(json.build_object("a.b", c("user_id")), "."))
pick("JS24_to_columns", "CAST(props->>'$.k' AS BIGINT) AS k, event_type AS t", k=lambda: json.to_columns(c("j"), "k BIGINT, type STRING")["k"], t=lambda: json.to_columns(c("j"), "k BIGINT, type STRING")["type"])
pick("JS25_infer_schema", """'{"k":"BIGINT"}' AS a""", a=lambda: json.infer_schema(c("props")))
pick("JS26_path_exists", "true AS a, false AS b, true AS c", a=lambda: json.path_exists(c("j"), "$.n.tags[*]"), b=lambda: json.path_exists(c("j"), "$.n.tags[7]"), c=lambda: json.path_exists(c("j"), '$["nil"]'))
pick("JS27_path_match", "user_id % 2 = 0 AS a, CAST(NULL AS BOOLEAN) AS b", a=lambda: json.path_match(c("j"), "$.ok"), b=lambda: json.path_match(c("j"), "$.type"))
pick("JS28_to_json_text", "CAST(to_json([user_id, event_id]) AS VARCHAR) AS a", a=lambda: json.to_json(F.array("user_id", "event_id")))
pick("JS29_from_json", "CAST(props AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b", a=lambda: json.from_json(c("props")), b=lambda: json.from_json(F.concat(F.lit("{"), c("event_type"))))
pick("JS30_parse_epoch", "make_timestamp(event_id * 1000000) AS a, make_timestamp(event_id * 1000) AS b", a=lambda: time.parse_epoch(c("event_id"), "s"), b=lambda: time.parse_epoch(c("event_id"), "ms"))
pick("JS31_parse_timestamp", "date_trunc('second', ts) AS a, date_trunc('day', ts) AS b", a=lambda: time.parse_timestamp(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "%d/%m/%Y %H:%M:%S"), b=lambda: time.parse_timestamp(F.date_format("ts", "yyyy-MM-dd"), "%F"))


@query("JS32_table_functions", "SELECT event_id, CAST(unnest([1, 2]) AS INT) AS ordinality, unnest([event_type, 'x']) AS value FROM events")
def table_functions(spark, d):
    """JSON arrays as rows, by built-ins; the registered table functions take literals as well."""
    tags = F.from_json(json.get_path(c("j"), ["n", "tags"]), "array<string>")
    return events(spark, d).select("event_id", F.posexplode(tags).alias("p", "value")).select("event_id", (c("p") + 1).alias("ordinality"), "value")


@query("UD2_json_udtf", "SELECT * FROM (VALUES (1, 'a', '1'), (2, 'b', '\"x\"')) t(ordinality, key, value)")
def json_udtf(spark, d):
    udf.json_tables(spark)
    return spark.sql("""SELECT * FROM jsonb_each('{"a":1,"b":"x"}')""")


@query("UD1_registered_udf", "SELECT event_type, round(sum(value * 2), 4) AS s FROM events GROUP BY event_type")
def registered_udf(spark, d):
    udf.register_scalar(spark, "twice", lambda x: x * 2, "double")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(F.call_function("twice", c("value"))), 4).alias("s"))


# ---------------------------------------------------------------- structs, maps, arrays
def struct_events(spark, d):
    return table(spark, d, "events").withColumn("s", F.struct(c("user_id").alias("u"), c("event_type").alias("t"))).withColumn("s2", F.struct(c("value").alias("v"), F.lit("new").alias("t"))).withColumn("m", F.create_map(F.lit("a"), c("user_id"), F.lit("b"), c("event_id"))).withColumn("xs", F.array("user_id", "event_id", F.lit(3).cast("long")))


def shape(name, sql, **columns):
    @query(name, f"SELECT event_id, {sql} FROM events")
    def run(spark, d):
        df = struct_events(spark, d)
        return df.select("event_id", *[f(df).alias(k) for k, f in columns.items()])


shape("CX01_struct_extract", "user_id AS a", a=lambda df: complex.struct_extract(c("s"), "u"))
shape("CX02_struct_set", "event_id AS a, event_type AS b", a=lambda df: complex.struct_set(c("s"), "u", c("event_id"))["u"], b=lambda df: complex.struct_set(c("s"), "z", c("value"))["t"])
shape("CX03_struct_drop", "to_json({t: event_type})::VARCHAR AS a", a=lambda df: F.to_json(complex.struct_drop(c("s"), "u")))
shape("CX04_struct_rename", "user_id AS a", a=lambda df: complex.struct_rename(df, "s", "u", "uid")["uid"])
shape("CX05_struct_merge", "to_json({u: user_id, t: 'new'})::VARCHAR AS a", a=lambda df: F.to_json(complex.struct_drop(complex.struct_merge(df, "s", "s2"), "v")))
shape("CX06_map_keys", "'a,b' AS a", a=lambda df: F.array_join(complex.map_keys("m"), ","))
shape("CX07_map_values", "concat(user_id, ',', event_id) AS a", a=lambda df: F.array_join(complex.map_values("m"), ","))
shape("CX08_map_contains_key", "true AS a, false AS b", a=lambda df: complex.map_contains_key(c("m"), "a"), b=lambda df: complex.map_contains_key(c("m"), "z"))
shape("CX09_map_from_arrays", "user_id AS a", a=lambda df: complex.map_from_arrays(F.array(F.lit("p"), F.lit("q")), F.array("user_id", "event_id"))["p"])
shape("CX10_array_transform", "concat(user_id + 1, ',', event_id + 1, ',4') AS a", a=lambda df: F.array_join(complex.array_transform("xs", "x + 1"), ","))
shape("CX11_array_filter", "len(list_filter([user_id, event_id, 3], lambda x: x > 50))::INT AS a", a=lambda df: F.size(complex.array_filter("xs", "x > 50")))
shape("CX12_array_reduce", "user_id + event_id + 3 AS a", a=lambda df: complex.array_reduce("xs", "0L", "acc + x"))
shape("CX13_map_filter", "'a' AS a", a=lambda df: F.array_join(F.map_keys(complex.map_filter("m", "k <> 'b'")), ","))
shape("CX14_map_transform_values", "user_id * 2 AS a", a=lambda df: complex.map_transform_values("m", "v * 2")["a"])
text("CX15_unnest_array", "SELECT vec_id, count(*) AS n, round(sum(x), 4) AS s FROM (SELECT vec_id, explode(embedding) AS x FROM $embeddings) t GROUP BY vec_id", "SELECT vec_id, count(*) AS n, round(sum(x::DOUBLE), 4) AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) t GROUP BY vec_id")


# ---------------------------------------------------------------- time
@query("TM02_watermark", "SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def watermark(spark, d):
    e = table(spark, d, "events")
    return e.filter(c("ts") > time.watermark(e, "ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))


text("TM01_proctime", "SELECT count(*) AS n FROM $events WHERE current_timestamp() IS NOT NULL", "SELECT count(*) AS n FROM events")
text("TM04_truncate_parts", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS epoch, ts + INTERVAL 90 MINUTES AS later, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM $events", "SELECT event_id, date_trunc('hour', ts) AS h, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch, ts + INTERVAL 90 MINUTE AS later, epoch_us(ts) AS us FROM events")

# ---------------------------------------------------------------- inherited families
text(
    "DF01_string",
    """SELECT event_id, upper(event_type) AS a, initcap(event_type) AS b, char_length(event_type) AS c, octet_length(event_type) AS d, bit_length(event_type) AS e, trim('  x ') AS f, ltrim('  x') AS g, lpad(event_type, 10, '*') AS h, rpad(event_type, 10, '*') AS i, left(event_type, 2) AS j, right(event_type, 2) AS k, substr(event_type, 2, 3) AS l,
    split_part('a-b-c', '-', 2) AS m, replace(event_type, 'i', 'I') AS n, translate(event_type, 'abc', 'xyz') AS o, reverse(event_type) AS p, repeat('ab', 2) AS q, concat_ws('-', event_type, 'z') AS r, startswith(event_type, 'c') AS s, endswith(event_type, 'k') AS t, contains(event_type, 'li') AS u, CAST(locate('i', event_type) AS BIGINT) AS v, ascii(event_type) AS w, chr(65) AS x, lower(hex(user_id)) AS y, CAST(levenshtein(event_type, 'click') AS BIGINT) AS z,
    substring_index('a.b.c', '.', 2) AS aa, overlay('abcdef' PLACING 'ZZ' FROM 2 FOR 3) AS ab, find_in_set('b', 'a,b,c') AS ac, btrim('xxaxx', 'x') AS ad FROM $events""",
    """SELECT event_id, upper(event_type) AS a, upper(event_type[1]) || event_type[2:] AS b, CAST(length(event_type) AS INT) AS c, CAST(strlen(event_type) AS INT) AS d, CAST(strlen(event_type) * 8 AS INT) AS e, trim('  x ') AS f, ltrim('  x') AS g, lpad(event_type, 10, '*') AS h, rpad(event_type, 10, '*') AS i, left(event_type, 2) AS j, right(event_type, 2) AS k, substr(event_type, 2, 3) AS l,
    split_part('a-b-c', '-', 2) AS m, replace(event_type, 'i', 'I') AS n, translate(event_type, 'abc', 'xyz') AS o, reverse(event_type) AS p, repeat('ab', 2) AS q, concat_ws('-', event_type, 'z') AS r, starts_with(event_type, 'c') AS s, ends_with(event_type, 'k') AS t, contains(event_type, 'li') AS u, instr(event_type, 'i') AS v, ascii(event_type) AS w, chr(65) AS x, lower(to_hex(user_id)) AS y, levenshtein(event_type, 'click') AS z,
    'a.b' AS aa, 'aZZef' AS ab, CAST(2 AS INT) AS ac, 'a' AS ad FROM events""",
)
text(
    "DF02_regex",
    r"SELECT event_id, event_type RLIKE '^c.*k$' AS a, regexp_replace(event_type, '[aeiou]', '_') AS b, regexp_extract(event_type, '([a-z])i', 1) AS c, CAST(regexp_count(event_type, '[aeiou]') AS BIGINT) AS d, CAST(regexp_instr(event_type, 'i') AS BIGINT) AS e FROM $events",
    r"SELECT event_id, regexp_matches(event_type, '^c.*k$') AS a, regexp_replace(event_type, '[aeiou]', '_', 'g') AS b, regexp_extract(event_type, '([a-z])i', 1) AS c, CAST(len(regexp_extract_all(event_type, '[aeiou]')) AS BIGINT) AS d, instr(event_type, 'i') AS e FROM events",
)
text(
    "DF03_math",
    """SELECT event_id, abs(-value) AS a, CAST(ceil(value) AS DOUBLE) AS b, CAST(floor(value) AS DOUBLE) AS c, round(value, 2) AS d, round(sqrt(value), 8) AS e, round(cbrt(value), 8) AS f, round(power(value, 2), 4) AS g, round(exp(value / 100), 8) AS h, round(ln(value + 1), 8) AS i, round(log10(value + 1), 8) AS j, round(log2(value + 1), 8) AS k, round(sin(value), 8) AS l, round(cos(value), 8) AS m, round(tan(value / 100), 8) AS n,
    round(atan2(value, 2), 8) AS o, round(sinh(value / 100), 8) AS p, round(degrees(value), 6) AS q, round(radians(value), 8) AS r, CAST(sign(value) AS DOUBLE) AS s, CAST(factorial(5) AS BIGINT) AS t, round(pi(), 8) AS u, isnan(value) AS v, value = 0 AS w FROM $events""",
    """SELECT event_id, abs(-value) AS a, CAST(ceil(value) AS DOUBLE) AS b, CAST(floor(value) AS DOUBLE) AS c, round(value, 2) AS d, round(sqrt(value), 8) AS e, round(cbrt(value), 8) AS f, round(power(value, 2), 4) AS g, round(exp(value / 100), 8) AS h, round(ln(value + 1), 8) AS i, round(log10(value + 1), 8) AS j, round(log2(value + 1), 8) AS k, round(sin(value), 8) AS l, round(cos(value), 8) AS m, round(tan(value / 100), 8) AS n,
    round(atan2(value, 2), 8) AS o, round((exp(value / 100) - exp(-value / 100)) / 2, 8) AS p, round(degrees(value), 6) AS q, round(radians(value), 8) AS r, CAST(sign(value) AS DOUBLE) AS s, CAST(120 AS BIGINT) AS t, round(pi(), 8) AS u, isnan(value) AS v, value = 0 AS w FROM events""",
)
text("DF04_conditional", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS a, nullif(user_id, 3) AS b, ifnull(nullif(event_type, 'view'), '-') AS c, greatest(value, 50.0D) AS d, least(user_id, 10L) AS e, nvl2(nullif(event_type, 'view'), 1, 2) AS f, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS g FROM $events", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS a, nullif(user_id, 3) AS b, ifnull(nullif(event_type, 'view'), '-') AS c, greatest(value, 50.0::DOUBLE) AS d, least(user_id, 10) AS e, CASE WHEN event_type <> 'view' THEN 1 ELSE 2 END AS f, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS g FROM events")
text("DF05_datetime", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS a, CAST(extract(HOUR FROM ts) AS BIGINT) AS b, CAST(date_part('doy', ts) AS BIGINT) AS c, date_format(ts, 'yyyy-MM-dd HH:mm') AS d, make_date(2024, 1, 5) AS e, CAST(ts AS DATE) AS f, datediff(CAST(ts AS DATE), DATE '2024-01-01') AS g FROM $events", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS a, CAST(extract(HOUR FROM ts) AS BIGINT) AS b, CAST(date_part('doy', ts) AS BIGINT) AS c, strftime(ts, '%Y-%m-%d %H:%M') AS d, make_date(2024, 1, 5) AS e, CAST(ts AS DATE) AS f, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS g FROM events")
text(
    "DF06_array",
    """SELECT vec_id, CAST(size(embedding) AS BIGINT) AS a, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS b, array_contains(array(1, 2), 2) AS c, CAST(array_position(array('x', 'y'), 'y') AS BIGINT) AS d, array_join(array_distinct(array(3, 1, 3)), ',') AS e, array_join(array_sort(array(3, 1, 2)), ',') AS f, array_join(slice(array(1, 2, 3, 4), 2, 2), ',') AS g, array_join(array_remove(array(1, 2, 1), 1), ',') AS h,
    array_join(array_sort(array_union(array(1, 2), array(2, 3))), ',') AS i, array_join(array_intersect(array(1, 2), array(2, 3)), ',') AS j, array_join(array_except(array(1, 2), array(2, 3)), ',') AS k, array_join(flatten(array(array(1), array(2, 3))), ',') AS l, array_join(array_append(array(1), 2), ',') AS m, array_join(array_prepend(array(1), 2), ',') AS n, array_join(sequence(1, 4), ',') AS o FROM $embeddings""",
    """SELECT vec_id, len(embedding) AS a, round(embedding[1]::DOUBLE, 5) AS b, true AS c, CAST(2 AS BIGINT) AS d, '3,1' AS e, '1,2,3' AS f, '2,3' AS g, '2' AS h, '1,2,3' AS i, '2' AS j, '1' AS k, '1,2,3' AS l, '1,2' AS m, '2,1' AS n, '1,2,3,4' AS o FROM embeddings""",
)
text("DF07_map_struct", "SELECT event_id, element_at(map('a', user_id, 'b', event_id), 'b') AS a, named_struct('x', user_id, 'y', value).x AS b, CAST(cardinality(map('a', 1)) AS BIGINT) AS c, struct(event_type AS t).t AS d FROM $events", "SELECT event_id, event_id AS a, user_id AS b, CAST(1 AS BIGINT) AS c, event_type AS d FROM events")
text("DF08_hash_encode", "SELECT event_id, md5(event_type) AS a, sha2(event_type, 256) AS b, lower(hex(event_type)) AS c, base64(CAST(event_type AS BINARY)) AS d, CAST(unbase64(base64(CAST(event_type AS BINARY))) AS STRING) AS e FROM $events", "SELECT event_id, md5(event_type) AS a, sha256(event_type) AS b, lower(hex(event_type)) AS c, base64(event_type::BLOB) AS d, event_type AS e FROM events")
text("DF09_misc", "SELECT event_id, typeof(user_id) AS a, length(uuid()) AS b, CAST(user_id AS STRING) AS c FROM $events", "SELECT event_id, 'bigint' AS a, CAST(36 AS INT) AS b, CAST(user_id AS VARCHAR) AS c FROM events")


@query("DF05_date_bin", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS a, time_bucket(INTERVAL '7 hours', ts, TIMESTAMP '2024-01-01 01:00:00') AS b FROM events")
def date_bin(spark, d):
    return table(spark, d, "events").select("event_id", time.date_bin("15 minutes", c("ts")).alias("a"), time.date_bin("7 hours", c("ts"), "2024-01-01 01:00:00").alias("b"))


@query("DF03_number_theory", "SELECT event_id, gcd(user_id, 12) AS a, lcm(user_id, 12) AS b, trunc(value) AS c FROM events")
def number_theory(spark, d):
    scalar.register(spark)
    return table(spark, d, "events").select("event_id", F.call_function("gcd", c("user_id"), F.lit(12).cast("long")).alias("a"), F.call_function("lcm", c("user_id"), F.lit(12).cast("long")).alias("b"), scalar.trunc(c("value")).alias("c"))


# ---------------------------------------------------------------- model functions
@query("AI02_sentiment", "SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END::DOUBLE AS mood FROM events")
def sentiment(spark, d):
    e = table(spark, d, "events").withColumn("note", F.when(c("event_type") == "click", "great, love it").when(c("event_type") == "error", "awful and broken").otherwise("plain"))
    return ai.infer(e, "sentiment", "note", "mood").select("event_id", "mood")


@query("AI01_classify")
def classify(spark, d):
    return ai.infer(table(spark, d, "conversations"), "classify", "text", "topic", labels=["question", "answer", "other"]).select("conv_id", "turn", "topic")


@query("AI03_embed")
def embed(spark, d):
    return ai.infer(table(spark, d, "conversations"), "embed", "text", "vector").select("conv_id", "turn", "vector")


@query("AI05_infer_once", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def infer_once(spark, d):
    """Each distinct text is inferred once and joined back."""
    return ai.infer(table(spark, d, "events"), "embed", "event_type", "v").filter("size(v) = 16").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
