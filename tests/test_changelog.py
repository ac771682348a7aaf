import pytest
from pyspark.sql import functions as F

from eddyflow.errors import ChangelogError
from eddyflow.operators import changelog as cl
from eddyflow.streaming import run, stateful


def log(spark, rows):
    return spark.createDataFrame(rows, "region string, total long, __weight long")


def test_upserts(spark):
    key = lambda rows: sorted(map(tuple, cl.upserts(log(spark, rows), ["region"]).collect()))
    assert key([("east", 10, -1), ("east", 20, 1), ("east", 20, -1), ("east", 35, 1)]) == [("east", 35, "U")]
    assert key([("east", 10, 1), ("east", 10, -1)]) == []
    assert key([("east", 30, 1), ("east", 10, -1), ("north", 99, 1), ("west", 5, -1)]) == [("east", 30, "U"), ("north", 99, "U"), ("west", 5, "D")]
    assert key([("east", 10, 3)]) == [("east", 10, "U")]
    with pytest.raises(Exception, match="not unique"):
        key([("east", 10, 1), ("east", 20, 1)])


def test_aggregate_over_changes(spark):
    x = log(spark, [("a", 5, 1), ("a", 9, 1), ("a", 9, -1), ("b", 1, 1), ("b", 1, -1), ("c", None, 1)])
    got = cl.aggregate(x, ["region"], {"n": ("count", None), "k": ("count", "total"), "s": ("sum", "total"), "m": ("avg", "total"), "hi": ("max", "total")}).orderBy("region").collect()
    assert [tuple(r) for r in got] == [("a", 1, 1, 5, 5.0, 5), ("c", 1, 0, None, None, None)]
    with pytest.raises(ChangelogError):
        cl.aggregate(x, ["region"], {"m": ("median", "total")})


def test_diff_with_nan(spark):
    a = spark.createDataFrame([("x", float("nan")), ("y", 1.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", float("nan")), ("y", 2.0), ("z", None)], "k string, v double")
    assert sorted(map(tuple, cl.diff(a, b, ["k"]).collect())) == [("y", 1.0, -1), ("y", 2.0, 1)]


def test_collapse(spark):
    x = spark.createDataFrame([("a", 1, "I"), ("a", 2, "D"), ("b", 1, "I"), ("b", 3, "U+")], "k string, seq long, _op string")
    assert sorted(map(tuple, cl.collapse(x, ["k"], "seq").collect())) == [("a", 2, "D"), ("b", 3, "U")]


def changes(spark, ts, frontiers, **options):
    x = spark.createDataFrame([(ts,)], "ts long").withColumn("ts", F.timestamp_millis("ts"))
    return [(r["__weight"], r["__at"]) for r in cl.temporal_filter(x, "ts", frontiers=frontiers, **options).orderBy("__at").collect()]


def test_temporal_filter(spark):
    keep = {"lower": "-10 s", "lower_strict": True}
    assert changes(spark, 50_000, [55_000, 59_999, 60_000, 70_000], **keep) == [(1, 55_000), (-1, 60_000)]
    assert changes(spark, 50_000, [500_000], **keep) == []
    assert changes(spark, 100_000, [99_000, 100_000, 102_000], upper="0 s", upper_strict=True) == [(1, 102_000)]


def test_stream_temporal_filter(spark, tmp_path):
    """Rows in a window of time that come late or with a known key are in; what has left, or has no time, gives nothing; no Python runs."""
    files = [[(1, 50_000), (2, 100_000)], [(3, 95_000)], [(4, 70_000), (5, 99_500), (6, None), (2, 101_000), (2, 100_000)], [(7, 121_000), (8, 111_000)]]
    for rows in files:
        x = spark.createDataFrame(rows, "k int, ts long").withColumn("ts", F.timestamp_millis("ts"))
        x.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = stateful.temporal_filter(run.with_watermark(run.file_stream(spark, f"{tmp_path}/in", x.schema), "ts"), "k", "ts", "10 s")
    assert "Pandas" not in got._jdf.queryExecution().analyzed().toString()
    left = [(1, 50_000), (2, 100_000), (2, 101_000), (3, 95_000), (5, 99_500)]
    want = [(k, t, 1) for k, t in [*left, (7, 121_000), (8, 111_000)]] + [(k, t, -1) for k, t in left]
    assert sorted(map(tuple, run.drain(got).select("k", F.unix_millis("ts"), cl.WEIGHT).collect())) == sorted(want)


def test_upsert_table(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, cl.upsert_table(t, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
