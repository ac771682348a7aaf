import itertools
import random

import pytest
from pyspark.sql import functions as F

from eddyflow.errors import JoinError
from eddyflow.operators import joins

TRADES = [("AAPL", 100, 150.0), ("AAPL", 200, 152.0), ("GOOG", 150, 2800.0), ("AAPL", 300, 155.0)]
QUOTES = [("AAPL", 90, 149.0), ("AAPL", 180, 151.0), ("GOOG", 140, 2790.0), ("AAPL", 250, 153.0), ("GOOG", 160, 2795.0)]


def times(df, *names):
    for n in names:
        df = df.withColumn(n, F.timestamp_millis(n))
    return df


@pytest.fixture(scope="module")
def sides(spark):
    return times(spark.createDataFrame(TRADES, "sym string, t long, price double"), "t"), times(spark.createDataFrame(QUOTES, "rsym string, q long, bid double"), "q")


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, [90, 180, 140, 250]), ({"direction": "forward"}, [180, 250, 160, None]), ({"tolerance": "15ms"}, [90, None, 140, None]), ({"direction": "nearest"}, [90, 180, 140, 250]),
    ],
)
@pytest.mark.parametrize("bucket", [None, "50ms", "1s"])
def test_asof(sides, options, expected, bucket):
    got = joins.asof_join(*sides, [("sym", "rsym")], "t", "q", bucket=bucket, **options).select(F.unix_millis("t"), F.unix_millis("q")).collect()
    assert dict(map(tuple, got)) == dict(zip([100, 200, 150, 300], expected, strict=True))


def test_asof_ties_and_nulls(spark):
    l = times(spark.createDataFrame([("a", 10), (None, 10), ("a", None)], "k string, t long"), "t")
    r = times(spark.createDataFrame([("a", 5, 1), ("a", 5, 2), (None, 5, 3)], "rk string, q long, seq long"), "q")
    first = joins.asof_join(l, r, [("k", "rk")], "t", "q", order="seq").select("k", "seq").collect()
    assert sorted(map(tuple, first), key=str) == [("a", 1), ("a", None), (None, None)]
    last = joins.temporal_join(l, r, [("k", "rk")], "t", "q", order="seq").select("seq").collect()
    assert [x[0] for x in last] == [2]
    assert joins.asof_join(l, r, [("k", "rk")], "t", "q", how="inner", order="seq").count() == 1


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_against_brute_force(spark, direction):
    rng = random.Random(direction)
    left = [(i, rng.choice("ab"), rng.randrange(2000)) for i in range(60)]
    right = [(rng.choice("ab"), t, t) for t in rng.sample(range(2000), 50)]
    got = joins.asof_join(times(spark.createDataFrame(left, "id long, k string, t long"), "t"), times(spark.createDataFrame(right, "rk string, q long, v long"), "q"), [("k", "rk")], "t", "q", direction=direction, bucket="100ms")
    for r in got.select("id", "v").collect():
        _, k, t = left[r["id"]]
        able = [q for kk, q, _ in right if kk == k and (direction != "backward" or q <= t) and (direction != "forward" or q >= t)]
        assert r["v"] == min(able, key=lambda q: (abs(q - t), q), default=None)


HOW = ["inner", "left", "right", "full", "left_semi", "left_anti", "right_semi", "right_anti"]


@pytest.mark.parametrize("how", HOW)
def test_interval_against_sql(spark, how):
    rng = random.Random(7)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 1000, 7)])) for i in range(50)]
    right = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 1000, 9)])) for i in range(50)]
    l, r = times(spark.createDataFrame(left, "id long, k string, t long"), "t"), times(spark.createDataFrame(right, "rid long, rk string, q long"), "q")
    got = joins.interval_join(l, r, [("k", "rk")], "t", "q", before="20ms", after="100ms", how=how, bucket="30ms")
    near = (l.k == r.rk) & (F.unix_millis("q") >= F.unix_millis("t") - 20) & (F.unix_millis("q") <= F.unix_millis("t") + 100)
    want = r.join(l, near, how.replace("right", "left")) if how.startswith("right_") else l.join(r, near, how)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want.select(got.columns))


def test_interval_counts(spark):
    def side(rows, p):
        return times(spark.createDataFrame(rows, f"{p}k string, {p}t long"), f"{p}t")

    run = lambda a, b, how="inner": joins.interval_join(side(a, "l"), side(b, "r"), [("lk", "rk")], "lt", "rt", before="100ms", after="100ms", how=how).count()
    assert run([("A", 100), ("B", 200)], [("A", 110), ("B", 250)]) == 2
    assert run([("A", 100)], [("A", 300)]) == 0
    assert run([("A", 100)], [("B", 100)], "left") == 1
    assert run([("A", 100)], [("A", 110), ("A", 120)], "left_semi") == 1
    assert run([("A", 100), ("B", 200)], [("A", 110)], "left_anti") == 1
    with pytest.raises(JoinError):
        run([("A", 1)], [("A", 1)], "cross")


def test_probe(spark):
    market = times(spark.createDataFrame([("AAPL", 90_000, 150.0), ("AAPL", 95_000, 151.0), ("AAPL", 100_000, 152.0)], "s string, mts long, mprice double"), "mts")
    trade = times(spark.createDataFrame([("AAPL", 100_000), (None, 1)], "symbol string, ts long"), "ts")
    got = joins.temporal_probe_join(trade, market, [("symbol", "s")], "ts", "mts", joins.probe_offsets(["-5s", "-1s", "0s", "0s"])).orderBy("p_offset_ms").collect()
    assert [(r["p_offset_ms"], r["p_probe_ts"], r["mprice"]) for r in got] == [(-5000, 95_000, 151.0), (-1000, 99_000, 151.0), (0, 100_000, 152.0)]
    assert joins.probe_offsets(span=("0s", "3s", "1s")) == [0, 1000, 2000, 3000]
    with pytest.raises(JoinError):
        joins.probe_offsets([])


def test_n_way_differential(spark):
    """A chain of joins, one at a time and as one SQL statement."""
    rng = random.Random(3)
    a, b, c = ([(rng.randrange(4), rng.randrange(4), rng.randrange(100)) for _ in range(20)] for _ in range(3))
    for rows, name, ddl in ((a, "ja", "ka int, kb int, xa int"), (b, "jb", "kb2 int, kc int, xb int"), (c, "jc", "kc2 int, ka2 int, xc int")):
        spark.createDataFrame(rows, ddl).createOrReplaceTempView(name)
    step = spark.table("ja").join(spark.table("jb"), F.expr("kb = kb2")).join(spark.table("jc"), F.expr("kc = kc2 AND ka = ka2"))
    want = [(*x, *y, *z) for x, y, z in itertools.product(a, b, c) if x[1] == y[0] and y[1] == z[0] and x[0] == z[1]]
    assert sorted(map(tuple, step.collect())) == sorted(want)
