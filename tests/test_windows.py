import pytest
from pyspark.sql import functions as F

from eddyflow.errors import WindowError
from eddyflow.operators import windows as w


def at(df, name="ts"):
    return df.withColumn(name, F.timestamp_millis(name))


def sums(df, window):
    x = w.aggregate(df, window, [], [F.sum("v").alias("s")])
    return sorted((r[0], r[1]) for r in x.select(F.unix_millis(F.col("window_start").cast("timestamp")), "s").collect())


@pytest.fixture(scope="module")
def rows(spark):
    return at(spark.createDataFrame([(100, 10), (500, 20), (800, 30)], "ts long, v long"))


def test_tumble(spark, rows):
    assert sums(rows, w.tumble("ts", 1000)) == [(0, 60)]
    assert sums(rows, w.tumble("ts", 1000, 200)) == [(-800, 10), (200, 50)]


def test_hop(spark):
    x = at(spark.createDataFrame([(1000, 10), (3000, 20)], "ts long, v long"))
    assert sums(x, w.hop("ts", 2000, 4000)) == [(-2000, 10), (0, 30), (2000, 20)]
    with pytest.raises(WindowError):
        w.hop("ts", 10_000, 5_000)


@pytest.mark.parametrize(("gap", "ts", "expected"), [(5000, [1000, 3000, 4000], [(1000, 3)]), (2000, [1000, 5000, 6000], [(1000, 1), (5000, 2)]), (3000, [1000, 5000, 3500], [(1000, 3)]), (1000, [1000, 2000], [(1000, 2)])])
def test_session(spark, gap, ts, expected):
    assert sums(at(spark.createDataFrame([(t, 1) for t in ts], "ts long, v long")), w.session("ts", gap)) == expected


def test_cumulate(spark):
    x = at(spark.createDataFrame([(500, 1), (1500, 1), (2500, 1), (-1, 1)], "ts long, v long"))
    got = w.assign_cumulate(x, "ts", 1000, 3000).groupBy(F.unix_millis(F.col("window_start").cast("timestamp")).alias("a"), F.unix_millis(F.col("window_end").cast("timestamp")).alias("b")).agg(F.sum("v")).collect()
    assert sorted(map(tuple, got)) == [(-3000, 0, 1), (0, 1000, 1), (0, 2000, 2), (0, 3000, 3)]
    with pytest.raises(WindowError):
        w.assign_cumulate(x, "ts", 2000, 3000)


def test_scalars(spark):
    x = at(spark.createDataFrame([(420_000,), (300_000,), (None,)], "ts long"))
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    got = x.select(ms(w.tumble_start(F.col("ts"), "5m")), ms(w.tumble_end(F.col("ts"), "5m")), ms(w.hop_start(F.col("ts"), "5m", "10m")), ms(w.cumulate_end(F.col("ts"), "1m", "5m"))).collect()
    assert [tuple(r) for r in got] == [(300_000, 600_000, 0, 600_000), (300_000, 600_000, 0, 600_000), (None,) * 4]
    for bad in (lambda: w.tumble_start(F.col("ts"), 0), lambda: w.micros("1 month"), lambda: w.micros("soon"), lambda: w.hop_sizes(1, 100_000)):
        with pytest.raises(WindowError):
            bad()


def test_durations():
    assert [w.micros(x) for x in ("5", "100ms", "5s", "10m", "2h", "1 day 2 hours", 3)] == [5_000_000, 100_000, 5_000_000, 600_000_000, 7_200_000_000, 93_600_000_000, 3_000]


def test_closed(spark, rows):
    x = w.aggregate(rows, w.tumble("ts", 500), [], [F.count(F.lit(1)).alias("n")])
    mark = F.timestamp_millis(F.lit(1000))
    assert w.closed(x, mark).count() == 2
    assert w.closed(x, mark, 500).count() == 1
