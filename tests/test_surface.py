import pytest

from eddyflow.engine import Engine
from eddyflow.errors import StreamError, WindowError


def test_fall_back(spark, tmp_path):
    """Offsets that cannot be read, a wished epoch, nothing whole; later epochs of the view go."""
    from eddyflow.streaming import recovery, run, views

    x = run.replay(spark.range(40).selectExpr("id", "timestamp_seconds(id) AS ts"), "ts", 4, f"file://{tmp_path}/in")
    view, cp = views.View(spark, f"file://{tmp_path}/view"), f"file://{tmp_path}/cp"
    again = lambda: run.start(x.select("id"), mode="append", sink=view, available=True, checkpoint=cp).awaitTermination()
    again()
    assert view.epochs() == [0, 1, 2, 3]
    (tmp_path / "cp" / "offsets" / "3").write_text("v1\n{")
    assert recovery.fall_back(spark, cp, view=view) == 2
    assert view.epochs() == [0, 1, 2]
    assert recovery.fall_back(spark, cp, to=0, view=view) == 0
    again()
    assert sorted(r.id for r in view.read().collect()) == list(range(40))
    with pytest.raises(StreamError):
        recovery.fall_back(spark, cp, to=-1)
    with pytest.raises(StreamError):
        recovery.fall_back(spark, f"file://{tmp_path}/none")


def test_window_tables(spark):
    """Rows without a time are in no window; a hop that does not divide its size; alias or none; sessions are refused."""
    e = Engine(spark)
    e.execute("CREATE TABLE t (a INT, ts TIMESTAMP); INSERT INTO t VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:05'), (2, NULL)")
    assert [tuple(r) for r in e.sql("SELECT a, CAST(window_start AS STRING) FROM TUMBLE(t, ts, INTERVAL '10' SECOND)").collect()] == [(1, "2024-01-01 00:00:00")]
    assert [r[0] for r in e.sql("SELECT CAST(w.window_start AS STRING) FROM HOP(t, ts, INTERVAL '2' SECOND, INTERVAL '5' SECOND) AS w ORDER BY 1").collect()] == ["2024-01-01 00:00:02", "2024-01-01 00:00:04"]
    assert e.sql("SELECT t.a FROM TUMBLE(t, ts, INTERVAL '10' SECOND, INTERVAL '3' SECOND) WHERE t.a > 0").count() == 1
    with pytest.raises(WindowError):
        e.sql("SELECT a FROM SESSION(t, ts, INTERVAL '10' SECOND)")
