"""Properties over generated rows: streams equal batches, changelogs equal recomputation, rewrites equal loops."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eddyflow.operators import changelog as cl
from eddyflow.operators import windows as w
from eddyflow.sql import lex
from eddyflow.streaming import run, stateful

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
EVENTS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60_000), st.integers(-5, 5)), min_size=1, max_size=30)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts long, v long").withColumn("ts", F.timestamp_millis("ts"))


@FEW
@given(rows=EVENTS, gap=st.integers(1, 20_000))
def test_sessions(spark, rows, gap):
    want = []
    for k in sorted({r[0] for r in rows}):
        last = None
        for t, v in sorted((t, v) for kk, t, v in rows if kk == k):
            if last is not None and t - last <= gap:
                want[-1][2] += v
            else:
                want.append([k, t, v])
            last = t
    x = w.aggregate(frame(spark, rows), w.session("ts", gap), ["k"], [F.sum("v").alias("s")])
    assert sorted([r["k"], r["t"], r["s"]] for r in x.select("k", F.unix_millis(F.col("window_start").cast("timestamp")).alias("t"), "s").collect()) == sorted(want)


@FEW
@given(rows=EVENTS, slide=st.sampled_from([500, 1000, 3000]), times=st.integers(1, 4))
def test_hops(spark, rows, slide, times):
    size = slide * times
    want: dict = {}
    for _, t, v in rows:
        for k in range(times):
            start = t // slide * slide - k * slide
            want[start] = want.get(start, 0) + v
    x = w.aggregate(frame(spark, rows), w.hop("ts", slide, size), [], [F.sum("v").alias("s")])
    assert {r["t"]: r["s"] for r in x.select(F.unix_millis(F.col("window_start").cast("timestamp")).alias("t"), "s").collect()} == want


@FEW
@given(rows=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3), st.sampled_from([1, 1, 1, -1])), max_size=25))
def test_changelog_aggregates(spark, rows):
    """Sums over the changes equal sums over what the changes leave."""
    left: dict = {}
    for k, v, n in rows:
        left[k, v] = left.get((k, v), 0) + n
    rows = rows + [(k, v, -n) for (k, v), n in left.items() if n < 0]
    left = {x: n for x, n in left.items() if n > 0}
    got = cl.aggregate(spark.createDataFrame(rows, "k string, v long, __weight long"), ["k"], {"n": ("count", None), "s": ("sum", "v"), "hi": ("max", "v")}).collect()
    want = {k: (sum(n for (a, _), n in left.items() if a == k), sum(v * n for (a, v), n in left.items() if a == k), max(v for (a, v) in left if a == k)) for k in {a for a, _ in left}}
    assert {r["k"]: (r["n"], r["s"], r["hi"]) for r in got} == want


def test_stream_changelog_equals_batch(spark, tmp_path):
    rows = [(k, t, v) for t, (k, v) in enumerate(zip("abcab" * 8, range(40), strict=False))]
    src = run.replay(frame(spark, rows), "ts", 3, str(tmp_path / "in"))
    got = cl.consolidate(run.drain(stateful.emit_changes(src, ["k"], "v")))
    want = {k: (sum(1 for r in rows if r[0] == k), float(sum(r[2] for r in rows if r[0] == k))) for k in "abc"}
    assert {r["k"]: (r["n"], r["total"]) for r in got.collect()} == want


@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.sampled_from(["SELECT 1", "'a;b'", "-- c;\n", "/* ; */", "f(x, 'y)')", '"q;"', "1.5"]), max_size=6))
def test_statements_split_outside_strings(parts):
    text = " ".join(parts)
    found = lex.statements(text + ";" + "SELECT 2")
    assert found[-1] == "SELECT 2" and len(found) == (2 if any(not p.startswith(("--", "/*")) for p in parts) else 1)
