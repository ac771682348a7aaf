"""Every query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from eddyflow.plans import everything as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) and v != v:
        return "nan"
    return 0.0 if v == 0 and isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in registry.ORACLE:
        assert got
        return
    found = duck.sql(registry.ORACLE[name])
    names = list(found.columns)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, small):
    """Filters reach the scan, few columns are read, nothing but declared functions runs in Python."""
    explain = lambda name: spark._jvm.PythonSQLUtils.explainString(registry.QUERIES[name](spark, small)._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(o_orderkey)" in explain("S17_pushdown")
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in explain("P08_distinct")
    for name in ("W02_hop", "J09_asof_nearest", "J07_interval_full", "X04_collapse", "J10_temporal_probe"):
        assert "Python" not in explain(name) and "InArrow" not in explain(name)
    assert "CartesianProduct" not in explain("J07_interval_inner")
    assert "_key#" in explain("API6_asof") and "_b#" in explain("API6_asof")  # a hot key is cut by time
