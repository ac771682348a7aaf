import json as js

import pytest
from pyspark.sql import functions as F

from eddyflow.errors import ConfigError, SqlError
from eddyflow.functions import ai, json, time, udf


def one(spark, column, *texts):
    column = column.f() if isinstance(column, Late) else column
    return spark.createDataFrame([texts], ", ".join(f"{c} string" for c in "abc"[: len(texts)])).select(column).first()[0]


class Late:
    """A column named before there is a session."""

    def __init__(self, f):
        self.f = f


def late(f, *args):
    return Late(lambda: f(*(F.col(x.lower()) if isinstance(x, str) and x in ("A", "B") else x for x in args)))


@pytest.mark.parametrize(
    ("column", "texts", "expected"),
    [
        (late(json.merge, "A", "B"), ('{"a":1,"b":2}', '{"b":99,"c":3}'), {"a": 1, "b": 99, "c": 3}), (late(json.merge, "A", "B"), ("42", '"hello"'), "hello"),
        (late(json.deep_merge, "A", "B"), ('{"a":{"x":1,"y":2},"b":10}', '{"a":{"y":99,"z":3},"c":20}'), {"a": {"x": 1, "y": 99, "z": 3}, "b": 10, "c": 20}),
        (late(json.strip_nulls, "A"), ('{"a":1,"b":null,"c":{"d":null,"e":2},"f":[null]}',), {"a": 1, "c": {"e": 2}, "f": [None]}),
        (late(json.flatten, "A"), ('{"a":{"b":1,"c":[2,3]},"e":{}}',), {"a.b": 1, "a.c.0": 2, "a.c.1": 3}), (late(json.unflatten, "A"), ('{"a.b":1,"a.c":2,"d":3}',), {"a": {"b": 1, "c": 2}, "d": 3}),
        (late(json.infer_schema, "A"), ('{"tags":[1,2],"meta":{"x":1.5}}',), {"tags": "ARRAY<BIGINT>", "meta": "STRUCT(x DOUBLE)"}), (late(json.rename_keys, "A", {"k": "z"}), ('{"k":1}',), {"z": 1}), (late(json.pick, "A", ["k"]), ('{"k":1,"l":2}',), {"k": 1}), (late(json.drop, "A", ["k"]), ('{"k":1,"l":2}',), {"l": 2}),
    ],
)
def test_json_values(spark, column, texts, expected):
    assert js.loads(one(spark, column, *texts)) == expected


@pytest.mark.parametrize(
    ("a", "b", "expected"), [('{"x":1,"y":2}', '{"x":1}', True), ("[1,2,3]", "[2]", True), ("1", "1.0", False), ('{"x":{"y":[1]}}', '{"x":{"y":[1,2]}}', False), ("nonsense", "1", None)]
)
def test_json_contains(spark, a, b, expected):
    assert one(spark, late(json.contains, "A", "B"), a, b) is expected


def test_json_access(spark):
    A = F.col("a")
    j = '{"k":{"n":[10,{"z":null}]},"s":"text","ok":true}'
    assert one(spark, json.get(A, "k"), j) == '{"n":[10,{"z":null}]}'
    assert one(spark, json.get_path_text(A, ["k", "n", "0"]), j) == "10"
    assert one(spark, json.typeof(A), "3") == "number"
    assert one(spark, json.path_exists(A, "$.k.n[1].z"), j) is True
    assert one(spark, json.path_match(A, "$.ok"), j) is True
    assert one(spark, json.from_json(A), "{bad") is None
    assert one(spark, json.infer_schema(A), "42") == "BIGINT"


def test_json_aggregates(spark):
    x = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", None, 3)], "k string, v int, t int")
    assert js.loads(x.agg(json.json_object_agg("k", "v", "t")).first()[0]) == {"a": 2, "b": None}
    assert sorted(js.loads(x.agg(json.json_agg("v")).first()[0]), key=str) == [1, 2, None]


def test_time(spark):
    A = F.col("a")
    assert time.pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy' at 'HH:mm"
    with pytest.raises(SqlError):
        time.pattern("%Q")
    with pytest.raises(SqlError):
        time.parse_epoch(F.lit(1), "weeks")
    assert str(one(spark, time.parse_timestamp(A, "%d.%m.%Y"), "05.01.2024")) == "2024-01-05 00:00:00"
    assert one(spark, time.parse_timestamp(A, "%d.%m.%Y"), "x") is None


def test_models(spark):
    x = spark.createDataFrame([("good",), ("bad",), (None,), ("good",)], "t string")
    assert sorted((r["t"] or "", r["s"]) for r in ai.infer(x, "sentiment", "t", "s").collect()) == [("", None), ("bad", -1.0), ("good", 1.0), ("good", 1.0)]
    with pytest.raises(ConfigError):
        ai.infer(x, "translate", "t", "s")


def test_user_functions(spark):
    udf.register_scalar(spark, "plus_one", lambda x: x + 1, "long")
    udf.register_aggregate(spark, "spread", lambda x: float(x.max() - x.min()), "double")
    x = spark.createDataFrame([(1,), (5,)], "v long")
    x.createOrReplaceTempView("uf")
    assert spark.sql("SELECT sum(plus_one(v)) FROM uf").first() == (8,)
    assert spark.sql("SELECT spread(v) FROM uf").first() == (4.0,)
    udf.json_tables(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM jsonb_array_elements_text('[1,\"x\",null]')").collect()] == [(1, "1"), (2, "x"), (3, None)]
