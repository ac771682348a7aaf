"""User-defined functions: registration of scalar, aggregate and table functions on Arrow batches."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def geometric_mean(x: Column) -> Column:
    """An aggregate composed of built-ins, so that it keeps partial aggregation."""
    return F.exp(F.avg(F.ln(x)))


def on_series(f: Callable) -> Callable:
    """Annotate a function's parameters and result as Series, as Spark asks."""
    names = list(inspect.signature(f).parameters)
    f.__annotations__ = {n: pd.Series for n in [*names, "return"]}
    return f


def register_scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> None:
    """Register a function of pandas Series, a batch at a time, for SQL and the DataFrame API."""
    spark.udf.register(name, F.pandas_udf(on_series(f), returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str) -> None:
    """Register a grouped aggregate of a Series (a whole group at once: for groups that fit a task)."""

    def run(x):
        return f(x)

    run.__annotations__ = {"x": pd.Series, "return": float}
    spark.udf.register(name, F.pandas_udf(run, returns))


def register_table(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], returns: str) -> None:
    """Register a table function: ``f`` yields rows."""

    class Table:
        def eval(self, *args):
            yield from f(*args)

    spark.udtf.register(name, F.udtf(Table, returnType=returns))


def json_tables(spark: SparkSession) -> None:
    """Table functions over a JSON text: array elements, object entries and keys, with 1-based order."""
    import json

    def elements(j: str):
        v = json.loads(j) if j else []
        yield from ((i, json.dumps(x, separators=(",", ":"))) for i, x in enumerate(v if isinstance(v, list) else [], 1))

    def elements_text(j: str):
        v = json.loads(j) if j else []
        yield from ((i, x if isinstance(x, str) or x is None else json.dumps(x, separators=(",", ":"))) for i, x in enumerate(v if isinstance(v, list) else [], 1))

    def entries(j: str):
        v = json.loads(j) if j else {}
        yield from ((i, k, json.dumps(x, separators=(",", ":"))) for i, (k, x) in enumerate(v.items() if isinstance(v, dict) else [], 1))

    def entries_text(j: str):
        v = json.loads(j) if j else {}
        yield from ((i, k, x if isinstance(x, str) or x is None else json.dumps(x, separators=(",", ":"))) for i, (k, x) in enumerate(v.items() if isinstance(v, dict) else [], 1))

    def keys(j: str):
        v = json.loads(j) if j else {}
        yield from enumerate(v if isinstance(v, dict) else [], 1)

    register_table(spark, "jsonb_array_elements", elements, "ordinality: int, value: string")
    register_table(spark, "jsonb_array_elements_text", elements_text, "ordinality: int, value: string")
    register_table(spark, "jsonb_each", entries, "ordinality: int, key: string, value: string")
    register_table(spark, "jsonb_each_text", entries_text, "ordinality: int, key: string, value: string")
    register_table(spark, "jsonb_object_keys", keys, "ordinality: int, key: string")
