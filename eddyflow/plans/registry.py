"""All queries of the engine by name, and the equivalent SQL of each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) as query ``name``, with the SQL it must equal."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query given as SQL, in which ``$name`` is a table; the oracle's is the same unless given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(re.sub(r"\$(\w+)", lambda m: f"parquet.`{d}/{m[1]}.parquet`", spark_sql))

    QUERIES[name] = run
    ORACLE[name] = re.sub(r"\$(\w+)", r"\1", oracle or spark_sql)
