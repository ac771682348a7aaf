"""Scalar functions of other dialects that Spark lacks or spells otherwise, and their registration in SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL functions by name: (parameters, body). Registered as temporary SQL functions, so Catalyst inlines them.
SQL_FUNCTIONS = {
    "strpos": ("s STRING, t STRING", "locate(t, s)"),
    "starts_with": ("s STRING, t STRING", "startswith(s, t)"),
    "ends_with": ("s STRING, t STRING", "endswith(s, t)"),
    "to_hex": ("n BIGINT", "lower(hex(n))"),
    "trunc_number": ("x DOUBLE, n INT", "sign(x) * floor(abs(x) * pow(10, n)) / pow(10, n)"),
    "gcd": ("a BIGINT, b BIGINT", "aggregate(sequence(1, 92), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> IF(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)"),
    "lcm": ("a BIGINT, b BIGINT", "IF(a = 0 OR b = 0, 0L, abs(a) div aggregate(sequence(1, 92), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> IF(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x) * abs(b))"),
    "iszero": ("x DOUBLE", "x = 0"),
    "regexp_match_first": ("s STRING, p STRING", "regexp_extract(s, p, 0)"),
    "array_length": ("a ARRAY<STRING>", "CAST(size(a) AS BIGINT)"),
    "list_position": ("a ARRAY<STRING>, x STRING", "nullif(array_position(a, x), 0)"),
    "date_bin_us": ("step BIGINT, ts TIMESTAMP_NTZ", "CAST(timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) - pmod(unix_micros(CAST(ts AS TIMESTAMP)), step)) AS TIMESTAMP_NTZ)"),
}


def register(spark: SparkSession) -> None:
    """Make the functions available to ``spark.sql``."""
    for name, (parameters, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")


def strpos(s: Column, t: Column) -> Column:
    return F.locate(t, s) if isinstance(t, str) else F.instr(s, t)


def gcd(a: Column, b: Column) -> Column:
    return F.call_function("gcd", a, b)


def nanvl(a: Column, b: Column) -> Column:
    return F.nanvl(a, b)


def trunc(x: Column, places: int = 0) -> Column:
    """Cut to ``places`` decimals towards zero."""
    k = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * k) / k
