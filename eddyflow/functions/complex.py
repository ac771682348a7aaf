"""Struct, map and array functions; lambdas may be given as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyflow.errors import SqlError


def struct_extract(s: Column, field: str) -> Column:
    return s.getField(field)


def struct_set(s: Column, field: str, value: Column) -> Column:
    return s.withField(field, value)


def struct_drop(s: Column, field: str) -> Column:
    return s.dropFields(field)


def fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.fieldNames()


def struct_rename(df: DataFrame, column: str, old: str, new: str) -> Column:
    names = fields(df, column)
    if old not in names:
        raise SqlError(f"{column} has no field {old!r}")
    return F.struct(*[F.col(column)[f].alias(new if f == old else f) for f in names])


def struct_merge(df: DataFrame, a: str, b: str) -> Column:
    """Fields of both; those of the second win."""
    fb = fields(df, b)
    fa = fields(df, a)
    return F.struct(*[(F.col(b) if f in fb else F.col(a))[f].alias(f) for f in [*fa, *(f for f in fb if f not in fa)]])


map_keys, map_values, map_from_arrays = F.map_keys, F.map_values, F.map_from_arrays


def map_contains_key(m: Column, key) -> Column:
    return F.map_contains_key(m, key)


def array_transform(a: str, body: str) -> Column:
    """``array_transform('xs', 'x + 1')``: the body sees ``x``."""
    return F.expr(f"transform({a}, x -> {body})")


def array_filter(a: str, body: str) -> Column:
    return F.expr(f"filter({a}, x -> {body})")


def array_reduce(a: str, start: str, body: str) -> Column:
    """The body sees ``acc`` and ``x``."""
    return F.expr(f"aggregate({a}, {start}, (acc, x) -> {body})")


def map_filter(m: str, body: str) -> Column:
    """The body sees ``k`` and ``v``."""
    return F.expr(f"map_filter({m}, (k, v) -> {body})")


def map_transform_values(m: str, body: str) -> Column:
    return F.expr(f"transform_values({m}, (k, v) -> {body})")
