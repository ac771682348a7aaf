"""JSON functions on JSON text.

Everything that has a built-in runs in the JVM. Containment, deep merges, null
stripping, flattening and inference walk the whole value, so they are Arrow UDFs.
Missing paths give null; invalid JSON gives null; key order is that of the input.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyflow.errors import SchemaError
from eddyflow.functions.udf import on_series


def quoted(key: str) -> str:
    return "['" + key.replace("'", "\\'") + "']"


def path_of(steps: list[str | int]) -> str:
    """``$`` path of keys and indexes; digits in a list of text are indexes too."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) or s.isdigit() else quoted(s) for s in steps)


# ---------------------------------------------------------------- extraction
def get(j: Column, key: str) -> Column:
    """The value of a key as JSON text."""
    return as_json(F.try_variant_get(F.try_parse_json(j), path_of_key(key), "variant"))


def path_of_key(key: str) -> str:
    return "$" + quoted(key)


def as_json(v: Column) -> Column:
    return F.to_json(v)


def get_idx(j: Column, i: int) -> Column:
    return as_json(F.try_variant_get(F.try_parse_json(j), f"$[{i}]", "variant"))


def get_text(j: Column, key: str) -> Column:
    """The value of a key as text; strings without quotes, JSON null as null."""
    return F.get_json_object(j, path_of_key(key))


def get_text_idx(j: Column, i: int) -> Column:
    return F.get_json_object(j, f"$[{i}]")


def get_path(j: Column, steps: list[str | int]) -> Column:
    return as_json(F.try_variant_get(F.try_parse_json(j), path_of(steps), "variant"))


def get_path_text(j: Column, steps: list[str | int]) -> Column:
    return F.get_json_object(j, path_of(steps))


def keys(j: Column) -> Column:
    return F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))


def exists(j: Column, key: str) -> Column:
    return F.when(j.isNotNull(), F.array_contains(keys(j), key))


def exists_any(j: Column, names: list[str]) -> Column:
    return F.when(j.isNotNull(), F.arrays_overlap(keys(j), F.array(*map(F.lit, names))))


def exists_all(j: Column, names: list[str]) -> Column:
    return F.when(j.isNotNull(), F.size(F.array_except(F.array(*map(F.lit, names)), keys(j))) == 0)


def path_exists(j: Column, path: str) -> Column:
    """Whether a path is there, even if its value is null."""
    return F.when(j.isNotNull(), each(lambda v, p: any(True for _ in walk(v, p)), "boolean", j, F.lit(path)))


def path_match(j: Column, path: str) -> Column:
    """The boolean at a path, or null."""
    return F.try_variant_get(F.try_parse_json(j), path, "boolean")


def typeof(j: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(j))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


# ---------------------------------------------------------------- construction
def build_object(*pairs: Any) -> Column:
    """JSON object of names and columns, in turn; nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in zip(pairs[::2], pairs[1::2], strict=True)]), {"ignoreNullFields": "false"})


def build_array(*values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(to_json(v), F.lit("null")) for v in values]), F.lit("]"))


def to_json(v: Column) -> Column:
    """A value as JSON text: the only item of an array, without the brackets."""
    text = F.to_json(F.array(v), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def from_json(j: Column) -> Column:
    """The text itself if it is valid JSON, else null."""
    return F.when(F.try_parse_json(j).isNotNull(), j)


def to_columns(j: Column, ddl: str) -> Column:
    """A struct of the named fields only."""
    return F.from_json(j, ddl)


def json_agg(value: str) -> Column:
    """JSON array of a group's values, nulls included."""
    wrapped = F.collect_list(F.struct(F.col(value).alias("v")))
    return F.to_json(F.transform(wrapped, lambda x: x["v"]), {"ignoreNullFields": "false"})


def json_object_agg(key: str, value: str, order: str) -> Column:
    """JSON object of a group's keys and values; of equal keys the last by ``order`` wins."""
    rows = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: x["k"].isNotNull())
    last = F.aggregate(rows, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"].cast("string"), to_json(x["v"]))))
    text = F.array_join(F.transform(F.map_entries(last), lambda e: F.concat(to_json(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",")
    return F.concat(F.lit("{"), text, F.lit("}"))


# ---------------------------------------------------------------- objects as maps
def as_map(j: Column) -> Column:
    return F.from_json(j, "map<string,variant>")


def rename_keys(j: Column, names: dict[str, str]) -> Column:
    """Rename top-level keys."""
    return each(lambda v: {names.get(k, k): x for k, x in v.items()} if isinstance(v, dict) else v, "string", j, dump=True)


def pick(j: Column, names: list[str]) -> Column:
    return each(lambda v: {k: x for k, x in v.items() if k in names} if isinstance(v, dict) else v, "string", j, dump=True)


def drop(j: Column, names: list[str]) -> Column:
    return each(lambda v: {k: x for k, x in v.items() if k not in names} if isinstance(v, dict) else v, "string", j, dump=True)


# ---------------------------------------------------------------- whole values
class MISSING:
    """Stands for what is no JSON; a class, so that it is the same one in workers."""


def parsed(text: Any) -> Any:
    if text is None or isinstance(text, float):
        return MISSING
    try:
        return json.loads(text)
    except ValueError:
        return MISSING


def dumped(v: Any) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def each(f: Callable, kind: str, *columns: Column, dump: bool = False) -> Column:
    """Apply f to parsed JSON (the first column) and other values, a batch at a time."""

    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        out = []
        for values in zip(first, *rest, strict=True):
            v = parsed(values[0])
            r = MISSING if v is MISSING else f(v, *values[1:])
            out.append(None if r is MISSING else dumped(r) if dump else r)
        return pd.Series(out, dtype="boolean" if kind == "boolean" else object)

    one = (lambda a: run(a)) if len(columns) == 1 else (lambda a, b: run(a, b))
    return F.pandas_udf(on_series(one), kind)(*columns)


def both(f: Callable, kind: str, a: Column, b: Column, dump: bool = False) -> Column:
    def run(x: Any, y: Any) -> Any:
        y = parsed(y)
        return MISSING if y is MISSING else f(x, y)

    return each(run, kind, a, b, dump=dump)


def holds(a: Any, b: Any) -> bool:
    """Containment: objects by subset, arrays by superset, scalars by type and value."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and holds(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(holds(x, y) for x in a) for y in b)
    return type(a) is type(b) and a == b


def contains(a: Column, b: Column) -> Column:
    return both(holds, "boolean", a, b)


def contained_by(a: Column, b: Column) -> Column:
    return both(lambda x, y: holds(y, x), "boolean", a, b)


def merged(a: Any, b: Any, deep: bool) -> Any:
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return b
    return a | {k: merged(a[k], v, True) if deep and k in a else v for k, v in b.items()}


def merge(a: Column, b: Column) -> Column:
    """Shallow merge, the second's keys win; where either is no object the second is the result."""
    return both(lambda x, y: merged(x, y, False), "string", a, b, dump=True)


def deep_merge(a: Column, b: Column) -> Column:
    return both(lambda x, y: merged(x, y, True), "string", a, b, dump=True)


def without_nulls(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: without_nulls(x) for k, x in v.items() if x is not None}
    return [without_nulls(x) for x in v] if isinstance(v, list) else v


def strip_nulls(j: Column) -> Column:
    """Drop object fields that are null, at any depth; arrays keep theirs."""
    return each(without_nulls, "string", j, dump=True)


def flattened(v: Any, sep: str, name: str = "") -> dict:
    if isinstance(v, dict):
        parts = v.items()
    elif isinstance(v, list):
        parts = enumerate(v)
    else:
        return {name: v}
    out: dict = {}
    for k, x in parts:
        out |= flattened(x, sep, f"{name}{sep}{k}" if name else str(k))
    return out


def flatten(j: Column, sep: str = ".") -> Column:
    """Nested keys and indexes joined by ``sep``; empty containers vanish."""
    return each(lambda v: flattened(v, sep) if isinstance(v, dict | list) else v, "string", j, dump=True)


def unflattened(v: Any, sep: str) -> Any:
    if not isinstance(v, dict):
        return v
    out: dict = {}
    for k, x in v.items():
        at, *rest = [out, *k.split(sep)]
        for name in rest[:-1]:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[rest[-1]] = x
    return out


def unflatten(j: Column, sep: str = ".") -> Column:
    return each(lambda v: unflattened(v, sep), "string", j, dump=True)


def inferred(v: Any) -> str:
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, int):
        return "BIGINT"
    if isinstance(v, float):
        return "DOUBLE"
    if isinstance(v, list):
        return f"ARRAY<{inferred(v[0]) if v else 'VARCHAR'}>"
    if isinstance(v, dict):
        return "STRUCT(" + ", ".join(f"{k} {inferred(x)}" for k, x in v.items()) + ")"
    return "VARCHAR"


def infer_schema(j: Column) -> Column:
    """For an object a JSON object of its fields' types, else the type's name."""
    return each(lambda v: dumped({k: inferred(x) for k, x in v.items()}) if isinstance(v, dict) else inferred(v), "string", j)


def walk(v: Any, path: str):
    """Values at a path of ``$``, ``.k``, ``["k"]``, ``[n]`` and ``[*]``."""
    import re

    steps = re.findall(r"""\.([A-Za-z_][\w-]*)|\[\s*(?:"([^"]*)"|'([^']*)'|(\d+)|(\*))\s*\]""", path)
    shown = re.sub(r"""\.([A-Za-z_][\w-]*)|\[\s*(?:"([^"]*)"|'([^']*)'|(\d+)|(\*))\s*\]""", "", path)
    if shown != "$":
        raise SchemaError(f"no path: {path!r}")
    level = [v]
    for name, q1, q2, index, star in steps:
        key = name or q1 or q2
        if star:
            level = [x for y in level if isinstance(y, list) for x in y]
        elif index:
            level = [y[int(index)] for y in level if isinstance(y, list) and int(index) < len(y)]
        else:
            level = [y[key] for y in level if isinstance(y, dict) and key in y]
    return iter(level)
