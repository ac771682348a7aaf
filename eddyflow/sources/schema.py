"""Schema inference, evolution and compatibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from eddyflow.errors import SchemaError

#: Casts that lose nothing.
WIDER = {
    "byte": {"short", "integer", "long", "float", "double", "decimal", "string"}, "short": {"integer", "long", "float", "double", "decimal", "string"}, "integer": {"long", "double", "decimal", "string"},
    "long": {"decimal", "string"}, "float": {"double", "string"}, "double": {"string"}, "date": {"timestamp", "timestamp_ntz", "string"}, "timestamp_ntz": {"timestamp", "string"}, "boolean": {"string"},
}
MODES = ("none", "backward", "forward", "full", "backward_transitive", "forward_transitive", "full_transitive")

# Types of the DDL, by name.
TYPES = {
    "TINYINT": "TINYINT", "SMALLINT": "SMALLINT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIME": "STRING",
    "TIMESTAMP": "TIMESTAMP_NTZ", "CHAR": "STRING", "VARCHAR": "STRING", "TEXT": "STRING", "STRING": "STRING", "JSON": "STRING", "JSONB": "STRING", "UUID": "STRING", "BINARY": "BINARY", "VARBINARY": "BINARY", "BLOB": "BINARY", "BYTEA": "BINARY", "INTERVAL": "INTERVAL DAY TO SECOND",
}


def type_of(sql: str) -> str:
    """Our type of a DDL type; bare DECIMAL is (38,9), one argument has scale 0."""
    import re

    t = " ".join(sql.upper().split())
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)(?:\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", t):
        return f"DECIMAL({m[1] or 38},{m[2] or (0 if m[1] else 9)})"
    if m := re.fullmatch(r"(?:CHAR|VARCHAR)\s*\(\s*\d+\s*\)", t):
        return "STRING"
    if m := re.fullmatch(r"ARRAY\s*<(.+)>|(.+)\[\]", t):
        return f"ARRAY<{type_of(m[1] or m[2])}>"
    if t.startswith(("MAP", "STRUCT")):
        return sql
    if t not in TYPES:
        raise SchemaError(f"no type: {sql!r}")
    return TYPES[t]


def infer_json(spark: SparkSession, texts: list[str], samples: int = 1000, confidence: float = 0.8) -> StructType:
    """Schema of JSON texts: a field's widest number, else its type in at least ``confidence`` of the samples, else text."""
    rows = spark.createDataFrame([(t,) for t in texts[:samples]], "j string")
    kinds = rows.select(F.explode(F.from_json("j", "map<string,variant>")).alias("k", "v")).select("k", F.schema_of_variant("v").alias("t")).groupBy("k", "t").count().collect()
    by: dict[str, dict[str, int]] = {}
    for r in kinds:
        by.setdefault(r["k"], {})[r["t"]] = r["count"]
    out = StructType()
    for name in sorted(by):
        seen = {t: n for t, n in by[name].items() if t != "VOID"}
        total = sum(seen.values())
        numbers = [t for t in seen if t in ("BIGINT", "DOUBLE") or t.startswith("DECIMAL")]
        if total and len(numbers) == len(seen):
            kind = "long" if numbers == ["BIGINT"] else "double"
        else:
            best = max(seen, key=seen.get, default="STRING")
            kind = {"BOOLEAN": "boolean"}.get(best, "string") if total and seen.get(best, 0) >= confidence * total else "string"
        out.add(name, kind)
    return out


@dataclass
class Change:
    kind: str  # added, removed, widened, changed, nullable, required
    name: str
    old: str | None = None
    new: str | None = None


def compare(old: StructType, new: StructType) -> list[Change]:
    """Differences by name."""
    a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    out = [Change("removed", n, a[n].dataType.simpleString()) for n in a if n not in b]
    for n, f in b.items():
        if n not in a:
            out.append(Change("added" if f.nullable else "required", n, None, f.dataType.simpleString()))
            continue
        s, t = a[n].dataType, f.dataType
        if s != t:
            wide = t.typeName() in WIDER.get(s.typeName(), ()) or isinstance(s, DecimalType) and isinstance(t, DecimalType) and t.scale >= s.scale and t.precision - t.scale >= s.precision - s.scale
            out.append(Change("widened" if wide else "changed", n, s.simpleString(), t.simpleString()))
        elif a[n].nullable != f.nullable:
            out.append(Change("nullable" if f.nullable else "required", n))
    return out


def verdict(old: StructType, new: StructType, mode: str = "backward") -> str:
    """compatible, requires_migration (types widen) or incompatible, in a compatibility mode."""
    if mode not in MODES:
        raise SchemaError(f"no compatibility mode: {mode!r}")
    kinds = {c.kind for c in compare(old, new)}
    kind = mode.removesuffix("_transitive")
    bad = {"none": set(), "backward": {"changed", "required"}, "forward": {"changed", "removed", "widened"}, "full": {"changed", "removed", "required", "widened"}}[kind]
    if kinds & bad:
        return "incompatible"
    return "requires_migration" if "widened" in kinds or kind == "none" and "changed" in kinds else "compatible"


class History:
    """Versions of a schema; transitive modes compare with all of them."""

    def __init__(self, mode: str = "backward"):
        self.mode, self.versions = mode, []

    def evolve(self, new: StructType) -> int:
        past = self.versions if self.mode.endswith("_transitive") else self.versions[-1:]
        for old in past:
            if verdict(old, new, self.mode) == "incompatible":
                raise SchemaError(f"incompatible ({self.mode}): {compare(old, new)}")
        self.versions.append(new)
        return len(self.versions)


def widened(old: StructType, new: StructType) -> StructType:
    """The union of two schemas: fields of both, of widened types, all nullable where either lacks them."""
    by = {f.name: f for f in new.fields}
    out = [StructField(f.name, by[f.name].dataType if f.name in by else f.dataType, True) for f in old.fields]
    return StructType(out + [StructField(f.name, f.dataType, True) for f in new.fields if f.name not in {x.name for x in old.fields}])
