"""Changelogs: rows with a ``__weight`` (+1 inserted, -1 retracted), and change capture with ``_op``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyflow.errors import ChangelogError
from eddyflow.operators.windows import in_micros, micros

WEIGHT = "__weight"
RETRACTABLE = ("sum", "count", "avg", "min", "max")


def encode(df: DataFrame, weight: int | Column = 1) -> DataFrame:
    """Rows as insertions (or with the weight given)."""
    return df.withColumn(WEIGHT, (F.lit(weight) if isinstance(weight, int) else weight).cast("long"))


def consolidate(changes: DataFrame) -> DataFrame:
    """Sum the weights of equal rows; rows that cancel out go."""
    rows = [c for c in changes.columns if c != WEIGHT]
    return changes.groupBy(*rows).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)


def positive(changes: DataFrame) -> DataFrame:
    """What a sink without retractions gets: inserted rows without their weight."""
    return changes.filter(F.col(WEIGHT) > 0).drop(WEIGHT)


def split(cdc: DataFrame, op: str = "_op") -> tuple[DataFrame, DataFrame]:
    """Change capture as (rows that come, rows that go): I, U, U+ and D, U-."""
    return cdc.filter(F.col(op).isin("I", "U", "U+", "r", "c", "u")), cdc.filter(F.col(op).isin("D", "U-", "d"))


def collapse(cdc: DataFrame, keys: list[str], order: str, op: str = "_op") -> DataFrame:
    """The last change of each key by ``order``: ``_op`` is D if the row went, else U."""
    rest = [c for c in cdc.columns if c not in keys]
    x = cdc.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    x = x.select(*keys, "_last.*")
    return x.withColumn(op, F.when(F.col(op).isin("D", "U-"), "D").otherwise("U")).select(cdc.columns)


def upserts(changes: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """A changelog as one upsert (U, with the live row) or delete (D) for each key that changed.

    A key with two live rows is an error (``check``), since an upsert could keep one only.
    """
    net = consolidate(changes)
    rest = [c for c in net.columns if c not in (*keys, WEIGHT)]
    live = F.when(F.col(WEIGHT) > 0, F.struct(*rest))
    gone = F.when(F.col(WEIGHT) < 0, F.struct(*rest))
    x = net.groupBy(*keys).agg(F.max(live).alias("_live"), F.max(gone).alias("_gone"), F.count(live).alias("_n"))
    if check:
        x = x.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(str(ChangelogError("a key is not unique in the changelog"))))).otherwise(F.col("_n")))
    x = x.withColumn("_op", F.when(F.col("_n") > 0, "U").otherwise("D")).withColumn("_row", F.coalesce("_live", "_gone"))
    return x.select(*keys, "_row.*", "_op")


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that turn one result into another: retract what went, insert what came, nothing where equal.

    Compared by value, nulls and NaN equal to themselves.
    """
    rows = before.columns
    return consolidate(encode(before, -1).unionByName(encode(after.select(rows), 1)))


def aggregate(changes: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Aggregates over a changelog: {name: (function, column)}; groups without rows left are gone.

    Sums, counts and averages weigh every change; minima and maxima are taken over the rows that are left.
    """
    bad = [f for f, _ in aggregates.values() if f not in RETRACTABLE]
    if bad:
        raise ChangelogError(f"no aggregate over a changelog: {bad}; only {RETRACTABLE}")
    w = F.col(WEIGHT)
    out = []
    for name, (f, c) in aggregates.items():
        v = F.col(c) if c else None
        known = F.lit(1) if v is None else v.isNotNull().cast("int")
        n = F.sum(w * known)
        if f == "count":
            out.append(F.coalesce(n, F.lit(0)).alias(name))
        elif f == "sum":
            out.append(F.when(n > 0, F.sum(v * w)).alias(name))
        elif f == "avg":
            out.append(F.when(n > 0, F.sum(v * w) / n).alias(name))
        else:
            out.append((F.min if f == "min" else F.max)(F.when(w > 0, v)).alias(name))
    rows = consolidate(changes) if any(f in ("min", "max") for f, _ in aggregates.values()) else changes
    x = rows.groupBy(*keys).agg(F.sum(w).alias("_left"), *out)
    return x.filter("_left > 0").drop("_left")


def from_change_feed(feed: DataFrame, change: str = "_change_type") -> DataFrame:
    """A table's change feed as a changelog."""
    gone = F.col(change).isin("delete", "update_preimage")
    return feed.withColumn(WEIGHT, F.when(gone, -1).otherwise(1).cast("long")).drop(change)


def temporal_filter(df: DataFrame, ts: str, *, lower: str | int | None = None, lower_strict: bool = False, upper: str | int | None = None, upper_strict: bool = False, frontiers: list[int] | None = None, until: Column | None = None) -> DataFrame:
    """Rows of ``ts`` between ``now() + lower`` and ``now() + upper`` as a changelog over time.

    ``now()`` is the watermark, floored to seconds. A row is in while
    ``ts >= now + lower`` and ``ts <= now + upper`` (or strictly), so it enters when
    the frontier reaches ``ts - upper`` and leaves when it passes ``ts - lower``: two
    rows of ``__weight`` with the millisecond ``__at`` of the change. ``until`` (a
    timestamp) drops changes the watermark has not reached. With ``frontiers``
    (increasing milliseconds at which cycles ran) changes happen at cycles: a row
    that enters and leaves between two cycles is never seen.
    """
    t = F.floor(in_micros(F.col(ts)) / 1000).cast("long")
    second = lambda x: F.ceil(x / 1000).cast("long") * 1000  # noqa: E731  the first floored clock that is not under x
    enter = F.lit(None).cast("long") if upper is None else second(t - micros(upper) // 1000 + int(upper_strict))
    leave = F.lit(None).cast("long") if lower is None else second(t - micros(lower) // 1000 + int(not lower_strict))
    x = df.filter(F.col(ts).isNotNull()).withColumn("_in", enter).withColumn("_out", leave)
    if frontiers is not None:
        cycles = F.array(*[F.lit(f // 1000 * 1000).cast("long") for f in frontiers])
        first = lambda at: F.element_at(F.filter(cycles, lambda f: f >= at), 1)
        x = x.withColumn("_in", F.when(F.col("_in").isNull(), F.element_at(cycles, 1)).otherwise(F.try_element_at(F.filter(cycles, lambda f: f >= F.col("_in")), F.lit(1))))
        x = x.withColumn("_out", F.try_element_at(F.filter(cycles, lambda f: f >= F.col("_out")), F.lit(1)))
        x = x.filter(F.col("_in").isNotNull())
    x = x.filter(F.col("_in").isNull() | F.col("_out").isNull() | (F.col("_in") < F.col("_out")))
    changes = F.array(F.struct(F.lit(1).cast("long").alias(WEIGHT), F.coalesce("_in", t).alias("__at")), F.struct(F.lit(-1).cast("long").alias(WEIGHT), F.col("_out").alias("__at")))
    x = x.withColumn("_c", F.explode(changes)).filter(F.col("_c.__at").isNotNull())
    out = x.select(*df.columns, F.col(f"_c.{WEIGHT}").alias(WEIGHT), F.col("_c.__at").alias("__at"))
    return out if until is None else out.filter(F.col("__at") <= F.floor(in_micros(until) / 1000))


def upsert_table(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed table after inserting rows: new rows replace old ones of the same key."""
    kept = table.join(new.select(keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.select(table.columns))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
