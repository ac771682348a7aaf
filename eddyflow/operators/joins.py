"""Time joins as declarative plans: interval, as-of, temporal, probe and lookup joins.

Joins on a key alone would gather a hot key's whole history in one task, so
interval joins also equate time buckets, and as-of joins cut each key's history
into time buckets, with the last row before a bucket carried into it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyflow.errors import JoinError
from eddyflow.operators.windows import in_micros, micros, positive

INTERVAL_TYPES = ("inner", "left", "right", "full", "left_semi", "left_anti", "right_semi", "right_anti")


def equal(keys: list[tuple[str, str]]) -> Column:
    return reduce(and_, (F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in keys))


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, *, before: str | int = 0, after: str | int = 0, how: str = "inner", bucket: str | int | None = None
) -> DataFrame:
    """Rows with equal keys and ``l.ts - before <= r.ts <= l.ts + after``, as SQL would join them.

    Null keys and times never match. Both sides keep their columns, which must
    differ in name; semi and anti joins keep those of one side. The time is cut
    into buckets (the width of the bound, or ``bucket``): left rows look into the
    buckets they reach, so the join is an equi-join that spreads hot keys.
    """
    if how not in INTERVAL_TYPES:
        raise JoinError(f"no interval join type: {how!r}")
    if how in ("right_semi", "right_anti"):
        return interval_join(right, left, [(b, a) for a, b in keys], right_ts, left_ts, before=after, after=before, how=how.replace("right", "left"), bucket=bucket)
    lo, hi = micros(before), micros(after)
    if lo + hi < 0:
        raise JoinError("the interval is empty")
    width = positive(bucket, "bucket") if bucket is not None else max(lo + hi, 1)
    clash = set(left.columns) & set(right.columns)
    if clash and how not in ("left_semi", "left_anti"):
        raise JoinError(f"columns of both sides: {sorted(clash)}; rename them first")
    if how in ("left_semi", "left_anti"):
        right = right.select([F.col(c).alias(f"_r_{c}") for c in {b for _, b in keys} | {right_ts}])
        keys, right_ts = [(a, f"_r_{b}") for a, b in keys], f"_r_{right_ts}"
    lt, rt = in_micros(F.col(left_ts)), in_micros(F.col(right_ts))
    near = equal(keys) & (F.col("l._bucket") == F.col("r._bucket")) & (F.col("r._rt") >= F.col("l._lt") - lo) & (F.col("r._rt") <= F.col("l._lt") + hi)
    slot = lambda t: F.floor(t / width).cast("long")
    l = left.withColumn("_lt", lt)
    r = right.withColumn("_rt", rt).withColumn("_bucket", slot(rt)).alias("r")
    reach = F.sequence(slot(F.col("_lt") - lo), slot(F.col("_lt") + hi))
    if how == "inner" or how == "right":
        x = l.filter(F.col("_lt").isNotNull()).withColumn("_bucket", F.explode(reach)).alias("l").join(r, near, how)
        return x.drop("_bucket", "_lt", "_rt")
    # outer on the left: match by row number first, so that an unmatched row stays once
    l = l.withColumn("_row", F.monotonically_increasing_id())
    probe = l.select("_row", "_lt", *{a for a, _ in keys}).filter(F.col("_lt").isNotNull()).withColumn("_bucket", F.explode(reach)).alias("l")
    if how in ("left_semi", "left_anti"):
        probe = l.filter(F.col("_lt").isNotNull()).withColumn("_bucket", F.explode(reach)).alias("l")
        hit = probe.join(r, near, "left_semi")
        if how == "left_semi":
            return hit.dropDuplicates(["_row"]).select(left.columns)
        # a row is kept if none of its buckets matches: one row for each left row, counted over its buckets
        tried = l.withColumn("_bucket", F.explode_outer(reach)).alias("l").join(r.select(F.col("_bucket").alias("_rb"), "_rt", *{b for _, b in keys}).alias("r"), equal(keys) & (F.col("l._bucket") == F.col("r._rb")) & (F.col("r._rt") >= F.col("l._lt") - lo) & (F.col("r._rt") <= F.col("l._lt") + hi), "left")
        none = tried.groupBy(*left.columns, "_row").agg(F.count("_rt").alias("_n")).filter("_n = 0")
        return none.select(left.columns)
    tried = l.withColumn("_bucket", F.explode_outer(reach)).alias("l").join(r, near, "left" if how == "left" else "full")
    # of each left row keep the matches, or one empty row if there is none
    w = Window.partitionBy("l._row")
    x = tried.withColumn("_n", F.count("_rt").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.col("_rt").asc_nulls_last())))
    alone = F.col("l._row").isNull()
    x = x.filter(alone | F.col("_rt").isNotNull() | ((F.col("_n") == 0) & (F.col("_k") == 1)))
    return x.select([F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns])


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, *, direction: str = "backward", tolerance: str | int | None = None,
    how: str = "left", ties: str = "first", order: str | None = None, bucket: str | int | None = None, prefix: str = "",
) -> DataFrame:
    """For each left row the right row with equal keys that is nearest in time, backward, forward or either way.

    Of right rows with equal time, ``ties`` takes the first or the last by
    ``order`` (a column of the right side; its arrival). A nearest tie in distance
    goes to the earlier time. Rows beyond ``tolerance`` do not match. Null keys
    never match. ``how`` is left or inner. With ``bucket`` each key's history is cut
    into buckets of that length, so that no task orders a whole key.
    """
    if direction not in ("backward", "forward", "nearest") or how not in ("left", "inner") or ties not in ("first", "last"):
        raise JoinError(f"as-of join: {direction!r}, {how!r}, {ties!r}")
    limit = None if tolerance is None else micros(tolerance)
    names = [c for c in right.columns]
    clash = set(left.columns) & {prefix + c for c in names}
    if clash:
        raise JoinError(f"columns of both sides: {sorted(clash)}; give a prefix or rename them")
    key = lambda cols: F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    whole = reduce(and_, (F.col(b).isNotNull() for _, b in keys)) & F.col(right_ts).isNotNull()
    seq = F.col(order) if order else F.lit(0)
    r = right.filter(whole).select(key([b for _, b in keys]).alias("_key"), in_micros(F.col(right_ts)).alias("_t"), F.struct(in_micros(F.col(right_ts)).alias("t"), F.struct(*names).alias("row")).alias("_r"), seq.alias("_o"))
    # one right row for each key and time
    take = F.min_by if ties == "first" else F.max_by
    r = r.groupBy("_key", "_t").agg(take("_r", "_o").alias("_r"))
    lkey = reduce(and_, (F.col(a).isNotNull() for a, _ in keys)) & F.col(left_ts).isNotNull()
    l = left.withColumn("_l", F.struct(*left.columns)).select("_l", lkey.alias("_ok"), key([a for a, _ in keys]).alias("_key"), in_micros(F.col(left_ts)).alias("_t"))
    wanted, skipped = l.filter("_ok").drop("_ok"), l.filter(~F.coalesce("_ok", F.lit(False))).select("_l")
    slot = F.floor(F.col("_t") / positive(bucket, "bucket")).cast("long") if bucket is not None else F.lit(0).cast("long")
    both = wanted.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).select("_key", "_t", "_l", "_r").unionAll(r.withColumn("_l", F.lit(None).cast(wanted.schema["_l"].dataType)).select("_key", "_t", "_l", "_r")).withColumn("_b", slot)
    part = Window.partitionBy("_key", "_b")
    side = F.col("_l").isNotNull().cast("int")  # at equal times right rows come first either way
    back = part.orderBy("_t", side).rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy(F.desc("_t"), side).rowsBetween(Window.unboundedPreceding, 0)
    if direction in ("backward", "nearest"):
        both = both.withColumn("_back", F.last("_r", ignorenulls=True).over(back))
    if direction in ("forward", "nearest"):
        both = both.withColumn("_ahead", F.last("_r", ignorenulls=True).over(ahead))
    if bucket is not None:
        # what earlier and later buckets of the key hold nearest
        ends = r.withColumn("_b", slot).groupBy("_key", "_b").agg(F.max_by("_r", "_t").alias("_hi"), F.min_by("_r", "_t").alias("_lo"))
        marks = both.select("_key", "_b").distinct().join(ends, ["_key", "_b"], "left")
        order_ = Window.partitionBy("_key").orderBy("_b")
        carry = marks.withColumn("_before", F.last("_hi", ignorenulls=True).over(order_.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_lo", ignorenulls=True).over(order_.rowsBetween(1, Window.unboundedFollowing))).select("_key", "_b", "_before", "_after")
        both = both.filter(F.col("_l").isNotNull()).join(carry, ["_key", "_b"])
        if direction in ("backward", "nearest"):
            both = both.withColumn("_back", F.coalesce("_back", "_before"))
        if direction in ("forward", "nearest"):
            both = both.withColumn("_ahead", F.coalesce("_ahead", "_after"))
    x = both.filter(F.col("_l").isNotNull())
    if direction == "nearest":
        nearer = F.col("_ahead.t") - F.col("_t") < F.col("_t") - F.col("_back.t")
        x = x.withColumn("_m", F.when(F.col("_back").isNull() | nearer, F.col("_ahead")).otherwise(F.col("_back")))
    else:
        x = x.withColumn("_m", F.col("_back" if direction == "backward" else "_ahead"))
    if limit is not None:
        x = x.withColumn("_m", F.when(F.abs(F.col("_t") - F.col("_m.t")) <= limit, F.col("_m")))
    x = x.select("_l", "_m")
    if how == "left":
        x = x.unionAll(skipped.withColumn("_m", F.lit(None).cast(r.schema["_r"].dataType)))
    else:
        x = x.filter(F.col("_m").isNotNull())
    return x.select("_l.*", *[F.col(f"_m.row.{c}").alias(prefix + c) for c in names])


def temporal_join(left: DataFrame, versions: DataFrame, keys: list[tuple[str, str]], left_ts: str, version_ts: str, *, how: str = "inner", order: str | None = None, prefix: str = "", bucket: str | int | None = None) -> DataFrame:
    """Join each row with the table's version as of its event time: the latest not after it, the last of equals."""
    return asof_join(left, versions, keys, left_ts, version_ts, how=how, ties="last", order=order, prefix=prefix, bucket=bucket)


def probe_offsets(offsets: list[str | int] | None = None, span: tuple[str | int, str | int, str | int] | None = None) -> list[int]:
    """Sorted distinct offsets in milliseconds, from a list or from (first, last, step), both ends included."""
    if span is not None:
        a, b, step = (micros(x) // 1000 for x in span)
        if step <= 0 or b < a:
            raise JoinError("a probe range needs a positive step and first <= last")
        if (b - a) // step >= 100_000:
            raise JoinError("a probe range may have 100000 offsets at most")
        return list(range(a, b + 1, step))
    if not offsets:
        raise JoinError("a probe join needs offsets")
    return sorted({micros(x) // 1000 for x in offsets})


def temporal_probe_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, offsets: list[int], *, alias: str = "p", order: str | None = None, prefix: str = "", bucket: str | int | None = None) -> DataFrame:
    """Each left row at each offset (milliseconds): the right row as of ``ts + offset``, or nulls.

    Adds ``<alias>_offset_ms`` and ``<alias>_probe_ts`` (epoch milliseconds). Rows with null keys are left out.
    """
    n, p = f"{alias}_offset_ms", f"{alias}_probe_ts"
    whole = reduce(and_, (F.col(a).isNotNull() for a, _ in keys)) & F.col(left_ts).isNotNull()
    x = left.filter(whole).withColumn(n, F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])))
    x = x.withColumn("_probe", F.timestamp_micros(in_micros(F.col(left_ts)) + F.col(n) * 1000)).withColumn(p, F.floor(in_micros(F.col("_probe")) / 1000).cast("long"))
    return asof_join(x, right, keys, "_probe", right_ts, ties="last", order=order, prefix=prefix, bucket=bucket).drop("_probe")


def lookup_join(left: DataFrame, table: DataFrame, keys: list[tuple[str, str]], *, how: str = "inner", where: Column | None = None) -> DataFrame:
    """Enrich rows from a dimension table; predicates on the table alone go before the join.

    Whether the table is broadcast is left to its measured size.
    """
    if how not in ("inner", "left"):
        raise JoinError(f"no lookup join type: {how!r}")
    side = table.filter(where) if where is not None else table
    return left.alias("l").join(side.alias("r"), equal(keys), how)


def window_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two windowed results on their window bounds and keys."""
    return left.join(right, ["window_start", "window_end", *keys], how)
