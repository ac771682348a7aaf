"""Event-time windows, on batch and streaming DataFrames alike.

Windows are aligned to the Unix epoch plus an offset; negative times floor.
``assign`` adds ``window_start`` and ``window_end`` (one row for each window that
holds the event), so that any aggregation can follow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyflow.errors import WindowError

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "second": 1_000_000, "m": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "week": 604_800_000_000, "millisecond": 1_000, "microsecond": 1}
MAX_WINDOWS = 10_000  # of one event


def micros(duration: str | int) -> int:
    """Microseconds of ``'5 minutes'``, ``'100ms'``, ``'10m'``, ``'5'`` (seconds) or a number of milliseconds."""
    if isinstance(duration, int):
        return duration * 1000
    text = duration.strip().lower()
    if re.fullmatch(r"-?\d+", text):
        return int(text) * 1_000_000
    total, parts = 0, re.findall(r"(-?\d+)\s*([a-z]+)", text)
    if not parts or re.sub(r"(-?\d+)\s*([a-z]+)\s*", "", text).strip():
        raise WindowError(f"no duration: {duration!r}")
    for n, unit in parts:
        unit = unit if unit in UNITS else unit.rstrip("s")
        if unit.startswith(("month", "year")):
            raise WindowError(f"windows of months or years are not supported: {duration!r}")
        if unit not in UNITS:
            raise WindowError(f"unknown unit in {duration!r}")
        total += int(n) * UNITS[unit]
    return total


def positive(duration: str | int, what: str) -> int:
    n = micros(duration)
    if n <= 0:
        raise WindowError(f"{what} must be positive: {duration!r}")
    return n


def in_micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without zone (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def at_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def floored(n: Column, step: int, offset: int = 0) -> Column:
    """The largest offset + k * step that is not over n, whatever the sign."""
    return n - F.pmod(n - offset, F.lit(step))


# ---------------------------------------------------------------- scalar functions
def tumble_start(ts: Column, size: str | int, offset: str | int = 0) -> Column:
    return at_micros(floored(in_micros(ts), positive(size, "size"), micros(offset)))


def tumble_end(ts: Column, size: str | int, offset: str | int = 0) -> Column:
    return at_micros(floored(in_micros(ts), positive(size, "size"), micros(offset)) + positive(size, "size"))


def hop_start(ts: Column, slide: str | int, size: str | int, offset: str | int = 0) -> Column:
    """Start of the earliest window that holds the event."""
    a, b = hop_sizes(slide, size)
    return at_micros(floored(in_micros(ts) - b + a, a, micros(offset)))


def hop_end(ts: Column, slide: str | int, size: str | int, offset: str | int = 0) -> Column:
    a, b = hop_sizes(slide, size)
    return at_micros(floored(in_micros(ts) - b + a, a, micros(offset)) + b)


def session_key(ts: Column, gap: str | int) -> Column:
    """The event time itself: a session's bounds are known only with its neighbours."""
    positive(gap, "gap")
    return ts.cast("timestamp_ntz")


def cumulate_start(ts: Column, step: str | int, size: str | int) -> Column:
    cumulate_sizes(step, size)
    return tumble_start(ts, size)


def cumulate_end(ts: Column, step: str | int, size: str | int) -> Column:
    """End of the whole bucket that holds the event."""
    cumulate_sizes(step, size)
    return tumble_end(ts, size)


def hop_sizes(slide: str | int, size: str | int) -> tuple[int, int]:
    a, b = positive(slide, "slide"), positive(size, "size")
    if a > b:
        raise WindowError(f"slide {slide!r} is longer than size {size!r}: some events would be in no window")
    if -(-b // a) > MAX_WINDOWS:
        raise WindowError(f"an event would be in more than {MAX_WINDOWS} windows")
    return a, b


def cumulate_sizes(step: str | int, size: str | int) -> tuple[int, int]:
    a, b = positive(step, "step"), positive(size, "size")
    if b % a:
        raise WindowError(f"step {step!r} does not divide size {size!r}")
    if b // a > MAX_WINDOWS:
        raise WindowError(f"an event would be in more than {MAX_WINDOWS} windows")
    return a, b


# ---------------------------------------------------------------- window columns
def interval(us: int) -> str:
    return f"{us} microseconds"


def tumble(ts: str | Column, size: str | int, offset: str | int = 0) -> Column:
    """Grouping column of tumbling windows."""
    step = positive(size, "size")
    return F.window(ts, interval(step), interval(step), interval(micros(offset) % step))


def hop(ts: str | Column, slide: str | int, size: str | int, offset: str | int = 0) -> Column:
    """Grouping column of hopping windows; arguments in the order slide, size."""
    a, b = hop_sizes(slide, size)
    return F.window(ts, interval(b), interval(a), interval(micros(offset) % a))


def session(ts: str | Column, gap: str | int) -> Column:
    """Grouping column of session windows; events exactly one gap apart share a session."""
    return F.session_window(ts, interval(positive(gap, "gap")))


def bounds(window: str = "window") -> list[Column]:
    return [F.col(f"{window}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{window}.end").cast("timestamp_ntz").alias("window_end")]


def assign_cumulate(df: DataFrame, ts: str, step: str | int, size: str | int) -> DataFrame:
    """One row for each cumulating window of the event: same start, ends a step apart up to the full size."""
    a, b = cumulate_sizes(step, size)
    n = in_micros(F.col(ts))
    start = floored(n, b)
    first = F.floor((n - start) / a).cast("long") + 1
    ends = F.transform(F.sequence(first, F.lit(b // a).cast("long")), lambda k: start + k * a)
    x = df.filter(F.col(ts).isNotNull()).withColumn("window_start", at_micros(start)).withColumn("_end", F.explode(ends))
    return x.withColumn("window_end", at_micros(F.col("_end"))).drop("_end")


def aggregate(df: DataFrame, window: Column, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Group by window and keys: window_start, window_end, keys, aggregates."""
    x = df.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return x.select(*bounds(), *[c for c in x.columns if c != "window"])


def closed(windows: DataFrame, watermark: Column, lateness: str | int = 0) -> DataFrame:
    """The windows that a watermark has closed: end plus allowed lateness is not over it."""
    return windows.filter(in_micros(F.col("window_end")) + micros(lateness) <= in_micros(watermark))
