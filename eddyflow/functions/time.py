"""Time functions: epochs, format strings, binning, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyflow.errors import SqlError
from eddyflow.operators.windows import at_micros, floored, in_micros, micros, positive

EPOCH_UNITS = {"s": 1_000_000, "seconds": 1_000_000, "ms": 1_000, "milliseconds": 1_000, "us": 1, "microseconds": 1, "ns": -1_000, "nanoseconds": -1_000}
# Directives of strftime and the pattern letters they stand for.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "y": "yy", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d", "%": "%"}


def parse_epoch(n: Column, unit: str) -> Column:
    """Zone-less timestamp of a number of seconds, milliseconds, microseconds or nanoseconds."""
    if unit.lower() not in EPOCH_UNITS:
        raise SqlError(f"no unit of time: {unit!r}")
    k = EPOCH_UNITS[unit.lower()]
    return at_micros(n * k if k > 0 else F.floor(n / -k).cast("long"))


def pattern(fmt: str) -> str:
    """The date pattern of a strftime format; unknown directives are an error."""
    out, i, text = [], 0, ""

    def close() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(c.isalpha() for c in text) else text)
            text = ""

    while i < len(fmt):
        if fmt[i] != "%":
            text += fmt[i]
            i += 1
            continue
        key = next((fmt[i + 1 : i + 1 + n] for n in (2, 1) if fmt[i + 1 : i + 1 + n] in DIRECTIVES), None)
        if fmt[i + 1 : i + 3] == ".f":
            close()
            out.append(".SSSSSS")
            i += 3
            continue
        if key is None:
            raise SqlError(f"unsupported directive in {fmt!r}")
        if key == "%":
            text += "%"
        else:
            close()
            out.append(DIRECTIVES[key])
        i += 1 + len(key)
    close()
    return "".join(out)


def parse_timestamp(s: Column, fmt: str) -> Column:
    """Zone-less timestamp of text in a strftime format, or ``iso8601``; null where it does not parse."""
    if fmt.lower() == "iso8601":
        return F.try_to_timestamp(s).cast("timestamp_ntz")
    return F.try_to_timestamp(s, F.lit(pattern(fmt))).cast("timestamp_ntz")


def format_timestamp(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, pattern(fmt))


def date_bin(step: str, ts: Column, origin: str | None = None) -> Column:
    """The start of the bin of length ``step`` that holds the time, counted from ``origin``."""
    base = F.lit(0) if origin is None else in_micros(F.lit(origin).cast("timestamp_ntz"))
    n = positive(step, "bin")
    return at_micros(in_micros(ts) - F.pmod(in_micros(ts) - base, F.lit(n))) if origin else at_micros(floored(in_micros(ts), n))


def proctime() -> Column:
    return F.current_timestamp()


def watermark(df: DataFrame, ts: str, delay: str = "0 s") -> Column:
    """The event-time bound of a batch: its last time less the delay, or null if it is empty.

    One aggregate over the column; a stream's watermark is in its progress.
    """
    last = df.agg(F.max(in_micros(F.col(ts)))).first()[0]
    return F.lit(None).cast("timestamp_ntz") if last is None else at_micros(F.lit(last - micros(delay)).cast("long"))
