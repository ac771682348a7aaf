"""As-of and probe joins of two streams: rows wait until the watermark has passed the time they look back from."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eddyflow.operators.windows import in_micros, interval, micros


def asof(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, *, delay: str = "0 s", tolerance: str | None = None, at: str | None = None) -> DataFrame:
    """For each left row the last right row with equal keys at or before its time (or its column ``at``).

    Both sides are plain streams; the watermark is their common event time less
    ``delay``. A left row comes out once the watermark has passed the time it looks
    back from, with the columns of both sides (``l`` and ``r`` structs; ``r`` is null
    without a match). Of each key only waiting rows and the right rows that
    they, or later rows, can still match are kept.
    """
    key = lambda cols: F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))
    whole = lambda cols: F.forall(F.array(*[F.col(c).cast("string") for c in cols]), lambda x: x.isNotNull())
    pack = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    l = left.filter(whole([a for a, _ in keys]) & F.col(left_ts).isNotNull()).select(key([a for a, _ in keys]).alias("_key"), F.col(left_ts).cast("timestamp").alias("_ts"), in_micros(F.col(at or left_ts)).alias("_at"), F.lit(0).alias("_side"), pack(left).alias("_row"))
    r = right.filter(whole([b for _, b in keys]) & F.col(right_ts).isNotNull()).select(key([b for _, b in keys]).alias("_key"), F.col(right_ts).cast("timestamp").alias("_ts"), in_micros(F.col(right_ts)).alias("_at"), F.lit(1).alias("_side"), pack(right).alias("_row"))
    both = l.unionAll(r).withWatermark("_ts", interval(micros(delay)))
    limit = micros(tolerance) if tolerance is not None else None

    def run(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, known = map(json.loads, state.get) if state.exists else ([], [])
        for x in rows:
            for at_, side, row in zip(x["_at"], x["_side"], x["_row"], strict=True):
                (waiting if side == 0 else known).append([int(at_), row])
        mark = state.getCurrentWatermarkMs() * 1000
        known.sort(key=lambda e: e[0])  # stable: of equal times the last to come is found
        times = [e[0] for e in known]
        out, later = [], []
        for t, row in waiting:
            if t >= mark:
                later.append([t, row])
                continue
            i = bisect.bisect_right(times, t) - 1
            near = i >= 0 and (limit is None or t - times[i] <= limit)
            out.append((row, known[i][1] if near else None))
        # right rows before the last one that the least open time can match are of no more use
        least = min([mark, *(t for t, _ in later)])
        known = known[max(bisect.bisect_right(times, least) - 1, 0) :]
        if later or known:
            state.update((json.dumps(later), json.dumps(known)))
            if later:
                state.setTimeoutTimestamp(max(min(t for t, _ in later) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["l", "r"])

    got = both.groupBy("_key").applyInPandasWithState(run, "l string, r string", "waiting string, known string", "append", GroupStateTimeout.EventTimeTimeout)
    formats = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return got.select(F.from_json("l", left.schema, formats).alias("l"), F.from_json("r", right.schema, formats).alias("r"))


def probe(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, offsets: list[int], *, alias: str = "p", delay: str = "0 s") -> DataFrame:
    """Each left row at each offset (milliseconds), as of that time; it comes out when the watermark has passed it."""
    n, p = f"{alias}_offset_ms", f"{alias}_probe_ts"
    x = left.withColumn(n, F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])))
    x = x.withColumn("_probe", F.timestamp_micros(in_micros(F.col(left_ts)) + F.col(n) * 1000)).withColumn(p, F.floor(in_micros(F.col("_probe")) / 1000).cast("long"))
    got = asof(x, right, keys, left_ts, right_ts, delay=delay, at="_probe")
    return got.withColumn("l", F.col("l").dropFields("_probe"))
