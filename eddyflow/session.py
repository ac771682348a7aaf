"""The engine's SparkSession: settings that its semantics need, sizes left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics: zone-less event times, last value of a repeated map key, JSON nulls kept.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
}
#: Planning at run time: joins change strategy and skewed partitions split by measured sizes.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, app: str = "eddyflow", **settings: str) -> SparkSession:
    """Create or get a session; ``settings`` override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SEMANTICS | ADAPTIVE | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
