"""The session the library is meant for: UTC, adaptive execution, skew joins split at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "starling", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` overrides, with ``_`` for ``.`` in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
