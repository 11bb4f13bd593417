"""Sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic and three-valued logic are Spark's defaults; these are set besides.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(master: str | None = None, **settings: str) -> SparkSession:
    """The running session or a new one; ``settings`` with _ for the dots of their names."""
    builder = SparkSession.builder.appName("loam")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
