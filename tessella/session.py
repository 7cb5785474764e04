"""Session factory with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tessella", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew-join handling; conf overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
