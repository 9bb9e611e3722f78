"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
