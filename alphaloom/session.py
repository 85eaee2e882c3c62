"""One place for the session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "alphaloom", **conf: str) -> SparkSession:
    """A session with UTC dates, ANSI arithmetic and adaptive execution; conf adds or replaces settings.

    The number of shuffle partitions is left to the caller and the cluster; adaptive execution only lowers it.
    """
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
