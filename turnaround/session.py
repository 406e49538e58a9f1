"""Session defaults for standalone runs (tests, bench). On a cluster the caller's session is used."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "turnaround", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are written for.

    UTC keeps zone-free timestamps unambiguous; adaptive execution coalesces small shuffle
    partitions, splits skewed ones and switches to broadcast joins from measured sizes.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
