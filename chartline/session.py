"""Session settings the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning sizes partitions, splits skewed joins and turns small sides into broadcasts.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Building a plan is much faster without a call-site record for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session on this machine, for tests and benches. A cluster brings its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("chartline")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
