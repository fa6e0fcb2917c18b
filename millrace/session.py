"""Session settings that results rely on. All others are the session's own; Spark's defaults (ANSI, adaptive execution) suit."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def configure(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a running session. They must still hold when a result is computed, so they stay; registered
    queries call this."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark
