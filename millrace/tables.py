"""Tables and the views that queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE = ("live", "beta", "waitlist")


class Tables:
    """Tables of a folder by name, each read on first use: tables.orders, tables.events."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._read = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._read[name]

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files. The path is a pattern, as Spark streams files of a folder only."""
        schema = self._spark.read.parquet(f"{self._folder}/{name}.parquet").schema
        return self._spark.readStream.schema(schema).parquet(f"{self._folder}/{name}.parque[t]")


def published(apps: DataFrame) -> DataFrame:
    """The public view: published, indexable and of a live launch status."""
    return apps.where((F.col("status") == "published") & F.col("is_indexable") & F.col("launch_status").isin(*LIVE))


def published_loose(apps: DataFrame) -> DataFrame:
    """Published and indexable, whatever the launch status."""
    return apps.where((F.col("status") == "published") & F.col("is_indexable"))


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views for spark.sql()."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
