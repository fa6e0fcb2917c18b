"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and Spark runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str = "stage") -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has a written folder deleted when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialise(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again. by: columns of partitions, which come last in the result.

    This cuts lineage: a lost executor costs a read of the table and not a second run of what made it,
    and Spark then knows the true size of the table when it picks join strategies. Tables are read lazily, so they are
    deleted when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
    """materialise(df), and aggregates of its rows by name, which are taken while they are written and cost no job."""
    seen = Observation()
    out = materialise(df.observe(seen, *(c.alias(name) for name, c in values.items())))
    return out, seen.get


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small file over as many tasks as a shuffle has, for steps that take long for each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def drained(stream: DataFrame) -> DataFrame:
    """What a stream (append mode) puts out for all that its source has now, written to the shared folder and read again."""
    spark = stream.sparkSession
    path, marks = fresh_path(spark, "drained"), fresh_path(spark, "marks")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    for folder in (path, marks):
        delete_at_exit(spark, folder)
    return spark.read.schema(stream.schema).parquet(path)
