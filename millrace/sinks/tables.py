"""Writers of tables. Each takes the whole new state of a table, so that a run that is repeated changes nothing."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.state import expired
from ..storage import materialise


def replace(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Writes df in place of the table at path and reads it; df may read that table itself. by: columns of partitions.

    The new table is written beside the old one, which stays as it was if that fails; then the old folder is renamed away,
    the new one is renamed to path, and the old one goes. A run that is killed between these renames leaves no table at
    path but a whole one in path-old-*, which the next replace puts back first. For several tables at once, or for readers
    that must not meet that moment, use snapshots."""
    spark = df.sparkSession
    place = lambda end: spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end)
    table, new = place(""), place(f"-new-{uuid.uuid4().hex}")
    files = table.getFileSystem(spark._jsc.hadoopConfiguration())
    _restored(files, table)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(new.toString())
    old = place(f"-old-{uuid.uuid4().hex}")
    if files.exists(table) and not files.rename(table, old) or not files.rename(new, table):
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def _restored(files, table) -> None:
    """Puts the table back that a killed replace has renamed away."""
    if files.exists(table) or not files.exists(table.getParent()):
        return
    for x in files.listStatus(table.getParent()):
        if x.getPath().getName().startswith(table.getName() + "-old-"):
            files.rename(x.getPath(), table)
            return


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes the partitions that df holds and leaves the others: a day or a month that is computed again.

    Spark moves the new partitions in place one by one at the end of the job; snapshots do it for all at once."""
    new = materialise(df)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return new.sparkSession.read.schema(new.schema).parquet(path)


def without_expired(df: DataFrame, at: str, as_of: Column, days: int, only: Column | None = None) -> DataFrame:
    """Rows that a retention of some days leaves; only: rows that may go at all (resolved entries, say)."""
    gone = expired(df, at, as_of, days)
    return df.where(~F.coalesce(gone if only is None else gone & only, F.lit(False)))


class Retained(NamedTuple):
    """How long a table keeps its rows. at, days: rows older than that go (only those of `only`, if it is given); parent: the
    table, and the columns here and there, whose rows take their children along."""

    rows: DataFrame
    at: str | None = None
    days: int | None = None
    only: Column | None = None
    parent: tuple[str, str, str] | None = None


def retained(tables: dict[str, Retained], as_of: Column) -> dict[str, DataFrame]:
    """The tables without expired rows and without the children of rows that went, whatever the depth; to be published as one
    version. Parents come before children in tables.

    Of a parent only the keys of the rows that went are joined, those that stay under no other row of the key."""
    out, went = {}, {}
    for name, t in tables.items():
        gone = F.lit(False)
        if t.at:
            old = F.coalesce(expired(t.rows, t.at, as_of, t.days), F.lit(False))
            gone = old if t.only is None else old & F.coalesce(t.only, F.lit(False))
        rows = t.rows.withColumn("_gone", gone)
        if t.parent:
            above, own, key = t.parent
            lost = went[above].select(F.col(key).alias(own)).where(F.col(own).isNotNull()).distinct()
            lost = lost.join(out[above].select(F.col(key).alias(own)), own, "left_anti").withColumn("_lost", F.lit(True))
            rows = rows.join(lost, own, "left").withColumn("_gone", F.col("_gone") | F.coalesce("_lost", F.lit(False))).select(*t.rows.columns, "_gone")
        out[name], went[name] = rows.where(~F.col("_gone")).drop("_gone"), rows.where("_gone").drop("_gone")
    return out


def nested(df: DataFrame, key: str, fields: list[str], lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, json): each row with its sorted lists of slugs as JSON text. lists: (key, slug) rows and their slug by name."""
    out = df.select(key, *fields)
    for name, (rows, slug) in lists.items():
        sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(slug)).alias(name))
        out = out.join(sets, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select(key, F.to_json(F.struct(key, *fields, *lists)).alias("json"))
