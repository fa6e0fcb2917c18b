"""Runs registered queries against their DuckDB SQL: python -m tests.parity [--sf DIR] [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return db


def plain(value):
    """A value as both engines show it."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return Decimal(value).normalize()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def difference(spark_df, relation) -> str | None:
    """What differs between the two results, in names, types (as wide groups) or rows."""
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} and {sorted(relation.columns)}"
    kinds = dict(spark_df.dtypes)
    groups = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for name, kind in zip(relation.columns, relation.types, strict=True):
        want = groups.get(kinds[name])
        if want and want != str(kind):
            return f"{name}: {kinds[name]} and {kind}"
    ours = Counter(tuple(plain(r[n]) for n in names) for r in spark_df.collect())
    at = [relation.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    if ours != theirs:
        a, b = ours - theirs, theirs - ours
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(a)[:2]}, only theirs {list(b)[:2]}"
    return None


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark, db = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, db.sql(sql[name])) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - start:.1f} s)", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
