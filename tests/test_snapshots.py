"""Versions of tables: a killed write, two writers, slots, old versions, and a table replaced in place."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.sinks import tables
from millrace.sinks.snapshots import Conflict, Snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def broken(df):
    """The same rows, whose reading fails."""
    return df.select(*(F.when(F.col(df.columns[0]).isNotNull(), F.raise_error(F.lit("killed"))).otherwise(F.col(c)).cast(t).alias(c) for c, t in df.dtypes))


def test_a_write_killed_between_tables_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert store.commit({"apps": one, "sources": two}) == 1
    with pytest.raises(Exception, match="killed"):
        store.commit({"apps": two, "sources": broken(one)})
    assert store.version() == 1 and rows(store.read("apps")) == [(1, "a")] and rows(store.read("sources")) == [(2, "b")]
    assert store.commit({"apps": two, "sources": one}) == 2
    assert rows(store.read("apps")) == [(2, "b")] and rows(store.read("apps", version=1)) == [(1, "a")]


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "k int")
    base = a.commit({"t": one})
    b.commit({"t": one.union(one)}, since=base)
    with pytest.raises(Conflict):
        a.commit({"t": one.limit(0)}, since=base)
    assert rows(a.read("t")) == [(1,), (1,)] and not [n for n in os.listdir(tmp_path / "_versions") if n.endswith("tmp")]


def test_slots_and_old_versions(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), keep=2)
    df = lambda *x: spark.createDataFrame(list(x), "day string, v int")
    store.commit(slotted={"d": (df(("2024-01-01", 1), ("a/b %", 2), (None, 3)), "day")})
    store.commit({"whole": df(("w", 0))}, slotted={"d": (df(("2024-01-01", 9), ("2024-01-02", 4)), "day")})
    assert rows(store.read("d").where("day is not null")) == [("2024-01-01", 9), ("2024-01-02", 4), ("a/b %", 2)] and store.read("d").where("day is null").count() == 1
    assert rows(store.read("d", ["a/b %", "2024-01-02", "nowhere"])) == [("2024-01-02", 4), ("a/b %", 2)] and store.read("d", []).count() == 0
    assert len(store.read("d", ["2024-01-02"]).inputFiles()) == 1
    store.commit(emptied={"d": ["a/b %"]})
    assert store.slots("d") == ["2024-01-01", "2024-01-02", "null"] and store.versions() == [2, 3]
    store.commit(slotted={"d": (df(("2024-01-01", 5)), "day")})
    assert rows(store.read("d", ["2024-01-01"])) == [("2024-01-01", 5)] and rows(store.read("whole")) == [("w", 0)]
    named = {f.split("/")[1] for v in store.versions() for f in store.manifest(v)["d"]["slots"].values()}
    assert set(os.listdir(tmp_path / "d")) >= named and store.versions() == [3, 4]
    assert store.commit({"none": df().limit(0)}) == 5 and store.read("none").columns == ["day", "v"]


def test_replace_keeps_the_table_if_it_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.replace(one, path)
    with pytest.raises(Exception, match="killed"):
        tables.replace(broken(one), path)
    assert rows(spark.read.parquet(path)) == [(1, "a")]
    assert rows(tables.replace(spark.read.parquet(path).withColumn("k", F.col("k") + 1), path)) == [(2, "a")]  # from itself
    os.rename(path, path + "-old-1")  # as a run leaves it that is killed between two renames
    with pytest.raises(Exception, match="killed"):
        tables.replace(broken(one), path)
    assert rows(spark.read.parquet(path)) == [(2, "a")]


def test_retention_takes_children_along(spark):
    """Six tables with days of their own, two levels of children, against plain Python."""
    import datetime as dt

    now = dt.datetime(2024, 3, 1)
    day = lambda k: now - dt.timedelta(days=k)
    runs = spark.createDataFrame([(i, day(i), i % 3 == 0) for i in range(60)] + [(7, day(1), True)], "run int, at timestamp_ntz, done boolean")
    steps = spark.createDataFrame([(i, i // 2, day(i // 4)) for i in range(130)] + [(500, None, day(90))], "step int, run int, at timestamp_ntz")
    logs = spark.createDataFrame([(i, i % 130) for i in range(300)], "log int, step int")
    simple = spark.createDataFrame([(i, day(i)) for i in range(100)], "k int, at timestamp_ntz")
    T = tables.Retained
    out = tables.retained(
        {"runs": T(runs, "at", 30, F.col("done")), "steps": T(steps, "at", 25, None, ("runs", "run", "run")), "logs": T(logs, parent=("steps", "step", "step")), "a": T(simple, "at", 10), "b": T(simple, "at", 90), "c": T(simple)},
        F.lit(now),
    )
    kept_runs = [i for i in range(60) if not (i > 30 and i % 3 == 0)]
    kept_steps = [i for i in range(130) if i // 4 <= 25 and (i // 2 in kept_runs or i // 2 >= 60)]
    assert sorted(r.run for r in out["runs"].collect()) == sorted([*kept_runs, 7])
    assert sorted(r.step for r in out["steps"].collect()) == kept_steps
    assert sorted(r.log for r in out["logs"].collect()) == [i for i in range(300) if i % 130 in kept_steps]
    assert [out[n].count() for n in "abc"] == [11, 91, 100]
