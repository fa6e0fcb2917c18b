"""Captured clicks and latches of streams that fail and are started again; deep pages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as rel
from millrace.sinks.snapshots import Snapshots
from millrace.streaming import capture

BASE = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def landed(spark, data, schema, path, parts):
    for k in range(parts):
        spark.createDataFrame(data[k::parts], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_clicks_are_checked_and_stored_once(spark, tmp_path):
    schema = "event_id bigint, app_id bigint, link_type string, url string, source_page string, source_position string"
    links = spark.createDataFrame([(1, "official", "https://a.example/x"), (1, "official", "https://a.example/x"), (2, "install", "https://b.example"), (3, "official", "javascript:x")], "app_id bigint, link_type string, url string")
    cases = [(1, "official", " https://a.example/x "), (1, "install", "https://a.example/x"), (2, "install", "https://b.example"), (2, "install", "https://evil.example"), (3, "official", "javascript:x"), (9, "official", "https://a.example/x")]
    data = [(10 * n + k, *c, "p" * 300, "7" if n % 2 else "x") for n in range(6) for k, c in enumerate(cases)]
    stream = landed(spark, data, schema, tmp_path / "in", 3)
    want = rows(capture.checked(spark.createDataFrame(data, schema), links))
    assert {r[0] for r in want} == {10 * n + k for n in range(6) for k in (0, 2)}
    assert all(len(r[4]) == 100 for r in want) and {r[5] for r in want} == {7, None}

    class Failing(Snapshots):
        """Its second commit is published, and then the run is killed."""

        failed = False

        def commit(self, *args, **kwargs):
            out = super().commit(*args, **kwargs)
            if self.version() == 2 and not Failing.failed:
                Failing.failed = True
                raise RuntimeError("killed")
            return out

    store = Failing(spark, str(tmp_path / "store"), keep=10)
    run = lambda: capture.stored(capture.checked(stream, links), store, "clicks", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    run()
    assert rows(store.read("clicks").drop("batch")) == want and Failing.failed


def test_latches_fire_once_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    schema = "key string, event_id bigint, ts timestamp, cost bigint"
    data = [(rng.choice("ab"), i, BASE + dt.timedelta(minutes=i), rng.randrange(50)) for i in range(120)]
    limits = {"warned": 500, "stopped": 1100, "never": 10**9, "off": 0}
    want = rows(capture.latches_of_table(spark.createDataFrame(data, schema), limits))
    assert len(want) == 4
    out = str(tmp_path / "out")
    for k in range(4):  # a file at a time, and the query is started anew for each
        spark.createDataFrame(data[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        capture.latches(stream, limits).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(120)
    assert rows(spark.read.parquet(out)) == want


def test_deep_pages_read_few_ranges(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randrange(40)) for i in range(1003)], "k bigint, v int").repartition(5)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored, ranges = rel.counted_ranges(df, "-v", "k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges.count() > 10
    for number in (1, 2, 7, 50, 67, 68, 10_000):
        got = rel.deep_page(stored, ranges, number, 15, "-v", "k")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in rel.page(df, number, 15, F.desc("v"), F.asc("k")).collect()], number
    plan = rel.deep_page(stored, ranges, 40, 15, "-v", "k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan or "PartitionFilters: [isnotnull(_range" in plan or "_range" in plan.split("PartitionFilters")[1][:80]
    assert len(rel.deep_page(stored, ranges, 40, 15, "-v", "k").collect()) == 15
    assert [r.k for r in rel.shown_page(df.where("k < 31"), 99, 10, F.asc("k")).collect()] == [30]
