"""Landed answers and drained streams beyond what their registered queries hold."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.sources import feeds
from millrace.storage import drained
from millrace.streaming import state
from millrace.tables import Tables


def test_client_addresses(spark):
    rows = [("1.1.1.1, 2.2.2.2", "r"), (" 3.3.3.3 ", "r"), (" , 2.2.2.2", "r"), ("", "r"), (None, "r"), (None, None)]
    got = spark.createDataFrame(rows, "h string, r string").select(tx.client_ip(F.col("h"), F.col("r")).alias("a")).collect()
    assert [r.a for r in got] == ["1.1.1.1", "3.3.3.3", "", "r", "r", ""]


def test_fixture_rows_of_broken_texts(spark):
    raw = spark.createDataFrame([('[{"model": "m", "pk": 1, "fields": {"a": 1, "b": null}}]',), ("oops",), ("[]",), (None,)], "value string")
    assert [(r.model, r.pk, r.fields) for r in feeds.fixture_rows(raw).collect()] == [("m", 1, {"a": "1", "b": None})]


def test_streams_of_files_and_folders(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 2], base + dt.timedelta(minutes=i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id bigint, key string, ts timestamp")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))  # a folder; the tables at hand are files
    got = drained(state.throttled(Tables(spark, str(tmp_path)).stream("events"), "10 minutes"))
    assert got.count() == 200 and got.select("event_id").distinct().count() == 200
    last = {r.key: r.start for r in got.groupBy("key").agg(F.max("start").alias("start")).collect()}
    assert last == {"a": base + dt.timedelta(minutes=990), "b": base + dt.timedelta(minutes=991)}


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "user_id bigint, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    stream = Tables(spark, str(tmp_path)).stream("events")
    assert drained(state.over_limit(stream, "user_id", "ts", "1 minute", 3)).collect() == []


def test_detail_pages_are_spread(spark):
    import re

    from millrace.plans import registry

    plan = registry.queries()["directory_drafts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Repartition \d+, true", plan)
