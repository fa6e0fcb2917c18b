"""The streaming forms give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import state as batch
from millrace.streaming import state


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def landed(spark, rows, schema, path, parts=2):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts == 1 else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streaks(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id bigint, app_id bigint, target string, ts timestamp, ok boolean"
    rows = [(i, i % 2, "t", base + dt.timedelta(hours=i), i % 7 == 0) for i in range(40)]
    got = drain(state.streaks(landed(spark, rows, schema, tmp_path / "p"), 3), "streaks")
    want = batch.failure_streaks(spark.createDataFrame(rows, schema), ["app_id", "target"], "ts", "event_id").collect()
    assert {r.event_id: r.consecutive_failures for r in got} == {r.event_id: r.consecutive_failures for r in want}
    assert {r.event_id for r in got if r.crossed} == {r.event_id for r in want if r.consecutive_failures == 3}


def test_limits_and_opens(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(seconds=i)) for i in range(5)] + [("b", base)] + [("z", base + dt.timedelta(days=9))]
    stream = landed(spark, rows, "k string, ts timestamp", tmp_path / "e", 1)
    got = drain(state.over_limit(stream, "k", "ts", "1 minute", 3), "limits")
    assert [(r.k, r.n_events) for r in got] == [("a", 5)]
    firsts = drain(state.first_opens(stream, ["k"], "ts"), "opens")
    assert sorted(r.k for r in firsts) == ["a", "b", "z"]


def test_large_keys_keep_only_numbers(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(state, "CHUNK", 4)
    whole = pd.DataFrame({"ts": pd.to_datetime(["2024-01-07", "2024-01-01", "2024-01-01", None]), "event_id": [3, 2, 1, 4], "ok": [False, True, False, False], "key": "a", "user_id": 5})
    ts, ids, ok = state._in_order(iter([whole[:2], whole[2:]]), "ok")
    assert ids.tolist() == [1, 2, 3, 4] and ok.tolist() == [False, True, False, False] and np.isnat(ts.view("datetime64[us]")).tolist() == [False] * 3 + [True]
    steps = list(state._given({"key": "a", "event_id": np.arange(9)}))
    assert [len(x) for x in steps] == [4, 4, 1] and steps[2].key.tolist() == ["a"] and steps[2].event_id.tolist() == [8]


def test_retained_keys_share_states(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"k{i}", base + dt.timedelta(days=20 * (i % 2))) for i in range(4000)]
    df = state.retained(landed(spark, rows, "key string, ts timestamp", tmp_path / "r", 1), 5)
    q = df.writeStream.format("memory").queryName("shared_states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= state.BUCKETS  # 4000 when each key had a state and a call of its own
    assert {(r.key, r.n_events, r.last_at) for r in spark.table("shared_states").collect()} == {(k, 1, t) for k, t in rows if t == base}


def test_retained_in_one_bucket_over_batches(spark, tmp_path):
    base, schema = dt.datetime(2024, 1, 1), "key string, ts timestamp"
    days = [[("a", 0), ("b", 1), (None, 0)], [("a", 4), ("c", 4), ("n", None)], [("c", 9), ("z", 9)], [("a", 12), ("z", 30)], [("b", 31), ("z", 60)]]
    batches = [[(k, None if d is None else base + dt.timedelta(days=d)) for k, d in b] for b in days]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "o"))
    got = sorted(((r.key or "", r.n_events, (r.last_at - base).days) for r in drain(state.retained(stream, 5, buckets=1), "one_bucket")))
    # a and c outlive a batch that another key leaves with, b comes again, z is live and n has no time
    assert got == [("", 1, 0), ("a", 3, 12), ("b", 1, 1), ("b", 1, 31), ("c", 2, 9)]
