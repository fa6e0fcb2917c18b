"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows of a frame that a step gives out.
CHUNK = 100_000
_NO_TIME = np.iinfo("int64").min


def _in_order(batches: Iterator[pd.DataFrame], *values: str) -> tuple[np.ndarray, ...]:
    """ts in microseconds, event_id and the named values of a key's rows, in order of ts and event_id, rows without a time last.

    Only these numbers are held, 16 bytes a row and their order; the other columns go with each batch."""
    kept = [(b["ts"].to_numpy().astype("datetime64[us]").astype("int64"), *(np.array(b[c]) for c in ("event_id", *values))) for b in batches]
    columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
    kept.clear()
    order = np.lexsort((columns[1], columns[0], columns[0] == _NO_TIME))
    for i, c in enumerate(columns):
        columns[i] = c[order]
    return tuple(columns)


def _given(columns: dict) -> Iterator[pd.DataFrame]:
    """The columns as frames of bounded size; what is no array is the same in all rows."""
    size = len(columns["event_id"])
    for at in range(0, size, CHUNK):
        yield pd.DataFrame({k: v[at : at + CHUNK] if isinstance(v, np.ndarray) else v for k, v in columns.items()})


STREAKS = "app_id bigint, target string, event_id bigint, ts timestamp, consecutive_failures bigint, crossed boolean"


def streaks(probes: DataFrame, threshold: int = 7) -> DataFrame:
    """Failure streaks of a stream of probes (event_id, app_id, target, ts, ok): the state of a key is one number.

    Rows of a micro-batch are taken in order of ts and event_id; a probe that comes in a later batch counts when it comes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ids, ok = _in_order(batches, "ok")
        place = np.arange(1, len(ts) + 1)
        last = np.maximum.accumulate(np.where(ok.astype(bool), place, 0))
        counts = place - last + np.where(last == 0, state.get[0] if state.exists else 0, 0)
        state.update((int(counts[-1]),))
        yield from _given({"app_id": key[0], "target": key[1], "event_id": ids, "ts": ts.view("datetime64[us]"), "consecutive_failures": counts, "crossed": counts == threshold})

    return probes.groupBy("app_id", "target").applyInPandasWithState(step, STREAKS, "run bigint", "append", GroupStateTimeout.NoTimeout)


STARTS = "key string, event_id bigint, ts timestamp, start timestamp"


def throttled(requests: DataFrame, interval: str) -> DataFrame:
    """When each request (key, event_id, ts) of a stream may start if starts of a key are an interval apart: the state of a
    key is the time from which it is free. Rows of a micro-batch are taken in order of ts and event_id; those of a key meet
    in one task, which holds some numbers for each. A request without a time starts when its key is free."""
    step_us = pd.Timedelta(interval) // pd.Timedelta(microseconds=1)
    never = _NO_TIME // 2

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ids = _in_order(batches)
        free = state.get[0] if state.exists else None
        start = np.arange(0, -len(ts) * step_us, -step_us)
        start += ts  # as if no request took time
        start[ts == _NO_TIME] = _NO_TIME
        if free is not None:
            np.maximum(start, free, out=start)
        np.maximum.accumulate(start, out=start)
        start += np.where(start < never, 0, np.arange(0, len(ts) * step_us, step_us))
        if start[-1] != _NO_TIME:
            state.update((int(start[-1]) + step_us,))
        yield from _given({"key": key[0], "event_id": ids, "ts": ts.view("datetime64[us]"), "start": start.view("datetime64[us]")})

    needed = requests.select("key", "event_id", "ts")
    return needed.groupBy("key").applyInPandasWithState(step, STARTS, "free bigint", "append", GroupStateTimeout.NoTimeout)


RETAINED = "key string, n_events bigint, last_at timestamp"
#: Groups of keys that share a state; a checkpoint holds for one number only.
BUCKETS = 1024


def retained(events: DataFrame, days: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Counts of keys of a stream (key, ts), each put out and forgotten once the watermark is `days` past its last event:
    state is kept for live keys only, as a retention of rows keeps a table. A key without any time stays.

    Keys are dealt to buckets by a hash, and a state holds the live keys of a bucket: what a step costs besides its rows is
    spent once a bucket and not once a key."""
    kept_ms = days * 86_400_000

    def counted(key, n, last) -> pd.DataFrame:
        rows = pd.DataFrame({"key": pd.Series(key, dtype=object), "n": np.asarray(n, "int64"), "last": np.asarray(last, "int64")})
        return rows.groupby("key", dropna=False, sort=False, as_index=False).agg({"n": "sum", "last": "max"})

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = counted(*(state.get if state.exists else ([], [], [])))
        if not state.hasTimedOut:
            for rows in batches:
                ts = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")  # no time is the least number
                new = counted(rows["key"], np.ones(len(rows)), ts)
                held = counted(*(pd.concat([held[c], new[c]], ignore_index=True) for c in ("key", "n", "last")))
        now = state.getCurrentWatermarkMs()
        timed = held["last"] != _NO_TIME
        over = timed & (held["last"] // 1000 + kept_ms < now)
        gone, held = held[over], held[~over]
        if len(held):
            state.update(([None if pd.isna(k) else k for k in held["key"]], held["n"].tolist(), held["last"].tolist()))
            if (timed & ~over).any():
                state.setTimeoutTimestamp(max(int(held["last"][timed].min()) // 1000 + kept_ms, now, 1))
        elif state.exists:
            state.remove()
        if len(gone):
            yield pd.DataFrame({"key": gone["key"], "n_events": gone["n"], "last_at": gone["last"].to_numpy().view("datetime64[us]")})

    dealt = events.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).select("bucket", "key", "ts")
    state_of = "keys array<string>, n array<bigint>, last array<bigint>"
    return dealt.groupBy("bucket").applyInPandasWithState(step, RETAINED, state_of, "append", GroupStateTimeout.EventTimeTimeout)


def over_limit(events: DataFrame, key: str, at: str, window: str, limit: int, late: str = "1 hour") -> DataFrame:
    """Tumbling windows in which a key has more events than the limit; final once the watermark passes them."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window).alias("slot"), key).agg(F.count("*").alias("n_events"))
    return counted.where(F.col("n_events") > limit).select(key, F.col("slot.start").alias("slot"), "n_events")


def first_opens(events: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def trending_windows(clicks: DataFrame, at: str = "created_at", width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Clicks of each app in overlapping windows."""
    counted = clicks.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), "app_id").agg(F.count("*").alias("n_clicks"))
    return counted.select("app_id", F.col("w.end").alias("until"), "n_clicks")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events with less than the gap between them."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n_events"))
    return counted.select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n_events")


def each_batch(stream: DataFrame, recompute: Callable[[DataFrame, DataFrame], None], changed: list[str], checkpoint: str):
    """Runs recompute(batch, keys) for each micro-batch with the distinct keys that it touches: re-index on change,
    budget totals. recompute must be idempotent, as a batch may run again."""

    def run(batch: DataFrame, _: int) -> None:
        recompute(batch, batch.select(*changed).distinct())

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
