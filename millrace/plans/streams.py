"""Events as a stream: what each streaming form has put out once all events are read.

The events are read in one micro-batch, as one that takes files in another order than time would drop late rows. Windows and
keys that the watermark has not passed stay in state, and the SQL leaves them out likewise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drained
from ..streaming import state
from ..tables import Tables
from . import views
from .registry import query
from .state import _STREAKS


class _Streamed(Tables):
    """The tables, each read as a stream."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.stream(name)


def _timed(df: DataFrame, *more: str) -> DataFrame:
    """Events with a time that a watermark takes."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", *more)


def _plain(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query(_STREAKS + "SELECT event_id, app_id, target, consecutive_failures, consecutive_failures = 3 AS crossed FROM s")
def streamed_streaks(t: Tables) -> DataFrame:
    """Failure streaks with one number of state for each link."""
    probes = views.probes(_Streamed(t._spark, t._folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(state.streaks(probes, 3)).select("event_id", "app_id", "target", "consecutive_failures", "crossed")


@query(
    """WITH n AS (SELECT event_id, event_type AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
    SELECT event_id, key, make_timestamp(CAST(max(t - i * 600000000) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 600000000 AS BIGINT)) AS start FROM n"""
)
def streamed_throttle(t: Tables) -> DataFrame:
    """When requests of a kind may start, ten minutes apart, with the next free time as state."""
    out = drained(state.throttled(_timed(t.stream("events")).withColumnRenamed("event_type", "key"), "10 minutes"))
    return _plain(out, "start").select("event_id", "key", "start")


@query(
    """WITH w AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS slot, count(*) AS n_events FROM events GROUP BY 1, 2)
    SELECT user_id, slot, n_events FROM w WHERE n_events > 3 AND slot + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"""
)
def streamed_over_limit(t: Tables) -> DataFrame:
    """Users with more than three events in a day."""
    return _plain(drained(state.over_limit(_timed(t.stream("events")), "user_id", "ts", "1 day", 3)), "slot")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_first_opens(t: Tables) -> DataFrame:
    """Each user's first event of a type."""
    return drained(state.first_opens(_timed(t.stream("events")), ["user_id", "event_type"], "ts")).select("user_id", "event_type")


@query(
    """WITH w AS (SELECT user_id AS app_id, ts, unnest(range(1, 8)) AS d FROM events WHERE event_type <> 'error'),
    g AS (SELECT app_id, CAST(date_trunc('day', ts) AS TIMESTAMP) + d * INTERVAL '1 day' AS until, count(*) AS n_clicks FROM w GROUP BY 1, 2)
    SELECT * FROM g WHERE until <= (SELECT max(ts) - INTERVAL '1 day' FROM events WHERE event_type <> 'error')"""
)
def streamed_trending_windows(t: Tables) -> DataFrame:
    """Clicks of each app in windows of seven days that begin daily."""
    clicks = views.clicks(_Streamed(t._spark, t._folder)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return _plain(drained(state.trending_windows(clicks)), "until")


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', true) AS opens FROM events),
    n AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n_events FROM n GROUP BY user_id, s
    HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"""
)
def streamed_sessions(t: Tables) -> DataFrame:
    """Sessions of users, which six hours without an event end."""
    return _plain(drained(state.sessions(_timed(t.stream("events")), "user_id", "ts", "6 hours")), "begin", "end")


@query(
    """SELECT user_id || ' ' || event_type AS key, count(*) AS n_events, max(ts) AS last_at FROM events GROUP BY ALL
    HAVING max(epoch_ms(ts)) + 3 * 86400000 < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)"""
)
def streamed_retention(t: Tables) -> DataFrame:
    """Keys without an event for three days, put out and forgotten."""
    keyed = _timed(t.stream("events")).select(F.concat_ws(" ", "user_id", "event_type").alias("key"), "ts")
    return _plain(drained(state.retained(keyed, 3)), "last_at")
