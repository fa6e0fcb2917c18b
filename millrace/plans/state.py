"""Streaks, latches, throttles, rate limits, retention and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as rel, scan, state
from ..tables import Tables
from . import views
from .registry import AS_OF_TEXT, as_of, query

_STREAKS = f"""WITH p AS ({views.PROBES_SQL}),
g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY app_id, target ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM p),
s AS (SELECT *, CAST(sum((NOT ok)::INT) OVER (PARTITION BY app_id, target, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_failures FROM g)
"""


def _streaks(t: Tables) -> DataFrame:
    return state.failure_streaks(views.probes(t), ["app_id", "target"], "ts", "event_id")


@query(
    _STREAKS
    + """SELECT app_id, target, arg_max(consecutive_failures, {'a': ts, 'b': event_id}) AS consecutive_failures, max(ts) FILTER (ok) AS last_ok_at,
    max(ts) FILTER (NOT ok) AS last_failed_at, bool_or(consecutive_failures >= 3) AS deprecated FROM s GROUP BY ALL"""
)
def failure_streaks(t: Tables) -> DataFrame:
    return state.link_health(_streaks(t), ["app_id", "target"], "ts", "event_id", threshold=3)


@query(_STREAKS + "SELECT event_id, app_id, target, ts FROM s WHERE consecutive_failures = 3")
def threshold_crossings(t: Tables) -> DataFrame:
    return state.crossings(_streaks(t), 3).select("event_id", "app_id", "target", "ts")


@query(
    """WITH c AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, ts, event_id, CAST(value AS DECIMAL(10,6)) AS cost FROM events),
    r AS (SELECT *, sum(cost) OVER (PARTITION BY month ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM c)
    SELECT month, CAST(max(total) AS DOUBLE) AS total, min(ts) FILTER (total >= 60000 * 0.8) AS discovery_disabled_at, min(ts) FILTER (total >= 60000) AS hard_stop_at
    FROM r GROUP BY month"""
)
def budget_latches(t: Tables) -> DataFrame:
    costs = t.events.select("ts", "event_id", F.col("value").cast("decimal(10,6)").alias("cost"))
    out = state.budget_latches(costs, F.lit(60000).cast("decimal(10,2)"), "ts", "event_id", "cost")
    return out.withColumn("total", F.col("total").cast("double"))


@query(
    """WITH n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT event_id, user_id, max(t - i * 3600000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 3600000000 AS start_us,
    max(t - i * 3600000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 3600000000 - t AS wait_us FROM n"""
)
def throttle_schedule(t: Tables) -> DataFrame:
    own = t.events.select("event_id", "user_id", "ts")
    return state.throttled(own, "user_id", "ts", "event_id", 3_600_000_000).select("event_id", "user_id", "start_us", "wait_us")


@query(
    """WITH p AS (SELECT event_id, ts, event_type = 'click' AS hot, event_type <> 'error' AND event_id % 3 > 0 AS ok FROM events),
    g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY hot ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM p)
    SELECT event_id, CAST(sum((NOT ok)::INT) OVER (PARTITION BY hot, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_failures FROM g"""
)
def failure_streaks_hot(t: Tables) -> DataFrame:
    """Streaks of two keys that share all probes: each is spread over ranges of time."""
    kind = F.col("event_type")
    probes = t.events.select("event_id", "ts", (kind == "click").alias("hot"), ((kind != "error") & (F.col("event_id") % 3 > 0)).alias("ok"))
    return scan.failure_streaks(probes, ["hot"], "ts", "event_id").select("event_id", "consecutive_failures")


@query(
    """WITH n AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
    SELECT event_id, max(t - i * 600000000) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 600000000 AS start_us,
    max(t - i * 600000000) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 600000000 - t AS wait_us FROM n"""
)
def throttle_schedule_hot(t: Tables) -> DataFrame:
    """A throttle of few keys that share all requests."""
    own = t.events.select("event_id", "event_type", "ts")
    return scan.throttled(own, "event_type", "ts", "event_id", 600_000_000).select("event_id", "start_us", "wait_us")


@query(
    """WITH r AS (SELECT event_type, ts, sum(CAST(value AS DECIMAL(10,6))) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
    SELECT event_type, min(ts) FILTER (total >= 1000) AS warned_at, min(ts) FILTER (total >= 5000) AS stopped_at FROM r GROUP BY ALL"""
)
def latches_hot(t: Tables) -> DataFrame:
    """When the running total of few keys that share all rows first reached its marks."""
    own = t.events.select("event_type", "ts", "event_id", F.col("value").cast("decimal(10,6)").alias("cost"))
    return scan.first_reached(own, ["event_type"], ["ts", "event_id"], "cost", {"warned_at": F.lit(1000), "stopped_at": F.lit(5000)})


@query(
    """SELECT user_id, epoch_us(ts) // 86400000000 AS slot, count(*) AS n_events FROM events GROUP BY ALL HAVING count(*) > 5"""
)
def fixed_rate_violations(t: Tables) -> DataFrame:
    return state.over_limit(t.events, "user_id", "ts", 86400, 5)


@query(
    """SELECT user_id, CAST(props->>'$.k' AS BIGINT) % 10 AS issue, min(ts) AS first_at, count(*) AS total FROM events WHERE event_type = 'view' GROUP BY ALL"""
)
def open_dedup(t: Tables) -> DataFrame:
    opens = t.events.where(F.col("event_type") == "view").withColumn("issue", F.get_json_object("props", "$.k").cast("bigint") % 10)
    return state.first_opens(opens, ["user_id", "issue"], "ts")


@query(
    f"""SELECT event_type, count(*) AS n_rows, count(*) FILTER (ts < TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 20 DAY) AS n_expired FROM events GROUP BY ALL"""
)
def retention_counts(t: Tables) -> DataFrame:
    gone = state.expired(t.events, "ts", as_of(), 20)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if(gone).alias("n_expired"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 1000 * 100 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    o_orderstatus = 'P' AND o_totalprice < 1000 * 100 AS changed FROM orders"""
)
def guarded_status_transition(t: Tables) -> DataFrame:
    own = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    guard = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100_000)
    return rel.guarded_transition(own, "o_orderstatus", guard, "F").drop("o_totalprice")


@query("SELECT user_id AS subscriber, count(*) FILTER (event_type = 'view') AS total_opens, count(*) FILTER (event_type = 'click') AS total_clicks, max(ts) AS last_at FROM events GROUP BY ALL")
def subscriber_counters(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("subscriber")).agg(F.count_if(kind == "view").alias("total_opens"), F.count_if(kind == "click").alias("total_clicks"), F.max("ts").alias("last_at"))
