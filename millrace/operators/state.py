"""Streaks, latches, throttles and rate limits as window functions over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import micros

FAILURES = 7
LATCHES = ((0.8, "discovery_disabled_at"), (1.0, "hard_stop_at"))


def failure_streaks(probes: DataFrame, keys: list[str], at: str, order: str, ok: str = "ok") -> DataFrame:
    """probes with consecutive_failures: failures since the last success of the key, this one included.

    Skew: a key's probes meet in one task, as its running state needs them in order; state is a few numbers, so a long
    key costs time and a spilled sort but no memory."""
    line = Window.partitionBy(*keys).orderBy(at, order)
    marked = probes.withColumn("_streak", F.sum(F.col(ok).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_streak").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("consecutive_failures", F.sum((~F.col(ok)).cast("int")).over(inner).cast("bigint")).drop("_streak")


def crossings(streaks: DataFrame, threshold: int = FAILURES) -> DataFrame:
    """The probes that bring a streak to the threshold: one for each streak."""
    return streaks.where(F.col("consecutive_failures") == threshold)


def link_health(streaks: DataFrame, keys: list[str], at: str, order: str, threshold: int = FAILURES) -> DataFrame:
    """The state of each key: failures now, last success and failure, and whether it ever reached the threshold."""
    last = F.max_by("consecutive_failures", F.struct(at, order))
    return streaks.groupBy(*keys).agg(
        last.alias("consecutive_failures"),
        F.max(F.when(F.col("ok"), F.col(at))).alias("last_ok_at"),
        F.max(F.when(~F.col("ok"), F.col(at))).alias("last_failed_at"),
        F.bool_or(F.col("consecutive_failures") >= threshold).alias("deprecated"),
    )


def budget_latches(costs: DataFrame, budget: Column, at: str, order: str, cost: str) -> DataFrame:
    """For each month: the total, and when the running total first reached each share of the budget.

    Days are summed first; only the days up to a latch need their rows in order, so no task sorts a month of rows."""
    month = F.trunc(F.col(at), "MM").alias("month")
    held = costs.select(month, F.col(at).cast("date").alias("day"), F.col(at).alias("at"), F.col(order).alias("seq"), F.col(cost).alias("cost"), budget.alias("budget"))
    days = held.groupBy("month", "day").agg(F.sum("cost").alias("spent"), F.max("budget").alias("budget"))
    run = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("till", F.sum("spent").over(run)).withColumn("before", F.col("till") - F.col("spent"))
    reached = lambda total, share: (F.col("budget") > 0) & (total >= F.col("budget") * F.lit(share).cast("decimal(4,2)"))
    crossing = [(reached(F.col("till"), s) & ~reached(F.col("before"), s)) for s, _ in LATCHES]
    marked = days.where(crossing[0] | crossing[1]).select("month", "day", "before")
    line = Window.partitionBy("month", "day").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    near = held.join(marked, ["month", "day"]).withColumn("total", F.col("before") + F.sum("cost").over(line))
    stamps = near.groupBy("month").agg(*(F.min(F.when(reached(F.col("total"), s), F.col("at"))).alias(n) for s, n in LATCHES))
    return days.groupBy("month").agg(F.sum("spent").alias("total")).join(stamps, "month", "left")


def budget_gates(months: DataFrame, total: str, budget: str) -> DataFrame:
    """months with the utilization of the budget and two gates: hard_stopped, and the weaker discovery_disabled. Without a
    budget (null or 0) there is no utilization and no gate."""
    has = F.coalesce(F.col(budget) > 0, F.lit(False))
    reached = lambda share: has & F.coalesce(F.col(total) >= F.col(budget) * F.lit(share).cast("decimal(4,2)"), F.lit(False))
    used = F.when(has, F.round(F.col(total).cast("double") / F.col(budget), 4))
    return months.withColumns({"utilization": used, "hard_stopped": reached(1.0), "discovery_disabled": reached(0.8)})


def throttled(requests: DataFrame, key: str, at: str, order: str, interval_us: int) -> DataFrame:
    """requests with start_us: when each may start if starts of a key are an interval apart.

    start_i = max over j <= i of (t_j - j d) + i d, the closed form of the sequential rule."""
    line = Window.partitionBy(key).orderBy(at, order)
    numbered = requests.withColumn("_i", F.row_number().over(line).cast("bigint")).withColumn("_t", micros(F.col(at)))
    free = F.max(F.col("_t") - F.col("_i") * F.lit(interval_us)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    out = numbered.withColumn("start_us", free + F.col("_i") * F.lit(interval_us))
    return out.withColumn("wait_us", F.col("start_us") - F.col("_t")).drop("_i", "_t")


def over_limit(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Fixed windows in which a key has more events than the limit."""
    slot = F.floor(micros(F.col(at)) / F.lit(seconds * 1_000_000)).cast("bigint")
    return events.groupBy(key, slot.alias("slot")).agg(F.count("*").alias("n_events")).where(F.col("n_events") > limit)


def first_opens(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each key the first event and the number of all: unique opens and total opens."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_at"), F.count("*").alias("total"))


def expired(events: DataFrame, at: str, as_of: Column, days: int) -> Column:
    """Whether a row is past its retention."""
    return F.col(at) < as_of - F.make_dt_interval(F.lit(days))
