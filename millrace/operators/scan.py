"""Running values of keys that may hold a large part of a table, by two levels.

Rows are dealt by range of (key, order), so a hot key is spread over as many tasks as its rows need. Within a range a window
gives each row its value as if the key began there; each range sums a key up in one row; and what a key brings into a range
follows from the few rows of its ranges before. What is summed up is such that two summaries in a row make one: a streak is
the failures at the end and whether there are only failures, a throttle the latest free time and a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import micros
from ..storage import materialise

PART = "_part"


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df by ranges of keys and order, with the number of the range. Ranges rise with the order; it should have no ties."""
    return materialise(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def earlier(keys: list[str]) -> Window:
    """The ranges of a key before the one at hand."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def failure_streaks(probes: DataFrame, keys: list[str], at: str, order: str, ok: str = "ok") -> DataFrame:
    """state.failure_streaks for keys of any size."""
    rows = dealt(probes, keys, [at, order])
    line = Window.partitionBy(PART, *keys).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_streak", F.sum(F.col(ok).cast("int")).over(line))
    inner = Window.partitionBy(PART, *keys, "_streak").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum((~F.col(ok)).cast("int")).over(inner).cast("bigint"))
    ends = rows.groupBy(*keys, PART).agg(F.max_by("_run", F.struct(at, order)).alias("_tail"), F.max("_streak").alias("_oks"))
    # failures at the end of the ranges before: those since the last range that has a success, which gives its own tail
    mark = F.sum((F.col("_oks") > 0).cast("int")).over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, 0))
    since = Window.partitionBy(*keys, "_mark").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_mark", mark).withColumn("_till", F.sum("_tail").over(since))
    carried = ends.select(*keys, PART, F.coalesce(F.lag("_till").over(Window.partitionBy(*keys).orderBy(PART)), F.lit(0)).alias("_before"))
    out = rows.join(carried, [*keys, PART])
    return out.select(*probes.columns, (F.col("_run") + F.when(F.col("_streak") == 0, F.col("_before")).otherwise(0)).alias("consecutive_failures"))


def throttled(requests: DataFrame, key: str, at: str, order: str, interval_us: int) -> DataFrame:
    """state.throttled for keys of any size: start_i = max over j <= i of (t_j - j d) + i d, with j counted over ranges."""
    step = F.lit(interval_us)
    rows = dealt(requests, [key], [at, order]).withColumn("_t", micros(F.col(at)))
    line = Window.partitionBy(PART, key).orderBy(at, order)
    rows = rows.withColumn("_i", F.row_number().over(line).cast("bigint"))
    rows = rows.withColumn("_free", F.max(F.col("_t") - F.col("_i") * step).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(key, PART).agg(F.count("*").alias("_n"), F.max("_free").alias("_most"))
    ends = ends.withColumn("_off", F.coalesce(F.sum("_n").over(earlier([key])), F.lit(0)))
    ends = ends.withColumn("_held", F.max(F.col("_most") - F.col("_off") * step).over(earlier([key])))
    out = rows.join(ends.select(key, PART, "_off", "_held"), [key, PART])
    start = F.greatest(F.col("_held"), F.col("_free") - F.col("_off") * step) + (F.col("_i") + F.col("_off")) * step
    return out.withColumn("start_us", start).select(*requests.columns, "start_us", (start - F.col("_t")).alias("wait_us"))


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "total") -> DataFrame:
    """rows with the sum of `value` up to each row of its keys."""
    out = dealt(rows, keys, order)
    within = F.sum(value).over(Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = out.groupBy(*keys, PART).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, PART, F.sum("_sum").over(earlier(keys)).alias("_before"))
    both = out.withColumn("_within", within).join(sums, [*keys, PART])
    return both.select(*rows.columns, (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_within")).alias(name))


def first_reached(rows: DataFrame, keys: list[str], order: list[str], value: str, latches: dict[str, Column]) -> DataFrame:
    """keys with, for each latch, the first of order[0] at which the running total reaches it; a latch that is null or 0 never
    falls. A latch falls once, however the total goes on."""
    total = running_total(rows, keys, order, value)
    return total.groupBy(*keys).agg(*(F.min(F.when((limit > 0) & (F.col("total") >= limit), F.col(order[0]))).alias(name) for name, limit in latches.items()))
