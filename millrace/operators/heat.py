"""Trending from stored sums of days.

The decay of a click is 24 / (24 + age in hours), so a sum of decays cannot be carried on to another time by a factor. What a
day stores for each app are moments of its clicks instead: sums of weight times the k-th power of the distance from noon, in
half days. For a time at or after the end of the day, with x = 24 + hours since its noon, a click's decay is the geometric
series of (distance / x), whose ratio is a third at most, so MOMENTS terms give every later score to twelve digits. A run
computes the sums of one day from that day's clicks; scores read a few days of sums and the clicks of the days that a window
cuts, which are two at most for each window."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import decay, hours_between, micros
from .rank import PAGE_WEIGHTS, QUALITY_FLOOR, WINDOWS, weight_of

#: Powers that are stored; the rest of the series is below 3 ** -MOMENTS of the sum.
MOMENTS = 26
_HALF_DAY = 43_200_000_000


def day_sums(clicks: DataFrame, weights: dict[str, float] = PAGE_WEIGHTS) -> DataFrame:
    """(app_id, day, moments) of clicks (app_id, source_page, created_at): a row for each app and day."""
    day = F.col("created_at").cast("date")
    off = (micros(F.col("created_at")) - micros(day.cast("timestamp")) - F.lit(_HALF_DAY)) / F.lit(float(_HALF_DAY))
    each = clicks.select("app_id", day.alias("day"), off.alias("off"), weight_of(F.col("source_page"), weights).alias("w"))
    sums = [F.sum(F.col("w") * F.pow("off", F.lit(float(k)))) for k in range(MOMENTS)]
    return each.groupBy("app_id", "day").agg(F.array(*sums).alias("moments"))


def heat_at(moments: Column, day: Column, as_of: dt.datetime) -> Column:
    """The decayed sum of a day's clicks at a time that is not before its end."""
    x = (hours_between(F.lit(as_of), day.cast("timestamp_ntz"))) + F.lit(24.0 - 12.0)
    ratio = F.lit(12.0) / x
    series = reduce(lambda s, k: s * ratio + F.get(moments, F.lit(k)), range(MOMENTS - 2, -1, -1), F.get(moments, F.lit(MOMENTS - 1)))
    return F.lit(24.0) / x * series


class Window:
    """The days that a window of `days` before a time holds whole, and those that it cuts."""

    def __init__(self, as_of: dt.datetime, days: int):
        self.start, self.end = as_of - dt.timedelta(days=days), as_of
        first = self.start.date() + dt.timedelta(days=self.start.time() != dt.time())
        self.whole = [first + dt.timedelta(days=k) for k in range((as_of.date() - first).days)]
        self.cut = {as_of.date()} | ({self.start.date()} if self.start.time() != dt.time() else set())


def days_needed(as_of: dt.datetime, windows: tuple[int, ...] = WINDOWS) -> tuple[list[dt.date], list[dt.date]]:
    """The days whose sums, and the days whose clicks, the scores of a time need."""
    spans = [Window(as_of, w) for w in windows]
    return sorted({d for s in spans for d in s.whole}), sorted({d for s in spans for d in s.cut})


def trending(apps: DataFrame, sums: DataFrame, clicks: DataFrame, as_of: dt.datetime, windows: tuple[int, ...] = WINDOWS, weights: dict[str, float] = PAGE_WEIGHTS) -> DataFrame:
    """rank.trending from day_sums and the clicks of cut days, as days_needed names them (further rows change nothing)."""
    spans = {w: Window(as_of, w) for w in windows}
    within = lambda days: F.col("day").isin(*days) if days else F.lit(False)
    whole = sums.select("app_id", "day", heat_at(F.col("moments"), F.col("day"), as_of).alias("heat"))
    parts = whole.select("app_id", *(F.when(within(s.whole), F.col("heat")).alias(f"heat_{w}") for w, s in spans.items()))
    at = F.col("created_at")
    own = clicks.select("app_id", at, at.cast("date").alias("day"), (decay(hours_between(F.lit(as_of), at)) * weight_of(F.col("source_page"), weights)).alias("heat"))
    cut = own.select("app_id", *(F.when(within(s.cut) & (at >= F.lit(s.start)) & (at <= F.lit(s.end)), F.col("heat")).alias(f"heat_{w}") for w, s in spans.items()))
    heats = parts.unionAll(cut).groupBy("app_id").agg(*(F.sum(f"heat_{w}").alias(f"heat_{w}") for w in windows))
    share = F.col("quality_score") / F.lit(100.0)
    scores = [F.round(F.coalesce(F.col(f"heat_{w}") * F.greatest(F.lit(QUALITY_FLOOR), share), share), 6).alias(f"score_{w}d") for w in windows]
    return apps.select("app_id", "quality_score").join(heats, "app_id", "left").select("app_id", "quality_score", *scores)
