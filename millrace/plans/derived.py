"""Derived tables, published as versions and read from there: reports of a run, and trending from stored days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heat, rank
from ..sinks.snapshots import Snapshots
from ..storage import delete_at_exit, fresh_path
from ..tables import Tables
from . import catalog, reports, state, views
from .registry import AS_OF_TEXT, SQL, query


def fresh_snapshots(spark: SparkSession, name: str) -> Snapshots:
    """Snapshots in a folder of their own that goes when the application ends."""
    root = fresh_path(spark, name)
    delete_at_exit(spark, root)
    return Snapshots(spark, root)


def published(spark: SparkSession, tables: dict[str, DataFrame], times: int = 2) -> Snapshots:
    """The tables as one version, committed more than once: a run that is repeated changes nothing."""
    out = fresh_snapshots(spark, "published")
    for _ in range(times):
        out.commit(tables)
    return out


def _derived(t: Tables) -> Snapshots:
    """Trending, popular searches, link health and budget months of one run, as one commit."""
    tables = {"trending": catalog.trending_scores(t), "popular_searches": reports.popular_searches(t), "link_health": state.failure_streaks(t), "budget": state.budget_latches(t)}
    return published(t.part.sparkSession, tables)


@query(SQL["trending_scores"])
def derived_trending(t: Tables) -> DataFrame:
    return _derived(t).read("trending")


@query(SQL["popular_searches"])
def derived_popular_searches(t: Tables) -> DataFrame:
    return _derived(t).read("popular_searches")


@query(SQL["failure_streaks"])
def derived_link_health(t: Tables) -> DataFrame:
    return _derived(t).read("link_health")


@query(SQL["budget_latches"])
def derived_budget(t: Tables) -> DataFrame:
    return _derived(t).read("budget")


def add_days(days: Snapshots, clicks: DataFrame, weights: dict[str, float] = rank.PAGE_WEIGHTS) -> None:
    """Stores the sums and the clicks of the whole days that clicks hold, in place of what these days had."""
    sums = heat.day_sums(clicks, weights)
    days.commit(slotted={"sums": (sums, "day"), "clicks": (clicks.withColumn("day", F.col("created_at").cast("date")), "day")})


def trending_of_days(days: Snapshots, apps: DataFrame, as_of: dt.datetime, weights: dict[str, float] = rank.PAGE_WEIGHTS) -> DataFrame:
    """Trending scores out of stored days: some days of sums, and the clicks of days that a window cuts."""
    whole, cut = heat.days_needed(as_of)
    return heat.trending(apps, days.read("sums", whole), days.read("clicks", cut), as_of, weights=weights)


@query(SQL["trending_scores"])
def trending_from_days(t: Tables) -> DataFrame:
    """All days but the last are stored first, then the last one is added from its own clicks, and scores come from the days."""
    as_of = dt.datetime.fromisoformat(AS_OF_TEXT)
    days, clicks = fresh_snapshots(t.part.sparkSession, "days"), views.clicks(t)
    last = F.lit(as_of.date() - dt.timedelta(days=1))
    add_days(days, clicks.where(F.col("created_at").cast("date") < last), views.EVENT_WEIGHTS)
    add_days(days, clicks.where(F.col("created_at").cast("date") >= last), views.EVENT_WEIGHTS)
    return trending_of_days(days, views.apps(t), as_of, views.EVENT_WEIGHTS)
