"""Trending scores, popular searches and rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clamp, decay, hours_between, points

#: Weight of a click by the page that it came from.
PAGE_WEIGHTS = {"home": 1.0, "search": 1.2, "detail": 0.8, "category": 1.1, "platform": 1.1}
WINDOWS = (1, 7, 30)
QUALITY_FLOOR = 0.1


def weight_of(page: Column, weights: dict[str, float] = PAGE_WEIGHTS, other: float = 1.0) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(page == name, F.lit(w)).otherwise(out)
    return out


def trending(apps: DataFrame, clicks: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS, weights: dict[str, float] = PAGE_WEIGHTS) -> DataFrame:
    """apps (app_id, quality_score) with score_{w}d for each window of w days.

    A click adds its decay times the weight of its page times quality; an app without clicks in a window has its
    quality alone. One pass over the longest window and one shuffle, of a row for each task and app."""
    age = hours_between(as_of, F.col("created_at"))
    recent = clicks.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(max(windows)))) & (F.col("created_at") <= as_of))
    each = recent.select("app_id", age.alias("age"), (decay(age) * weight_of(F.col("source_page"), weights)).alias("heat"))
    sums = each.groupBy("app_id").agg(*(F.sum(F.when(F.col("age") <= 24 * w, F.col("heat"))).alias(f"heat_{w}") for w in windows))
    share = F.col("quality_score") / F.lit(100.0)
    scores = {f"score_{w}d": F.round(F.coalesce(F.col(f"heat_{w}") * F.greatest(F.lit(QUALITY_FLOOR), share), share), 6) for w in windows}
    return apps.select("app_id", "quality_score").join(sums, "app_id", "left").select("app_id", "quality_score", *(c.alias(n) for n, c in scores.items()))


def trending_order(window: int = 7) -> list[Column]:
    return [F.coalesce(F.col(f"score_{window}d"), F.lit(0.0)).desc(), F.col("quality_score").desc(), F.col("app_id").asc()]


def popular_searches(log: DataFrame, as_of: Column, days: int = 30, at_least: int = 5, n: int = 50) -> DataFrame:
    """Raw queries with results that came up often lately: the n most frequent, then those of 2 to 200 characters."""
    recent = log.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("results_count") > 0))
    often = recent.groupBy("query").agg(F.count("*").alias("search_count")).where(F.col("search_count") >= at_least)
    best = often.orderBy(F.desc("search_count"), F.asc("query")).limit(n)
    trimmed = F.trim("query")
    return best.select(trimmed.alias("query"), "search_count").where(F.length(trimmed).between(2, 200))


def issue_order(trending: DataFrame, new: DataFrame, n_trending: int = 10, n_new: int = 5) -> DataFrame:
    """(app_id, place, part) of a newsletter: the first trending apps (app_id, clicks), then the newest ones (app_id, added_at), numbered on
    from the last trending one; an app of both parts has both places (top-n reports)."""
    first = trending.orderBy(F.desc("clicks"), F.asc("app_id")).limit(n_trending).select("app_id", F.lit("trending").alias("part"), F.lit(0).alias("_p"), F.col("clicks").cast("double").alias("_v"))
    second = new.orderBy(F.desc("added_at"), F.asc("app_id")).limit(n_new).select("app_id", F.lit("new").alias("part"), F.lit(1).alias("_p"), F.unix_micros(F.col("added_at").cast("timestamp")).cast("double").alias("_v"))
    place = F.row_number().over(Window.orderBy("_p", F.desc("_v"), "app_id"))  # of n_trending + n_new rows
    return first.unionAll(second).select("app_id", place.alias("place"), "part")


def quality_score(facts: DataFrame, as_of: Column) -> Column:
    """The 0 to 100 quality score from an app's facts (flags and counts joined beforehand)."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    fresh = F.coalesce(F.col("last_checked_at") > as_of - F.make_dt_interval(F.lit(30)), F.lit(False))
    return points(
        [
            (flag("is_official"), 15),
            (flag("is_reviewed"), 10),
            (flag("is_claimed"), 10),
            (flag("has_page") & flag("has_install"), 15),
            (flag("has_verdict"), 10),
            (count("n_use_cases") >= 5, 10),
            (count("n_explicit_capabilities") >= 5, 10),
            (flag("has_developer"), 5),
            (flag("has_logo"), 5),
            (fresh, 5),
            (flag("has_repo"), 5),
            (flag("is_deprecated"), -10),
            (count("n_curated_sources") == 0, -10),
            (count("n_link_failures") > 0, -5),
        ]
    )


def canonical_score(sources: Column, platforms: Column, types: Column, categories: Column, flags: list[tuple[Column, int]], text: Column) -> Column:
    """Which of two duplicates stays: counts of relations, flags and the length of the text."""
    out = 20 * sources + 15 * platforms + 10 * types + 5 * categories
    for holds, weight in flags:
        out = out + F.when(holds, weight).otherwise(0)
    return out + F.floor(F.length(F.coalesce(text, F.lit(""))) / F.lit(20)).cast("bigint")


def bounded_quality(c: Column) -> Column:
    return clamp(c, 0, 100)
