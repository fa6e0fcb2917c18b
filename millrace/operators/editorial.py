"""Lists of posts by time, tag and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import having_any, optional_filters, top, top_by


def visible(posts: DataFrame, now: Column) -> DataFrame:
    """Posts that are published and whose time has come."""
    return posts.where((F.col("status") == "published") & (F.col("published_at") <= now))


def listed(posts: DataFrame, tags: DataFrame, now: Column, tag: str | None = None, kind: str | None = None) -> DataFrame:
    """Visible posts, of a tag and of a type if they are given. tags: post_id, tag."""
    out = optional_filters(visible(posts, now), post_type=kind)
    return having_any(out, tags.where(F.col("tag") == tag).select("post_id"), "post_id") if tag else out


def featured(posts: DataFrame, now: Column, n: int = 5) -> DataFrame:
    """Published posts whose time as featured lasts, the newest first (a top-n report)."""
    return top(posts.where((F.col("status") == "published") & (F.col("featured_until") > now)), n, F.desc("published_at"), F.asc("post_id"))


def related(posts: DataFrame, now: Column, n: int = 3) -> DataFrame:
    """(post_id, other, rank): for each visible post the newest n others of its type (a top-n report). The newest n + 1 of a
    type hold those of each of its posts."""
    own = visible(posts, now)
    best = top_by(own.select("post_type", "post_id", "published_at"), ["post_type"], n + 1, F.desc("published_at"), F.asc("post_id"), rank="_r")
    pairs = own.select("post_type", "post_id").join(best.select("post_type", F.col("post_id").alias("other"), "_r"), "post_type").where("post_id <> other")
    return top_by(pairs, ["post_id"], n, F.asc("_r")).select("post_id", "other", "rank")


def popular_tags(posts: DataFrame, tags: DataFrame, n: int = 10) -> DataFrame:
    """(tag, n_posts): the tags of most published posts (a top-n report)."""
    used = having_any(tags.select("post_id", "tag").distinct(), posts.where(F.col("status") == "published").select("post_id"), "post_id")
    return top(used.groupBy("tag").agg(F.count("*").alias("n_posts")), n, F.desc("n_posts"), F.asc("tag"))
