"""Merging records without overwriting, drift, validation of proposals, upsert outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, collapsed, is_http_url
from ..functions.values import filled

CONFIDENCE = 0.7


def long_fields(df: DataFrame, key: str, fields: list[str], value: str) -> DataFrame:
    """(key, field, value): text fields as rows, by one projection."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields))
    return df.select(key, F.inline(rows))


def fill_empty(current: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with its blank fields filled from proposed; nothing is overwritten."""
    other = proposed.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    both = current.join(other, key, "left")
    return both.select(*(filled(F.col(c), F.col(f"_new_{c}")).alias(c) if c in fields else F.col(c) for c in current.columns))


def merge_actions(current: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, current, proposed, action): fill a blank field, review a different one; equal and blank proposals are none."""
    both = current.select(key, *fields).join(proposed.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields)), key)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("current"), F.col(f"_new_{f}").cast("string").alias("proposed")) for f in fields))
    each = both.select(key, F.inline(rows)).where(~blank(F.col("proposed")))
    action = F.when(blank(F.col("current")), F.lit("fill")).when(collapsed(F.col("current")) != collapsed(F.col("proposed")), F.lit("review"))
    return each.withColumn("action", action).where("action is not null")


def capability_actions(current: Column, proposed: Column) -> Column:
    """Only an unknown value is written; a yes against a no goes to review."""
    known = proposed.isin("yes", "no")
    return F.when(known & (F.coalesce(current, F.lit("unknown")) == "unknown"), F.lit("fill")).when(known & (current != proposed), F.lit("review"))


def drift(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of fields that changed; a missing side counts as null."""
    a, b = long_fields(before, key, fields, "before"), long_fields(after, key, fields, "after")
    return a.join(b, [key, "field"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def validated(proposals: DataFrame, allowed: DataFrame, floor: float = CONFIDENCE) -> DataFrame:
    """proposals (field, value, evidence, confidence) with `dropped`: why one is dropped, or null.

    allowed: (field, value) of closed vocabularies, a small dimension; fields ending in _url need an http address."""
    closed = allowed.select("field", "value", F.lit(True).alias("_known")).distinct()
    fields = allowed.select("field").distinct().withColumn("_closed", F.lit(True))
    both = proposals.join(closed, ["field", "value"], "left").join(fields, "field", "left")
    why = (
        F.when(F.col("confidence") < floor, F.lit("low_confidence"))
        .when(blank(F.col("evidence")), F.lit("no_evidence"))
        .when(F.col("_closed") & F.col("_known").isNull(), F.lit("unknown_value"))
        .when(F.col("field").endswith("_url") & ~is_http_url(F.col("value")), F.lit("bad_url"))
    )
    return both.withColumn("dropped", why).drop("_known", "_closed")


def upsert_outcomes(drafts: DataFrame, sources: DataFrame, matches: DataFrame, draft: str = "draft_id") -> DataFrame:
    """(draft, outcome, app_id): updated if the source's key is known, skipped if it matches an app, else new."""
    known = sources.where("external_id <> ''").select("source_type", "external_id", F.col("app_id").alias("_known"))
    both = drafts.join(known, ["source_type", "external_id"], "left").join(matches.select(draft, F.col("app_id").alias("_match")), draft, "left")
    outcome = F.when(F.col("_known").isNotNull(), "updated").when(F.col("_match").isNotNull(), "skipped").otherwise("new")
    return both.select(draft, outcome.alias("outcome"), F.coalesce("_known", "_match").alias("app_id"))
