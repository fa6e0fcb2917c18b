"""Decisions about a record as lists of failed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..functions.values import named_failures


def decided(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with blockers (codes of the rules that hold) and allowed (none does)."""
    out = df.withColumn("blockers", named_failures(rules))
    return out.withColumn("allowed", F.size("blockers") == 0)


def blocker_counts(decisions: DataFrame) -> DataFrame:
    """How many records each blocker stops."""
    return decisions.select(F.explode("blockers").alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


def decision_report(decisions: DataFrame, would: str) -> DataFrame:
    """One row: how many were evaluated and how many pass."""
    return decisions.agg(F.count("*").alias("evaluated"), F.count_if("allowed").alias(would))


def publish_rules() -> list[tuple[str, Column]]:
    """What a record lacks before it can be published."""
    short, long = F.length(F.trim(F.coalesce("short_description", F.lit("")))), F.length(F.trim(F.coalesce("long_description", F.lit(""))))
    compact = (short >= 20) & (long >= 60)
    return [
        ("name_missing", blank(F.col("name"))),
        ("short_description_too_short", (short < 60) & ~compact),
        ("no_platform", F.coalesce("n_platforms", F.lit(0)) == 0),
        ("no_category", F.coalesce("n_categories", F.lit(0)) == 0),
        ("few_capabilities", F.coalesce("n_capabilities", F.lit(0)) < F.when(compact, 2).otherwise(3)),
        ("no_link", blank(F.col("official_page_url")) & blank(F.col("install_url"))),
        ("developer_unknown", blank(F.col("developer_name"))),
    ]


def autopublish_rules(include_registry: bool = False) -> list[tuple[str, Column]]:
    """What keeps a reviewed record from being published by itself, over a record joined with its counts.

    Columns: has_registry_source, on_registry_platform, is_registry_type, trusted, short_description, long_description,
    n_types, n_platforms, n_categories, n_capabilities (explicit ones), official_page_url, install_url, verification,
    has_directory_url, launch_status, n_failing_links, n_pending_duplicates. Trusted records may say less."""
    short, long = F.length(F.coalesce("short_description", F.lit(""))), F.length(F.coalesce("long_description", F.lit("")))
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    few = lambda least: F.coalesce("n_capabilities", F.lit(0)) < least
    registry = [] if include_registry else [
        ("mcp_source_requires_include_mcp", F.col("has_registry_source")),
        ("mcp_platform_requires_include_mcp", F.col("on_registry_platform")),
        ("mcp_listing_type_requires_include_mcp", F.col("is_registry_type")),
    ]
    return [
        *registry,
        ("short_description_lt_20", F.col("trusted") & (short < 20)),
        ("long_description_lt_60", F.col("trusted") & (short < 60) & (long < 60)),
        ("short_description_lt_60", ~F.col("trusted") & (short < 60)),
        ("long_description_required", blank(F.col("long_description"))),
        ("listing_type_required", none("n_types")),
        ("platform_required", none("n_platforms")),
        ("category_required", none("n_categories")),
        ("explicit_capabilities_lt_2", F.col("trusted") & few(2)),
        ("explicit_capabilities_lt_3", ~F.col("trusted") & few(3)),
        ("official_or_install_url_required", blank(F.col("official_page_url")) & blank(F.col("install_url"))),
        ("platform_verification_unknown", F.col("verification") == "unknown"),
        ("official_directory_url_required", (F.col("verification") == "official") & ~F.col("has_directory_url")),
        ("deprecated_launch_status", F.col("launch_status") == "deprecated"),
        ("link_health_failures", ~none("n_failing_links")),
        ("pending_duplicate_candidate", ~none("n_pending_duplicates")),
    ]


def review_plans(entries: DataFrame, apps: DataFrame, launch: tuple[str, ...], pricing: tuple[str, ...], informative: Column) -> DataFrame:
    """(app_id, blockers, verdict, pricing_model): what the open entries of an app would write, and what speaks against it.

    entries: app_id, entry_id, kind, skipped (whether an update was skipped), proposed verdict, launch_status and
    pricing_model; apps: app_id and the current values of those. Entries count in the order of their ids: the first
    informative verdict and the first price are planned, later different ones are conflicts. Blockers are sorted."""
    own = apps.select("app_id", *(F.col(c).alias(f"_{c}") for c in ("verdict", "launch_status", "pricing_model")))
    both = entries.join(own, "app_id").withColumn("verdict", F.trim(F.coalesce("verdict", F.lit(""))))
    read, price = F.col("kind") == "enriched", F.coalesce("pricing_model", F.lit(""))
    no_verdict = blank(F.col("_verdict"))
    fits = price.isin(*pricing) & (price != F.col("_pricing_model")) & (F.col("_pricing_model") == "unknown")
    whole = Window.partitionBy("app_id")
    first = lambda when, value: F.min(F.when(read & when, F.struct("entry_id", value.alias("v")))).over(whole)
    both = both.withColumn("_v", first(no_verdict & (F.col("verdict") != "") & informative, F.col("verdict"))).withColumn("_p", first(fits, price))
    later = lambda c: F.col("entry_id") > F.col(f"{c}.entry_id")
    status = F.coalesce("launch_status", F.lit(""))
    found = named_failures(
        [
            ("review_has_skipped_updates", read & F.col("skipped")),
            ("review_would_overwrite_verdict", read & ~no_verdict & (F.col("verdict") != "") & (F.col("verdict") != F.col("_verdict"))),
            ("review_conflicting_verdict", read & no_verdict & (F.col("verdict") != "") & later("_v") & (F.col("verdict") != F.col("_v.v"))),
            ("invalid_launch_status", read & (status != "") & ~status.isin(*launch)),
            ("review_proposes_deprecated", read & (status == "deprecated")),
            ("review_would_change_launch_status", read & status.isin(*launch) & (status != "deprecated") & (status != F.col("_launch_status"))),
            ("invalid_pricing_model", read & (price != "") & ~price.isin(*pricing)),
            ("review_would_overwrite_pricing_model", read & price.isin(*pricing) & (price != F.col("_pricing_model")) & (F.col("_pricing_model") != "unknown")),
            ("review_conflicting_pricing_model", read & fits & later("_p") & (price != F.col("_p.v"))),
        ]
    )
    each = both.withColumn("_b", F.concat(found, F.array_compact(F.array(F.when(~read, F.concat(F.lit("unsafe_review_kind:"), "kind"))))))
    out = each.groupBy("app_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_b")))).alias("blockers"), F.first("_v.v").alias("verdict"), F.first("_p.v").alias("pricing_model"))
    return out.select("app_id", "blockers", F.substring("verdict", 1, 280).alias("verdict"), "pricing_model")


def badges(verification: Column, review: Column, claim: Column) -> Column:
    """Names of the trust badges of a record, in order."""
    return named_failures([("official", verification == "official"), ("reviewed", review == "reviewed"), ("claimed", claim == "claimed")])


def conflicting(proposals: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """(key, field, values) for which several values are proposed."""
    sets = proposals.groupBy(key, field).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return sets.where(F.size("values") > 1)
