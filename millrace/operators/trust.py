"""Back-fills from trusted directories, plans for merging duplicates, repair of over-merged apps.

Each returns its decisions as rows; applying one is a join of the decisions with the table as it is then, which
checks again that the field is still open (merge.fill_empty, relational.guarded_transition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, first_other_paragraph, is_under, slugify
from .relational import any_of, having_any, having_none

#: What the text of a listing says about its launch status.
LAUNCH_PATTERNS = (("beta", r"\bin beta\b|\bpublic beta\b"), ("waitlist", r"\bwaitlist\b"))


def trusted(apps: DataFrame, sources: DataFrame, links: DataFrame, directories: dict[str, dict[str, str]], skip: DataFrame | None = None) -> DataFrame:
    """(app_id, source_types, directory_urls) of apps with an active source of a trusted type and a link below that
    type's directory. directories: host and path prefix by source type; skip: apps to leave out.

    Sources and links are cut to the few types and addresses before they meet."""
    own = sources.where(F.col("is_active") & F.col("source_type").isin(*directories)).select("app_id", "source_type").distinct()
    fits = any_of([(F.col("source_type") == kind) & is_under(F.col("official_directory_url"), hosts) for kind, hosts in directories.items()])
    met = own.join(links.where(F.col("official_directory_url") != "").select("app_id", "official_directory_url"), "app_id").where(fits)
    by = met.groupBy("app_id").agg(F.array_sort(F.collect_set("source_type")).alias("source_types"), F.array_sort(F.collect_set("official_directory_url")).alias("directory_urls"))
    by = having_any(by, apps.select("app_id"), "app_id")
    return by if skip is None else having_none(by, skip.select("app_id"), "app_id")


def verification_backfill(found: DataFrame, apps: DataFrame) -> DataFrame:
    """Trusted apps whose verification is unknown become official."""
    return found.join(apps.where(F.col("verification") == "unknown").select("app_id"), "app_id").withColumn("planned", F.lit("official"))


def capability_backfill(found: DataFrame, known: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(app_id, capability, action): a default is planned unless yes or no stands there; a different one is skipped."""
    rows = F.array(*(F.struct(F.lit(k).alias("capability"), F.lit(v).alias("target")) for k, v in defaults.items()))
    each = found.select("app_id", F.inline(rows)).join(known.where(F.col("value").isin("yes", "no")), ["app_id", "capability"], "left")
    action = F.when(F.col("value").isNull(), "plan").when(F.col("value") != F.col("target"), "skip")
    return each.withColumn("action", action).where("action is not null").select("app_id", "capability", "target", "action")


def category_backfill(found: DataFrame, raw: DataFrame, existing: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(app_id, planned): categories that raw labels (app_id, label) map to and the app lacks, sorted."""
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    slugs = having_any(raw, found, "app_id").select("app_id", F.try_element_at(names, F.lower(collapsed(F.col("label")))).alias("category"))
    new = having_none(slugs.where("category is not null"), existing, ["app_id", "category"])
    return new.groupBy("app_id").agg(F.array_sort(F.collect_set("category")).alias("planned"))


def description_backfill(found: DataFrame, apps: DataFrame, at_least: int = 60) -> DataFrame:
    """(app_id, planned): a sentence of the long description for apps whose short one is too short."""
    own = having_any(apps, found, "app_id").where(F.length(F.trim(F.coalesce("short_description", F.lit("")))) < at_least)
    planned = first_other_paragraph(F.col("long_description"), F.trim("short_description"), at_least)
    return own.select("app_id", planned.alias("planned")).where("planned is not null")


def launch_from_text(text: Column) -> Column:
    out = F.lit("live")
    for status, pattern in reversed(LAUNCH_PATTERNS):
        out = F.when(F.lower(text).rlike(pattern), F.lit(status)).otherwise(out)
    return out


def launch_backfill(found: DataFrame, apps: DataFrame) -> DataFrame:
    own = having_any(apps, found, "app_id").withColumn("planned", launch_from_text(F.col("long_description")))
    return own.where(F.col("planned") != F.col("launch_status")).select("app_id", F.col("launch_status").alias("current"), "planned")


def taxonomy_repair(found: DataFrame, types: DataFrame, wrong: tuple[str, ...], beside: tuple[str, ...]) -> DataFrame:
    """(app_id, planned_remove): types of `wrong` on trusted apps that have one of `beside` too."""
    sets = having_any(types, found, "app_id").groupBy("app_id").agg(F.collect_set("listing_type").alias("t"))
    lists = [F.array(*map(F.lit, x)) for x in (wrong, beside)]
    bad = F.array_sort(F.array_intersect("t", lists[0]))
    return sets.where(F.arrays_overlap("t", lists[1]) & (F.size(bad) > 0)).select("app_id", bad.alias("planned_remove"))


def merge_plan(pairs: DataFrame, apps: DataFrame, capabilities: DataFrame, mergeable: tuple[str, ...]) -> DataFrame:
    """pairs (pair_id, a, b, reason, status) with blockers and would_merge. apps: app_id, name, status, guarded.

    Related pending pairs are counted by app in one aggregation, and capabilities meet on (pair, capability)."""
    side = lambda k: apps.select(F.col("app_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("name", "status", "guarded")))
    pending = pairs.where(F.col("status") == "pending").select("pair_id", F.explode(F.array("a", "b")).alias("app_id"))
    crowded = pending.groupBy("app_id").agg(F.count("*").alias("n"))
    load = lambda k: crowded.select(F.col("app_id").alias(k), F.col("n").alias(f"n_{k}"))
    known = capabilities.where(F.col("value") != "unknown")
    left = pairs.select("pair_id", "a", "b").join(known.select(F.col("app_id").alias("a"), "capability", F.col("value").alias("va")), "a")
    clash = left.join(known.select(F.col("app_id").alias("b"), "capability", F.col("value").alias("vb")), ["b", "capability"]).where("va <> vb")
    clash = clash.groupBy("pair_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("capability_conflict:"), F.col("capability").cast("string")))).alias("clash"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").join(load("a"), "a", "left").join(load("b"), "b", "left").join(clash, "pair_id", "left")
    own = F.when(F.col("status") == "pending", 1).otherwise(0)
    rules = [
        (F.col("status") != "pending", F.lit("duplicate_not_pending")),
        (~F.col("reason").isin(*mergeable), F.concat(F.lit("unsupported_match_reason:"), "reason")),
        (slugify(F.col("name_a")) != slugify(F.col("name_b")), F.lit("name_not_exact_match")),
        ((F.col("status_a") != "draft") | (F.col("status_b") != "draft"), F.lit("requires_two_drafts")),
        (F.col("guarded_a") | F.col("guarded_b"), F.lit("guarded_identity")),
        ((F.coalesce("n_a", F.lit(0)) > own) | (F.coalesce("n_b", F.lit(0)) > own), F.lit("related_pending_duplicates")),
    ]
    blockers = F.concat(F.array_compact(F.array(*(F.when(c, code) for c, code in rules))), F.coalesce("clash", F.array().cast("array<string>")))
    return both.select("pair_id", "a", "b", blockers.alias("blockers")).withColumn("would_merge", F.size("blockers") == 0)


def split_plan(sources: DataFrame, source_type: str) -> DataFrame:
    """(app_id, source_id, keeps) of apps that hold several sources of a type: the first stays, the others get an app of
    their own."""
    own = sources.where(F.col("source_type") == source_type)
    several = own.groupBy("app_id").agg(F.count("*").alias("n"), F.min("source_id").alias("first")).where("n > 1")
    return own.join(several, "app_id").select("app_id", "source_id", (F.col("source_id") == F.col("first")).alias("keeps"))


def attributed(clicks: DataFrame, links: DataFrame) -> DataFrame:
    """clicks (app_id, link_type, url) with valid: the url is one of the app's for that type."""
    known = links.select("app_id", "link_type", "url", F.lit(True).alias("_ok")).distinct()
    return clicks.join(known, ["app_id", "link_type", "url"], "left").withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")


def taxonomy(dims: DataFrame, kind: str, slug: str) -> DataFrame:
    """(kind, slugs): the sorted slugs of each kind of a small dimension."""
    return dims.groupBy(kind).agg(F.array_sort(F.collect_set(slug)).alias("slugs"))


#: Columns that no automatic plan may write.
PROTECTED = ("status", "review_status", "platform_verification_status", "claim_status", "editorial_verdict")


def guarded_columns(plan: DataFrame) -> DataFrame:
    """The plan, unless it writes a protected column."""
    bad = sorted(set(plan.columns) & set(PROTECTED))
    if bad:
        raise ValueError(f"a plan may not write {', '.join(bad)}")
    return plan
