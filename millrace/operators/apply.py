"""Applying drafts, plans and drift to the tables as they are now.

A plan may be old when it is applied: each function joins it with the current table and checks again that a field is
still blank, a capability still unknown, a slug not attached. Results are whole new tables for sinks.tables.replace, so
applying a plan twice is applying it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, slugify
from ..functions.values import filled, merged_map
from ..storage import materialise
from .merge import upsert_outcomes
from .relational import first_by, having_none
from .trust import guarded_columns


def upserted(apps: DataFrame, sources: DataFrame, drafts: DataFrame, matches: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(apps, sources, outcomes) after the drafts.

    apps: app_id, verification and the text fields; sources: source_type, external_id, app_id, payload; drafts: draft_id,
    source_type, external_id, payload, verification and fields; matches: draft_id, app_id of soft duplicates. A known
    source fills the blank fields of its app, raises an unknown verification and gets the new payload; a match gets
    the source attached; a new draft makes an app, numbered on from the greatest id in the order of drafts, unless an
    earlier draft of the run has its source. Of several drafts of an app or source the first counts."""
    out = upserted_tables(apps, sources, drafts, matches, fields)
    return out["apps"], out["sources"], out["outcomes"]


def upserted_tables(
    apps: DataFrame,
    sources: DataFrame,
    drafts: DataFrame,
    matches: DataFrame,
    fields: list[str],
    bridges: dict[str, tuple[DataFrame, DataFrame, DataFrame]] | None = None,
    refreshed: tuple[str, ...] = (),
    candidates: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All tables after the drafts, to be published by one commit: apps, sources and outcomes as in upserted, each bridge,
    and candidates if asked for.

    bridges: by name the rows (app_id, slug), what drafts want (draft_id, slug) and the slugs there are; an app that a draft
    makes gets its known slugs, and of the bridges in refreshed so does an app whose source a draft renews. candidates(made,
    apps): duplicates for review of the apps that the run made among all apps after it, the earlier ones of the run too."""
    outcomes = materialise(upsert_outcomes(drafts, sources, matches))
    both = drafts.join(outcomes, "draft_id")
    known = first_by(both.where("outcome = 'updated'"), ["app_id"], F.asc("draft_id"))
    new = first_by(both.where("outcome = 'new'").withColumn("_own", F.when(F.col("external_id") == "", F.col("draft_id"))), ["source_type", "external_id", "_own"], F.asc("draft_id"))
    new = new.drop("_own", "app_id")
    last = apps.agg(F.max("app_id")).first()[0] or 0
    new = materialise(new.join(numbered(new, "draft_id", "_n"), "draft_id").withColumn("app_id", F.col("_n") + last).drop("_n"))
    filling = known.select("app_id", *(F.col(f).alias(f"_new_{f}") for f in fields), F.col("verification").alias("_new_verification"))
    raised = F.when(F.coalesce("verification", F.lit("unknown")) == "unknown", F.coalesce("_new_verification", "verification")).otherwise(F.col("verification"))
    old = apps.join(filling, "app_id", "left").select("app_id", raised.alias("verification"), *(filled(F.col(f), F.col(f"_new_{f}")).alias(f) for f in fields))
    written = first_by(both.where("external_id <> ''"), ["source_type", "external_id"], F.asc("draft_id"))
    payloads = written.select("source_type", "external_id", F.col("payload").alias("_payload"))
    kept = sources.join(payloads, ["source_type", "external_id"], "left").withColumn("payload", F.coalesce("_payload", "payload")).drop("_payload")
    attaching = both.where("outcome = 'skipped'").unionByName(new.select(*both.columns)).where("external_id <> ''")
    attaching = first_by(attaching, ["source_type", "external_id"], F.asc("draft_id")).select(sources.columns)
    whole = kept.unionByName(having_none(attaching, sources, ["source_type", "external_id"]))
    out = {"apps": old.unionByName(new.select(old.columns)), "sources": whole, "outcomes": outcomes}
    made, renewed = new.select("draft_id", "app_id"), outcomes.where("outcome = 'updated'").select("draft_id", "app_id")
    for name, (rows, wanted, dim) in (bridges or {}).items():
        owners = made.unionByName(renewed) if name in refreshed else made
        out[name] = attached(rows, wanted.join(owners, "draft_id"), dim, "app_id", "slug")
    if candidates:
        out["candidates"] = candidates(new.select(old.columns), out["apps"])
    return out


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """(order, name): numbers from 1 in the order of a column without ties. Each range of the order is numbered by itself and
    moved on by the sizes of those before it, so that no task sees all rows."""
    dealt = materialise(df.select(order).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(starts), "_part").select(order, (F.col("_start") + place).alias(name))


def attached(bridge: DataFrame, wanted: DataFrame, dim: DataFrame, owner: str, slug: str) -> DataFrame:
    """bridge (owner, slug) with the wanted rows whose slug the dimension knows; nothing is taken away."""
    known = wanted.join(dim.select(slug).distinct(), slug, "left_semi")
    return bridge.select(owner, slug).unionByName(known.select(owner, slug)).distinct()


def attached_use_cases(bridge: DataFrame, dim: DataFrame, titles: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(bridge, dim) with free titles (owner, place, title) as use cases (slug, title).

    A title that slugs to a known one is that one; of new titles with one slug the first by owner and place names it."""
    each = titles.withColumn("slug", F.coalesce(F.nullif(slugify(F.col("title")), F.lit("")), F.lit("use-case")))
    new = first_by(having_none(each, dim, "slug"), ["slug"], F.asc(owner), F.asc("place"), F.asc("title")).select("slug", "title")
    return bridge.select(owner, "slug").unionByName(each.select(owner, "slug")).distinct(), dim.select("slug", "title").unionByName(new)


def attached_platforms(links: DataFrame, wanted: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """links (keys, fields, metadata) with wanted ones: blank fields are filled, of metadata the existing keys win."""
    new = wanted.select(*keys, *(F.col(f).alias(f"_new_{f}") for f in [*fields, "metadata"]))
    both = links.join(new, keys, "full")
    return both.select(*keys, *(filled(F.col(f), F.col(f"_new_{f}")).alias(f) for f in fields), merged_map(F.col("metadata"), F.col("_new_metadata")).alias("metadata"))


def applied_fields(apps: DataFrame, plan: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(apps, skipped) after a plan (key, field columns; null plans nothing), which may not name a protected column.

    A field that is no longer blank stays, and its planned value is listed in skipped (key, field, planned)."""
    fields = [c for c in guarded_columns(plan).columns if c != key]
    both = apps.join(plan.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields)), key, "left")
    out = both.select(*(filled(F.col(c), F.coalesce(f"_new_{c}", c)).alias(c) if c in fields else F.col(c) for c in apps.columns))
    rows = F.array(*(F.when(~blank(F.col(f"_new_{f}")) & ~blank(F.col(f)) & (F.col(f) != F.col(f"_new_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_new_{f}").alias("planned"))) for f in fields))
    return out, both.select(key, F.inline(F.array_compact(rows)))


def fingerprint(fields: list[str]) -> Column:
    """A digest of fields of a row, nulls and empty texts apart."""
    return F.sha2(F.to_json(F.struct(*(F.col(f).cast("string").alias(f) for f in fields)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def made_from(plan: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """plan with `made_from`: the fingerprint of the fields that it was made from, null where there was no row."""
    return plan.join(current.select(*keys, fingerprint(fields).alias("made_from")), keys, "left")


def applied_if_same(current: DataFrame, plan: DataFrame, keys: list[str], fields: list[str], planned: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(current, skipped) after a plan that made_from has marked. planned: columns of current and the plan's columns that they get.

    Only rows whose fields are still those that the plan was made from are written; a row that was not there when the plan
    was made is added if it is still not there. skipped (keys, reason) lists the rest: changed, gone or appeared."""
    wanted = plan.select(*keys, "made_from", *(F.col(v).alias(f"_to_{c}") for c, v in planned.items()), F.lit(True).alias("_planned"))
    both = current.withColumn("_now", fingerprint(fields)).join(wanted, keys, "full")
    same = F.coalesce("_planned", F.lit(False)) & F.col("made_from").eqNullSafe(F.col("_now"))
    row = [F.when(same, F.col(f"_to_{c}")).otherwise(F.col(c)).alias(c) if c in planned else F.col(c) for c in current.columns]
    reason = F.when(F.col("_now").isNull(), "gone").when(F.col("made_from").isNull(), "appeared").otherwise("changed")
    skipped = both.where(F.coalesce("_planned", F.lit(False)) & ~same).select(*keys, reason.alias("reason"))
    return both.where(F.col("_now").isNotNull() | same).select(*row), skipped


def applied_capabilities(known: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """known (keys, value, note) after a plan of the same columns: only an unknown or missing value is written, with its
    evidence; a planned value other than yes and no writes nothing."""
    new = plan.where(F.col("value").isin("yes", "no")).select(*keys, F.col("value").alias("_value"), F.substring(F.trim("note"), 1, 500).alias("_note"))
    both = known.join(new, keys, "full")
    is_open = F.col("_value").isNotNull() & (F.coalesce("value", F.lit("unknown")) == "unknown")
    return both.select(*keys, F.when(is_open, F.col("_value")).otherwise(F.col("value")).alias("value"), F.when(is_open, F.coalesce(F.nullif(F.col("_note"), F.lit("")), "note")).otherwise(F.col("note")).alias("note"))


def flagged(df: DataFrame, chosen: Column, eligible: Column, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(df, report): the chosen rows that are eligible get the value; the report counts those and the ones skipped."""
    ok = F.coalesce(chosen & eligible, F.lit(False))
    report = df.agg(F.count_if(ok).alias("n_flagged"), F.count_if(F.coalesce(chosen, F.lit(False)) & ~ok).alias("n_skipped"))
    return df.withColumn(column, F.when(ok, F.lit(value)).otherwise(F.col(column))), report


def persisted_drift(diff: DataFrame, sources: DataFrame, key: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(entries, sources) of a drift run over the checked sources (key, source_id, last_enriched_at, payload).

    diff: (key, field, before, after) of what changed. An entry for review only where something did; every checked source
    gets the time of the run and the changes in its payload."""
    change = F.struct("field", "before", "after")
    entries = diff.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(change))).alias("changes"))
    checked = sources.join(entries, key, "left")
    payload = augmented(F.col("payload"), {"drift": F.parse_json(F.coalesce("changes", F.lit("[]")))})
    return entries, checked.select(*(as_of.alias(c) if c == "last_enriched_at" else payload.alias(c) if c == "payload" else F.col(c) for c in sources.columns))


#: The key under which a payload that is no JSON object is kept.
ORIGINAL = "_original"


def augmented(payload: Column, extra: dict[str, Column]) -> Column:
    """A JSON object with further keys; a key that is there already is replaced, in its place in the order the new one comes last.

    All else keeps its type: the object is taken apart at its top level only, into VARIANT values, so numbers, flags,
    nulls and nested values come back equal. Values of extra are texts, numbers, flags or parsed JSON (try_parse_json). A
    payload that is another JSON value, or no JSON, stays whole under ORIGINAL; a null or blank one is an empty object."""
    entries = F.from_json(payload, "map<string,variant>")
    whole = F.create_map(F.lit(ORIGINAL), F.coalesce(F.try_parse_json(payload), payload.cast("variant")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    old = F.coalesce(entries, F.when(~blank(payload), whole), none)
    kept = F.map_filter(old, lambda k, v: ~k.isin(*extra))
    return F.to_json(F.map_concat(kept, F.create_map(*(x for k, v in extra.items() for x in (F.lit(k), v.cast("variant"))))))


def payload_problem(payload: Column) -> Column:
    """Why a payload is kept under ORIGINAL: "not_an_object", "not_json", or null if it is an object or blank."""
    is_object = F.from_json(payload, "map<string,variant>").isNotNull()
    return F.when(~is_object & ~blank(payload), F.when(F.try_parse_json(payload).isNotNull(), "not_an_object").otherwise("not_json"))


def vanished(crossings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, entries) after links that failed too often: crossings (app_id, target, url, consecutive_failures).

    Only active sources with the very url are switched off; each crossing becomes an entry with how many were."""
    dead = crossings.select("app_id", F.col("url").alias("source_url")).distinct().withColumn("_dead", F.lit(True))
    both = sources.join(dead, ["app_id", "source_url"], "left")
    hit = F.coalesce(F.col("_dead") & F.col("is_active"), F.lit(False))
    counts = both.where(hit).groupBy("app_id", F.col("source_url").alias("url")).agg(F.count("*").alias("sources_deactivated"))
    entries = crossings.join(counts, ["app_id", "url"], "left").withColumn("sources_deactivated", F.coalesce("sources_deactivated", F.lit(0)))
    return both.withColumn("is_active", F.col("is_active") & ~hit).select(sources.columns), entries


def resolved_moves(moves: DataFrame) -> DataFrame:
    """(source, target) with every target the last one of its chain, by doubling: a row's target becomes its target's target.

    Of several targets of a source the least counts. Moves that go round in a circle end at its least member, which stays; so
    do chains into it. Rounds are at most as many as the number of moves has binary digits, each a join by key of moves
    with moves, and end when all chains have. The joins shuffle: broadcast, the moves would go through the driver once a round."""
    least = moves.where("source is not null and target is not null and source <> target").groupBy("source").agg(F.min("target").alias("target"))
    step = materialise(least.select("source", "target", F.least("source", "target").alias("least")))
    for _ in range(max(1, step.count()).bit_length()):
        to = step.select(F.col("source").alias("target"), F.col("target").alias("_next"), F.col("least").alias("_least"))
        both = materialise(step.join(to.hint("merge"), "target", "left"))
        if not both.where("_next is not null").limit(1).count():
            return both.select("source", "target")
        step = materialise(both.select("source", F.coalesce("_next", "target").alias("target"), F.least("least", F.coalesce("_least", "least")).alias("least")))
    # what still goes on after as many steps as there are moves goes in circles; the place that is reached has met its whole circle
    to = step.select(F.col("source").alias("target"), F.col("least").alias("_circle"))
    both = step.join(to.hint("merge"), "target", "left").select("source", F.coalesce("_circle", "target").alias("target"))
    return both.where("source <> target")


def repointed_all(relations: dict[str, tuple[DataFrame, list[str]]], moves: DataFrame, owner: str = "app_id") -> dict[str, DataFrame]:
    """Each relation with its owners moved by moves (source, target), one row for each owner and its other keys.

    relations: name to (rows, keys beside the owner). Of rows that meet, the target's own row wins, then the one of the
    least source and of the least other values. Chained moves go through resolved_moves first. The table of moves is small
    beside relations and joins by its size."""
    to = moves.select(F.col("source").alias(owner), F.col("target").alias("_target"))
    out = {}
    for name, (rows, keys) in relations.items():
        rest = [c for c in rows.columns if c not in (owner, *keys)]
        moved = rows.join(to, owner, "left").withColumn("_was", F.when(F.col("_target").isNotNull(), F.col(owner)))
        moved = moved.withColumn(owner, F.coalesce("_target", owner))
        out[name] = first_by(moved, [owner, *keys], F.asc_nulls_first("_was"), *(F.asc(c) for c in rest)).select(rows.columns)
    return out


def merged_apps(apps: DataFrame, moves: DataFrame, fields: list[str], key: str = "app_id") -> DataFrame:
    """apps without the merged sources; blank fields of a target take the value of its least source that has one."""
    to = moves.select(F.col("source").alias(key), "target")
    given = apps.join(to, key).groupBy("target").agg(*(F.min_by(f, F.when(~blank(F.col(f)), F.col(key))).alias(f"_new_{f}") for f in fields))
    kept = having_none(apps, to, key).join(given.withColumnRenamed("target", key), key, "left")
    return kept.select(*(filled(F.col(c), F.coalesce(f"_new_{c}", c)).alias(c) if c in fields else F.col(c) for c in apps.columns))


def proposal_drafts(proposals: DataFrame, platforms: dict[str, str], source_type: str) -> DataFrame:
    """Drafts out of model proposals (name, short_description, listing_types, proposed_verdict, scope_summary, payload).

    Platforms follow from listing types, once each in their order; the verdict falls back to the scope summary; both are
    kept in the payload, never in a column that is published."""
    names = F.create_map(*(F.lit(x) for pair in platforms.items() for x in pair))
    derived = F.array_distinct(F.array_compact(F.transform("listing_types", lambda x: F.try_element_at(names, x))))
    scope = F.trim(F.coalesce("scope_summary", F.lit("")))
    verdict = F.coalesce(F.nullif(F.trim(F.coalesce("proposed_verdict", F.lit(""))), F.lit("")), scope)
    rest = [c for c in proposals.columns if c not in ("short_description", "payload", "proposed_verdict", "scope_summary")]
    return proposals.select(
        *rest,
        F.lit(source_type).alias("source_type"),
        F.substring("short_description", 1, 280).alias("short_description"),
        derived.alias("platforms"),
        augmented(F.col("payload"), {"proposed_verdict": verdict, "scope_summary": scope}).alias("payload"),
    )


#: Transports that a payload may name, the preferred first.
TRANSPORTS = ("stdio", "sse", "http", "websocket")


def payload_backfill(sources: DataFrame, apps: DataFrame, base_url: str) -> DataFrame:
    """(app_id, official_directory_url, metadata, verification) out of the stored payload of each app's first source
    (app_id, source_id, external_id, payload). apps: app_id, verification, review; a verification is raised to official only if no
    one has reviewed or verified. Running it again gives the same rows."""
    first = first_by(sources, ["app_id"], F.asc("source_id"))
    said = lambda path: F.get_json_object("payload", path)
    picked = F.coalesce(*(F.when(~F.coalesce(said(f"$.transports.{t}"), F.lit("")).isin("", "false", "0", "{}", "[]"), F.lit(t)) for t in TRANSPORTS))
    fields = {"protocol_version": said("$.protocol_version"), "transport": picked, "repository_url": said("$.repository.url"), "install_command": said("$.install.command"), "required_env_vars": said("$.install.env")}
    metadata = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    url = F.when((F.col("external_id") == "") | (F.lit(base_url) == ""), "").otherwise(F.concat(F.lit(base_url.rstrip("/") + "/servers/"), "external_id"))
    is_open = (F.col("review") == "unreviewed") & F.col("verification").isin("not_listed", "unknown")
    own = apps.select("app_id", F.when(is_open, "official").otherwise(F.col("verification")).alias("verification"))
    return first.join(own, "app_id").select("app_id", url.alias("official_directory_url"), metadata.alias("metadata"), "verification")
