"""Registry pages and feeds as landed JSON: normalised drafts and a dead-letter table.

Pages are landed as text rows (one JSON document each) by whatever fetches them; reading them is one scan, and
a broken record costs itself only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..functions.values import first_true

#: The fields of a registry record that a draft needs.
SERVER = (
    "struct<id:string,name:string,title:string,description:string,version:string,websiteUrl:string,"
    "repository:struct<url:string,source:string>,publisher:struct<name:string,url:string>,"
    "remotes:array<struct<type:string,transport_type:string,url:string>>,"
    "packages:array<struct<registryType:string,registry_name:string,identifier:string,name:string,transport:struct<type:string>>>>"
)
FEED = (
    "struct<id:string,fullName:string,extensionName:string,extensionDescription:string,repoDescription:string,url:string,stars:bigint,"
    "hasMCP:boolean,hasContext:boolean,hasHooks:boolean,hasSkills:boolean,hasCustomCommands:boolean>"
)
FEED_FLAGS = {"mcp": "hasMCP", "context": "hasContext", "hooks": "hasHooks", "skills": "hasSkills", "commands": "hasCustomCommands"}


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one JSON document each: (path, raw)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def records(pages: DataFrame, lists: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """pages with place (from 1) and record, the JSON text of each element of the first list that a page has."""
    whole = F.coalesce(*(F.from_json(F.get_json_object(F.col(raw), path), "array<string>") for path in lists))
    return pages.select(*(c for c in pages.columns if c != raw), F.posexplode(whole).alias("place", "record")).withColumn("place", F.col("place") + 1)


def next_cursor(raw: Column) -> Column:
    """The cursor of the following page; none where the first that is set is no text."""
    page = F.try_parse_json(raw)
    paths = ("$.next_cursor", "$.metadata.nextCursor")
    unset = [F.coalesce(F.get_json_object(raw, p), F.lit("")).isin("", "0", "false") for p in paths]
    texts = [F.when(F.schema_of_variant(F.try_variant_get(page, p, "variant")) == "STRING", F.get_json_object(raw, p)) for p in paths]
    return F.nullif(F.when(~unset[0], texts[0]).otherwise(texts[1]), F.lit(""))


def registry_drafts(each: DataFrame, source_type: str = "registry") -> DataFrame:
    """Records as drafts with error: null for a good record, else why it is a dead letter. Nothing is lost."""
    inner = F.coalesce(F.get_json_object("record", "$.server"), F.col("record"))
    s = F.col("s")
    # behind a generator a record is parsed once, and not again for each field
    named = each.select("*", F.explode(F.array(F.from_json(inner, SERVER, {"mode": "PERMISSIVE"}))).alias("s"))
    kind = lambda x: F.coalesce(x["type"], x["transport_type"])
    remote = F.try_element_at(F.filter(s["remotes"], lambda x: x["url"].isNotNull()), F.lit(1))
    package = F.try_element_at(s["packages"], F.lit(1))
    name = collapsed(first_true(F.array(s["title"], s["name"], s["id"])))
    transports = F.array_union(
        F.coalesce(F.transform(s["remotes"], kind), F.array().cast("array<string>")),
        F.coalesce(F.transform(s["packages"], lambda p: p["transport"]["type"]), F.array().cast("array<string>")),
    )
    error = F.when(~F.coalesce(F.ltrim("record").startswith("{"), F.lit(False)), F.lit("not an object")).when(s.isNull(), F.lit("not readable")).when(
        first_true(F.array(s["name"], s["id"])).isNull(), F.lit("no name")
    )
    return named.select(
        *(c for c in each.columns if c != "record"),
        "record",
        error.alias("error"),
        F.substring(name, 1, 200).alias("name"),
        F.lit(source_type).alias("source_type"),
        first_true(F.array(s["id"], s["name"])).alias("external_id"),
        F.substring(collapsed(F.coalesce(s["description"], F.lit(""))), 1, 280).alias("short_description"),
        F.coalesce(s["publisher"]["name"], F.lit("")).alias("developer_name"),
        F.coalesce(s["publisher"]["url"], F.lit("")).alias("developer_url"),
        F.coalesce(first_true(F.array(s["websiteUrl"], remote["url"])), F.lit("")).alias("official_page_url"),
        F.coalesce(s["repository"]["url"], F.lit("")).alias("repo_url"),
        F.coalesce(first_true(F.array(package["identifier"], package["name"])), F.lit("")).alias("install_url"),
        F.array_sort(F.array_distinct(F.array_compact(transports))).alias("transports"),
        F.create_map(
            F.lit("remote"), F.when(remote.isNotNull(), "yes").otherwise("unknown"), F.lit("local"), F.when(package.isNotNull(), "yes").otherwise("unknown")
        ).alias("capabilities"),
    )


def feed_drafts(each: DataFrame, source_type: str = "feed") -> DataFrame:
    """Feed entries as drafts: owner and repository from the full name, flags as a map of yes and no with evidence."""
    s = F.col("s")
    named = each.select("*", F.explode(F.array(F.from_json("record", FEED, {"mode": "PERMISSIVE"}))).alias("s"))
    owner = F.element_at(F.split(s["fullName"], "/"), 1)
    keys = F.array(*map(F.lit, FEED_FLAGS))
    values = F.array(*(F.when(s[f], "yes").otherwise("no") for f in FEED_FLAGS.values()))
    evidence = F.array(*(F.concat(F.lit(f + "="), F.coalesce(s[f].cast("string"), F.lit("absent"))) for f in FEED_FLAGS.values()))
    error = F.when(s.isNull() | first_true(F.array(s["extensionName"], s["fullName"])).isNull(), F.lit("no name"))
    return named.select(
        *(c for c in each.columns if c != "record"),
        "record",
        error.alias("error"),
        collapsed(first_true(F.array(s["extensionName"], s["fullName"]))).alias("name"),
        F.lit(source_type).alias("source_type"),
        F.coalesce(s["id"], F.lower(s["fullName"])).alias("external_id"),
        F.substring(collapsed(F.coalesce(first_true(F.array(s["extensionDescription"], s["repoDescription"])), F.lit(""))), 1, 280).alias("short_description"),
        F.coalesce(owner, F.lit("")).alias("developer_name"),
        F.coalesce(F.concat(F.lit("https://github.com/"), owner), F.lit("")).alias("developer_url"),
        F.coalesce(s["url"], F.lit("")).alias("repo_url"),
        F.map_from_arrays(keys, values).alias("capabilities"),
        F.map_from_arrays(keys, evidence).alias("capability_evidence"),
    )


def split(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good drafts, and dead letters (the record and its error). Both read the same landed files."""
    good = drafts.where("error is null").drop("error")
    return good, drafts.where("error is not null").select(*(c for c in ("path", "place") if c in drafts.columns), "record", "error")


def failure_alert(drafts: DataFrame, share: float = 0.1) -> DataFrame:
    """One row: records, failures, and whether failures reach the share."""
    counts = drafts.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return counts.withColumn("alert", (F.col("n") > 0) & (F.col("n_failed") >= F.col("n") * share))
