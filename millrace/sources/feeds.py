"""RSS, Atom, code-host searches, README files and seed fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped_html
from ..functions.values import first_true

RSS = "struct<title:string,link:string,guid:string,description:string,pubDate:string>"


#: What is read of an item or entry, in this order.
_PATHS = ("/*/title", "/item/link", "/entry/link/@href", "/item/guid", "/entry/id", "/item/description", "/entry/summary", "/item/pubDate", "/entry/published", "/entry/updated")
_BREAK = "\u0001"  # no XML text may hold it


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """RSS 2.0 items and Atom entries: title, url, summary, published, external_id. Items without a url are left out.

    An item is parsed once: one path gives all its texts, each that of the first element found."""
    column = F.col(xml)
    parts = {
        tag: F.regexp_extract_all(column, F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), 0)
        for tag in ("item", "entry")
    }
    each = feeds.select(*(c for c in feeds.columns if c != xml), F.posexplode(F.concat(parts["item"], parts["entry"])).alias("place", "item"))
    # prefixes that an item does not declare itself would stop the parser
    item = F.regexp_replace("item", r"(</?|\s)[A-Za-z]+:", "$1")
    texts = F.split(F.xpath_string(item, F.lit(f"concat({f", '{_BREAK}', ".join(_PATHS)})")), _BREAK)
    # a row of its own, as the filter on url would parse again otherwise
    each = each.select(*(c for c in each.columns if c != "item"), F.explode(F.array(texts)).alias("_texts"))
    text = lambda path: F.nullif(F.trim(F.col("_texts")[_PATHS.index(path)]), F.lit(""))
    url = first_true(F.array(text("/item/link"), text("/entry/link/@href"), text("/item/guid"), text("/entry/id")))
    out = each.select(
        *(c for c in each.columns if c != "_texts"),
        F.coalesce(text("/*/title"), F.lit("")).alias("title"),
        url.alias("url"),
        stripped_html(F.coalesce(first_true(F.array(text("/item/description"), text("/entry/summary"))), F.lit(""))).alias("summary"),
        first_true(F.array(text("/item/pubDate"), text("/entry/published"), text("/entry/updated"))).alias("published"),
    )
    return out.where("url is not null").withColumn("external_id", F.concat(F.lit("rss:"), F.col("url")))


def search_candidates(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Items of code-host search answers with a name and a url."""
    items = F.from_json(F.col(raw), "struct<items:array<struct<full_name:string,html_url:string,description:string,stargazers_count:bigint>>>")["items"]
    each = pages.select(F.explode(items).alias("i")).select("i.*").where("coalesce(full_name, '') <> '' and coalesce(html_url, '') <> ''")
    return each.withColumn("external_id", F.lower("full_name"))


def candidate_drafts(candidates: DataFrame, source_type: str = "code_search") -> DataFrame:
    """Candidates as minimal drafts: the repository's name in title case."""
    name = F.initcap(F.translate(F.element_at(F.split("full_name", "/"), -1), "-_", "  "))
    return candidates.select(name.alias("name"), F.lit(source_type).alias("source_type"), "external_id", F.col("html_url").alias("repo_url"), F.substring(F.coalesce("description", F.lit("")), 1, 280).alias("short_description"))


def readme_text(content, at_most: int = 12_000):
    """The text of a base64 file body; what is no UTF-8 becomes the replacement character."""
    return F.substring(F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8"), 1, at_most)


def seed_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Files with a JSON array of {model, pk, fields} each."""
    return fixture_rows(spark.read.text(path, wholetext=True))


def fixture_rows(raw: DataFrame) -> DataFrame:
    """Rows (model, pk, fields) of texts (value) with a JSON array of them, with fields as a map of texts."""
    rows = raw.select(F.explode(F.from_json("value", "array<struct<model:string,pk:bigint,fields:map<string,string>>>")).alias("r"))
    return rows.select("r.*")
