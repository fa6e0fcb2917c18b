"""Directories of apps as landed HTML pages: cards, details and embedded JSON to drafts.

A page is parsed where it is read, one Arrow batch at a time; a page's cards stay rows of the JVM afterwards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.text import collapsed, developer_named, first_address, label_list
from ..functions.values import first_true, merged_map
from ..operators.relational import first_by

CARDS = "array<struct<name:string,summary:string,detail_url:string>>"
DETAIL = "struct<title:string,info:map<string,string>,paragraphs:array<string>>"


class _Page(HTMLParser):
    """Links with their texts, definition pairs, paragraphs and JSON of scripts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.pairs: dict[str, str] = {}
        self.scripts: list[str] = []
        self.paragraphs: list[str] = []
        self.title, self._open, self._label = "", "", ""

    def handle_starttag(self, tag, attrs):
        said = dict(attrs)
        if tag == "a":
            self.links.append({"name": "", "href": said.get("href") or "", "summary": said.get("data-description") or ""})
        if tag in ("a", "script", "title", "dt", "th", "dd", "td", "h1", "p"):
            self._open = tag
            if tag == "p":
                self.paragraphs.append("")
            if tag == "script":
                self.scripts.append("" if "json" in (said.get("type") or "") else "-")

    def handle_endtag(self, tag):
        if tag == self._open:
            self._open = ""

    def handle_data(self, data):
        if self._open == "a":
            self.links[-1]["name"] += data
        elif self._open == "script" and self.scripts[-1] != "-":
            self.scripts[-1] += data
        elif self._open == "p":
            self.paragraphs[-1] += data
        elif self._open in ("title", "h1"):
            self.title = self.title or data.strip()
        elif self._open in ("dt", "th"):
            self._label = data.strip().lower()
        elif self._open in ("dd", "td") and self._label:
            self.pairs.setdefault(self._label, data.strip())


def _parsed(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def _listed(value) -> Iterator[dict]:
    """Dicts of a JSON value that look like items: a name and an address, at any depth."""
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            if isinstance(at.get("name"), str) and isinstance(at.get("url"), str):
                yield {"name": at["name"], "href": at["url"], "summary": str(at.get("description") or "")}
            stack.extend(reversed(list(at.values())))
        elif isinstance(at, list):
            stack.extend(reversed(at))


def page_cards(html: str | None) -> list[dict]:
    """Cards of a page: its named links, else the items of its embedded JSON."""
    page = _parsed(html or "")
    named = [dict(x, name=re.sub(r"\s+", " ", x["name"]).strip()) for x in page.links if x["href"] and x["name"].strip()]
    if named:
        return named
    out: list[dict] = []
    for script in page.scripts:
        if script not in ("", "-"):
            try:
                out += _listed(json.loads(script))
            except ValueError:
                continue  # a script that is no JSON holds no items
    return out


def _parsed_pages(pages: DataFrame, key: str, html: str, url: str, name: str, kind: str, made) -> DataFrame:
    """(key, url, name): what made(html, url) gives for each page, in Arrow batches."""
    schema = StructType([pages.schema[key], StructField("url", pages.schema[url].dataType), *StructType.fromDDL(f"{name} {kind}").fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [made(*x) for x in zip(b.column(html).to_pylist(), b.column(url).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(target.field(0).type), b.column(url).cast(target.field(1).type), pa.array(found, target.field(name).type)], schema=target)

    return pages.select(key, url, html).mapInArrow(run, schema)


def cards(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, place, name, detail_url, summary): the first card of each address of a page, by place."""

    def made(text, base):
        return [{"name": x["name"], "summary": x["summary"], "detail_url": _joined(base, x["href"])} for x in page_cards(text)]

    each = _parsed_pages(pages, key, html, url, "cards", CARDS, made).select(key, F.posexplode("cards").alias("place", "card"))
    each = each.select(key, "place", "card.name", "card.detail_url", "card.summary")
    return first_by(each, [key, "detail_url"], F.asc("place"))


def _joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href)
    except ValueError:  # an address that is none stays as it is
        return href


def details(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, url, title, info, paragraphs) of detail pages: the first title or heading, the table of labels (lower case, the
    first of each) and values, and the paragraphs with a text."""

    def made(text, _):
        page = _parsed(text or "")
        flat = lambda x: re.sub(r"\s+", " ", x).strip()
        return {"title": flat(page.title), "info": [(k, flat(v)) for k, v in page.pairs.items() if v.strip()], "paragraphs": [p for p in map(flat, page.paragraphs) if p]}

    return _parsed_pages(pages, key, html, url, "detail", DETAIL, made).select(key, "url", "detail.*")


def with_details(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Cards (detail_url, name, summary) with what their detail page says, for card_drafts and detail_drafts; a card without
    a page keeps empty details. Of several pages of an address the first by key counts."""
    key = next(c for c in found.columns if c not in ("url", "title", "info", "paragraphs"))
    own = first_by(found, ["url"], F.asc(key)).select(F.col("url").alias("detail_url"), "title", "info", "paragraphs")
    return listed.join(own, "detail_url", "left")


def first_seen_cards(listed: DataFrame, order: list[Column]) -> DataFrame:
    """Cards of several pages, the first of each address, else of each slug, else of each name."""
    identity = F.coalesce(F.nullif(F.col("detail_url"), F.lit("")), F.nullif(F.col("slug"), F.lit("")), F.col("name"))
    return first_by(listed.withColumn("_identity", identity), ["_identity"], *order).drop("_identity")


#: Words that show a capability.
CAPABILITY_WORDS = {"read": ("read",), "write": ("write", "create", "update"), "oauth": ("oauth", "authorize", "sign in")}


def capabilities_in(text: Column) -> Column:
    """A map of capability to yes for each capability that the text names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for name, words in CAPABILITY_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        found.append(F.when(hit, F.struct(F.lit(name).alias("key"), F.lit("yes").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*found)))


def card_drafts(listed: DataFrame, source_type: str, category_map: dict[str, str], category: str = "category", labels: str = "labels", n_use_cases: int = 7, extra: list | None = None) -> DataFrame:
    """Cards (name, detail_url, summary, category, labels) as drafts."""
    names = F.create_map(*(F.lit(x) for pair in category_map.items() for x in pair))
    known = F.try_element_at(names, F.lower(F.trim(category)))
    tags = label_list(F.col(labels))
    named = lambda word: F.when(F.exists(tags, lambda x: F.lower(x).contains(word)), F.lit(word))
    platforms = F.array_compact(F.array(*map(named, ("web", "desktop", "mobile"))))
    return listed.select(
        collapsed(F.col("name")).alias("name"),
        F.lit(source_type).alias("source_type"),
        F.col("detail_url").alias("external_id"),
        F.col("detail_url").alias("official_directory_url"),
        F.substring(collapsed(F.col("summary")), 1, 280).alias("short_description"),
        F.array_compact(F.array(known)).alias("categories"),
        F.array_sort(F.array_distinct(platforms)).alias("platforms"),
        F.slice(F.array_distinct(tags), 1, n_use_cases).alias("use_cases"),
        capabilities_in(F.col("summary")).alias("capabilities"),
        *(extra or []),
    )


#: Labels of an information table, by what they say; lower case.
INFO_LABELS = {
    "developer_name": ("developer", "publisher", "made by"),
    "official_page_url": ("website", "homepage", "site"),
    "category": ("category", "categories"),
    "labels": ("surfaces", "platforms", "available on"),
    "auth": ("authentication", "auth"),
    "transport": ("transport", "connection"),
}


def detail_drafts(both: DataFrame, source_type: str, category_map: dict[str, str]) -> DataFrame:
    """Drafts of cards with details: the table first, else what the paragraphs say.

    Capabilities: those the text names, oauth by the authentication, remote by the transport."""
    info = F.coalesce("info", F.create_map().cast("map<string,string>"))
    said = {name: F.coalesce(first_true(F.array(*(F.try_element_at(info, F.lit(x)) for x in labels))), F.lit("")) for name, labels in INFO_LABELS.items()}
    text = F.concat_ws(" ", F.coalesce("paragraphs", F.array().cast("array<string>")))
    own = both.withColumns({"category": said["category"], "labels": said["labels"]})
    drafts = card_drafts(own.withColumns({"_said_auth": F.lower(said["auth"]), "_said_transport": F.lower(said["transport"]), "_text": text}), source_type, category_map, extra=["_said_auth", "_said_transport", "_text", *(v.alias(f"_{k}") for k, v in said.items() if k in ("developer_name", "official_page_url"))])
    yes = lambda name, when: F.when(when, F.create_map(F.lit(name), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    found = F.map_concat(yes("oauth", F.col("_said_auth").contains("oauth")), yes("remote", F.col("_said_transport").rlike("http|sse|remote")))
    named = merged_map(F.col("capabilities"), capabilities_in(F.col("_text")))
    return drafts.withColumns(
        {
            "developer_name": first_true(F.array("_developer_name", developer_named(F.col("_text")))),
            "official_page_url": first_true(F.array("_official_page_url", first_address(F.col("_text")))),
            "long_description": F.col("_text"),
            "capabilities": merged_map(named, found),
        }
    ).drop("_said_auth", "_said_transport", "_text", "_developer_name", "_official_page_url")
