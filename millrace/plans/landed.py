"""Landed answers of every source, made of the tables at hand: feeds, searches, file bodies, fixtures, cursors, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import feeds, registry
from ..storage import spread
from ..tables import Tables
from .registry import query


def _text(*parts: str | Column) -> Column:
    """Parts as one text; plain strings are literals, `$name` is a column."""
    one = lambda p: p if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p)
    return F.concat(*map(one, parts))


@query(
    """SELECT p_partkey AS place, CASE WHEN p_partkey % 7 <> 0 THEN p_name || ' ext' ELSE whole END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'ext-' || p_partkey ELSE lower(whole) END AS external_id,
    CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'made by ' || p_brand END AS short_description, 'Own' || p_size AS developer_name, 'https://github.com/Own' || p_size AS developer_url,
    concat_ws(',', CASE WHEN p_partkey % 4 <> 0 AND p_size % 2 = 0 THEN 'context' END, CASE WHEN p_size > 25 THEN 'mcp' END) AS has,
    CASE WHEN p_partkey % 4 = 0 THEN 'hasContext=absent' WHEN p_size % 2 = 0 THEN 'hasContext=true' ELSE 'hasContext=false' END AS evidence
    FROM (SELECT *, 'Own' || p_size || '/' || replace(p_name, ' ', '-') AS whole FROM part) WHERE p_partkey % 13 <> 0"""
)
def feed_entry_drafts(t: Tables) -> DataFrame:
    """Feed entries as drafts: identity, owner and flags, some absent; an entry that is no object is a dead letter."""
    k = F.col("p_partkey")
    entry = F.struct(
        F.when(k % 3 == 0, _text("ext-", "$p_partkey")).alias("id"),
        _text("Own", "$p_size", "/", F.replace("p_name", F.lit(" "), F.lit("-"))).alias("fullName"),
        F.when(k % 7 != 0, _text("$p_name", "  ext")).alias("extensionName"),
        F.when(k % 2 != 0, _text("made by ", "$p_brand")).alias("extensionDescription"),
        F.col("p_type").alias("repoDescription"),
        (F.col("p_size") > 25).alias("hasMCP"),
        F.when(k % 4 != 0, F.col("p_size") % 2 == 0).alias("hasContext"),
    )
    each = t.part.select(k.alias("place"), F.when(k % 13 == 0, F.lit('"oops"')).otherwise(F.to_json(entry)).alias("record"))
    good, _ = registry.split(registry.feed_drafts(each))
    has = F.array_sort(F.map_keys(F.map_filter("capabilities", lambda _, v: v == "yes")))
    return good.select("place", "name", "external_id", "short_description", "developer_name", "developer_url", F.array_join(has, ",").alias("has"), F.col("capability_evidence")["context"].alias("evidence"))


@query(
    """SELECT p_partkey AS page, 'About ' || p_name AS title, 'https://f.example/' || p_partkey AS url, p_type || ' of ' || p_brand AS summary, NULL AS published, 'rss:https://f.example/' || p_partkey AS external_id FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, '', 'urn:' || p_partkey, '', CASE WHEN p_size > 9 THEN 'day ' || p_size END, 'rss:urn:' || p_partkey FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT p_partkey, p_name, 'https://a.example/?a=1&b=' || p_partkey, p_brand, '2024-01-01', 'rss:https://a.example/?a=1&b=' || p_partkey FROM part WHERE p_partkey % 2 = 1"""
)
def rss_entries(t: Tables) -> DataFrame:
    """RSS items (some with a guid alone, some without any address) and Atom entries of one feed a part."""
    k = F.col("p_partkey")
    linked = _text("<item><title>About ", "$p_name", "</title><link>https://f.example/", "$p_partkey", "</link><description>&lt;b&gt;", "$p_type", "&lt;/b&gt; of ", "$p_brand", "</description></item>")
    guid = F.when(k % 4 == 0, _text("<guid>urn:", "$p_partkey", "</guid>")).otherwise("")
    day = F.when(F.col("p_size") > 9, _text("<pubDate>day ", "$p_size", "</pubDate>")).otherwise("")
    rss = _text("<rss><channel>", linked, "<item>", guid, day, "</item></channel></rss>")
    atom = _text("<feed><entry><title>", "$p_name", '</title><link href="https://a.example/?a=1&amp;b=', "$p_partkey", '"/><summary>', "$p_brand", "</summary><updated>2024-01-01</updated></entry></feed>")
    pages = spread(t.part).select(k.alias("page"), F.when(k % 2 == 0, rss).otherwise(atom).alias("xml"))
    return feeds.rss_items(pages).select("page", "title", "url", "summary", "published", "external_id")


@query(
    """SELECT 'Kit ' || s_suppkey AS name, 'code_search' AS source_type, 'org' || s_nationkey || '/kit-' || s_suppkey AS external_id, 'https://github.com/Org' || s_nationkey || '/kit-' || s_suppkey AS repo_url,
    CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'kit of ' || s_name END AS short_description FROM supplier WHERE s_suppkey % 11 <> 0"""
)
def code_search_drafts(t: Tables) -> DataFrame:
    """Answers of a code search as minimal drafts: one answer a supplier, some broken, some with an item without a name."""
    k = F.col("s_suppkey")
    item = lambda name, url, said: F.struct(name.alias("full_name"), url.alias("html_url"), said.alias("description"))
    own = _text("Org", "$s_nationkey", "/kit-", "$s_suppkey")
    good = item(own, _text("https://github.com/", own), F.when(k % 5 != 0, _text("kit of ", "$s_name")))
    nameless = item(F.lit(""), _text("https://github.com/", own), F.lit(None).cast("string"))
    answer = F.to_json(F.struct(F.when(k % 3 == 0, F.array(good, nameless)).otherwise(F.array(good)).alias("items")))
    answers = t.supplier.select(F.when(k % 11 == 0, F.lit("busy")).otherwise(answer).alias("raw"))
    return feeds.candidate_drafts(feeds.search_candidates(answers))


@query("SELECT doc_id, md5(substr(text, 1, 12000)) AS body, length(substr(text, 1, 12000)) AS n_chars FROM documents")
def readme_bodies(t: Tables) -> DataFrame:
    """File bodies that come in base64, with line breaks, as text of the length that a context has."""
    body = feeds.readme_text(F.base64(F.col("text").cast("binary")))
    return t.documents.select("doc_id", F.md5(body).alias("body"), F.length(body).cast("long").alias("n_chars"))


@query(
    """SELECT 'source' AS model, s_suppkey AS pk, s_name AS name, CAST(s_nationkey AS VARCHAR) AS place FROM supplier
    UNION ALL SELECT DISTINCT 'place', s_nationkey, 'place ' || s_nationkey, NULL FROM supplier"""
)
def seed_records(t: Tables) -> DataFrame:
    """Seed fixtures, of which places come many times and are loaded once."""
    record = lambda model, pk, fields: F.struct(F.lit(model).alias("model"), pk.cast("long").alias("pk"), fields.alias("fields"))
    source = record("source", F.col("s_suppkey"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("place"), F.col("s_nationkey").cast("string")))
    place = record("place", F.col("s_nationkey"), F.create_map(F.lit("name"), _text("place ", "$s_nationkey")))
    rows = feeds.fixture_rows(t.supplier.select(F.to_json(F.array(source, place)).alias("value")))
    once = rows.groupBy("model", "pk").agg(F.max(F.col("fields")["name"]).alias("name"), F.max(F.col("fields")["place"]).alias("place"))
    return once.select("model", "pk", "name", "place")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'c' || user_id WHEN 1 THEN 'm' || user_id WHEN 2 THEN NULL WHEN 3 THEN 'c0' ELSE NULL END AS following FROM events"""
)
def registry_cursors(t: Tables) -> DataFrame:
    """The cursor that follows a registry page: the first that is set, if it is a text; broken pages have none."""
    k = F.col("event_id") % 5
    page = (
        F.when(k == 0, _text('{"next_cursor": "c', "$user_id", '", "metadata": {"nextCursor": "no"}}'))
        .when(k == 1, _text('{"next_cursor": null, "metadata": {"nextCursor": "m', "$user_id", '"}}'))
        .when(k == 2, _text('{"metadata": {"nextCursor": ', "$user_id", "}}"))
        .when(k == 3, F.lit('{"servers": [], "next_cursor": "", "metadata": {"nextCursor": "c0"}}'))
        .otherwise(_text('{"next_cursor": "c', "$user_id"))
    )
    return t.events.select("event_id", registry.next_cursor(page).alias("following"))


@query(
    """SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ', ' || p_type || ' |' || p_brand || ',,', '[,|]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS labels FROM part"""
)
def label_parts(t: Tables) -> DataFrame:
    """Labels of a listing, between commas and bars."""
    return t.part.select("p_partkey", F.array_join(tx.label_list(_text("$p_name", ", ", "$p_type", " |", "$p_brand", ",,")), "/").alias("labels"))


_VERDICT = "CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN 'Draft: ' || p_type || ' for ' || p_brand || ' and all who work with one' WHEN 2 THEN p_name || ' is of ' || p_type || ', by ' || p_brand || ', in size ' || p_size END"


@query(
    f"""SELECT p_partkey, v IN ('blue ring with a long stock phrase for everyone') OR length(v) < 40 OR starts_with(v, 'draft:') AS says_little
    FROM (SELECT p_partkey, lower(trim(coalesce({_VERDICT}, ''))) AS v FROM part)"""
)
def low_information_verdicts(t: Tables) -> DataFrame:
    """Verdicts that say too little: stock phrases, drafts, short ones and none."""
    k = F.col("p_partkey") % 4
    verdict = (
        F.when(k == 0, _text(" ", F.upper("p_name")))
        .when(k == 1, _text("Draft: ", "$p_type", " for ", "$p_brand", " and all who work with one"))
        .when(k == 2, _text("$p_name", " is of ", "$p_type", ", by ", "$p_brand", ", in size ", "$p_size"))
    )
    said = tx.low_information(verdict, ("blue ring with a long stock phrase for everyone",), ("draft:",))
    return t.part.select("p_partkey", said.alias("says_little"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.1.0.' || user_id WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN '' ELSE '127.0.0.1' END ELSE '127.0.0.1' END AS address FROM events"""
)
def client_addresses(t: Tables) -> DataFrame:
    """Addresses of clients: the first hop that a proxy names, else the peer."""
    k = F.col("event_id") % 4
    header = F.when(k == 0, _text(" 10.0.0.", "$user_id", " , 192.168.0.1")).when(k == 1, _text("10.1.0.", "$user_id")).when(k == 2, F.when(F.col("user_id") % 2 == 0, " , 10.2.0.1").otherwise(""))
    return t.events.select("event_id", tx.client_ip(header, F.lit("127.0.0.1")).alias("address"))
