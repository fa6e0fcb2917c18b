"""Text, URL and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index, relational as rel, search, trust
from ..operators.identity import WEAK, close_pairs, name_ratio
from ..operators.identity import unique_slugs as unique
from ..sources.html_directory import cards, detail_drafts, details, first_seen_cards, with_details
from ..storage import spread
from ..tables import Tables
from . import views
from .derived import fresh_snapshots
from .registry import SQL, query

_TRI = """list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
_SLUG = """regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9_\\s-]', '', 'g')), '[-\\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')"""
_HOST = "lower(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_IDENTITY = f"""regexp_replace({_HOST}, '^www\\.', '') || CASE WHEN regexp_replace(lower({_PATH}), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower({_PATH}), '/+$', '') END"""
_STOP = ", ".join(f"'{w}'" for w in search.STOPWORDS)


@query(f"SELECT p_partkey AS app_id, {_SLUG.format("p_name || ' (' || p_brand || ')'")} AS slug FROM part")
def slugify_names(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("app_id"), tx.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query(
    f"""WITH s AS (SELECT p_partkey AS app_id, {_SLUG.format('p_name')} AS base FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY app_id) AS i FROM s)
    SELECT app_id, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS slug FROM n"""
)
def unique_slugs(t: Tables) -> DataFrame:
    """A number after the second and later apps of a slug; a group of one slug is ordered by Spark's external sort."""
    return unique(t.part.select(F.col("p_partkey").alias("app_id"), tx.slugify(F.col("p_name")).alias("base")), "app_id", "base")


@query(
    f"""WITH d AS (SELECT p_partkey AS app_id, {_TRI.format('p_name')} AS g, {_TRI.format("'red wigdet'")} AS q FROM part),
    s AS (SELECT app_id, len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) AS s FROM d)
    SELECT app_id, round(s, 6) AS similarity FROM s WHERE s > 0.25"""
)
def trigram_search(t: Tables) -> DataFrame:
    return search.similar(views.apps(t), "app_id", "name", "red wigdet")


@query(
    f"""WITH d AS (SELECT p_name, min(p_partkey) AS k, {_TRI.format('p_name')} AS g FROM part GROUP BY p_name),
    p AS (SELECT a.k AS k1, b.k AS k2, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM d a JOIN d b ON a.k < b.k)
    SELECT k1, k2, round(s, 6) AS similarity FROM p WHERE s > 0.4"""
)
def trigram_self_similar(t: Tables) -> DataFrame:
    return search.similar_pairs(views.apps(t), "app_id", "name", 0.4)


@query(
    f"""WITH q(a, b, ratio) AS ({views.ratios_sql(views.part_names(), views.part_names(), 0.0)}), n AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY ALL)
    SELECT x.k AS k1, y.k AS k2, ratio FROM n x JOIN n y ON x.k < y.k JOIN q ON a = x.name AND b = y.name
    WHERE ratio >= {WEAK} OR split_part(x.name, ' ', 1) = split_part(y.name, ' ', 1)"""
)
def ratio_name_pairs(t: Tables) -> DataFrame:
    """Pairs of names with their matching-block ratio: those of the same first word, and all of a ratio of WEAK or more."""
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).withColumn("block", F.element_at(F.split("p_name", " "), 1))
    a, b = (names.select("block", F.col("k").alias(f"k{s}"), F.col("p_name").alias(f"name{s}")) for s in "12")
    close = close_pairs(names, "k", "p_name").where("k1 < k2")
    pairs = a.join(b, "block").where("k1 < k2").select("k1", "k2").union(close).distinct().join(a.drop("block"), "k1").join(b, "k2")
    scored = pairs.withColumn("ratio", F.round(name_ratio(F.col("name1"), F.col("name2")), 6))
    return scored.where((F.col("ratio") >= WEAK) | (F.element_at(F.split("name1", " "), 1) == F.col("block"))).select("k1", "k2", "ratio")


_POSTINGS = f"""WITH f AS (SELECT item_id AS id, text AS a, '' AS c FROM benchmark UNION ALL SELECT doc_id + 1000000, lang || ' ' || source, text FROM documents),
p AS (SELECT id, unnest(string_split_regex(lower(a), '[^a-z0-9]+')) AS lexeme, 1.0::DOUBLE AS weight FROM f
  UNION ALL SELECT id, unnest(string_split_regex(lower(c), '[^a-z0-9]+')), 0.2::DOUBLE FROM f),
i AS (SELECT id, lexeme, max(weight) AS weight FROM p WHERE lexeme <> '' AND lexeme NOT IN ({_STOP}) GROUP BY ALL)
"""


def _index(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.select((F.col("doc_id") + 1_000_000).alias("id"), F.concat_ws(" ", "lang", "source").alias("a"), F.col("text").alias("c"))
    whole = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("a"), F.lit("").alias("c")).unionAll(docs)
    return whole, search.postings(whole, "id", {"A": ["a"], "C": ["c"]})


@query(_POSTINGS + "SELECT id, count(*) AS n_lexemes, round(sum(weight), 4) AS total FROM i GROUP BY id")
def fts_postings(t: Tables) -> DataFrame:
    return _index(t)[1].groupBy("id").agg(F.count("*").alias("n_lexemes"), F.round(F.sum("weight"), 4).alias("total"))


@query(_POSTINGS + "SELECT id FROM i WHERE lexeme IN ('src3', 'fr', 'ou') GROUP BY id HAVING count(*) = 3")
def fts_match_and(t: Tables) -> DataFrame:
    return search.match(_index(t)[1], "id", "the src3, FR ou").select("id")


@query(
    _POSTINGS
    + """SELECT id, round(sum(weight), 6) AS rank FROM i WHERE lexeme IN ('en', 'sh') GROUP BY id HAVING count(*) = 2 ORDER BY rank DESC, id LIMIT 24"""
)
def fts_weighted_rank(t: Tables) -> DataFrame:
    return rel.top(search.match(_index(t)[1], "id", "en sh"), 24, F.desc("rank"), F.asc("id"))


@query(
    f"""WITH d AS (SELECT p_partkey AS app_id, {_TRI.format('p_name')} AS g, {_TRI.format("'blue wiget'")} AS q FROM part)
    SELECT app_id, 1.0::DOUBLE AS rank FROM d WHERE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) > 0.25"""
)
def fts_or_trigram_fallback(t: Tables) -> DataFrame:
    apps = views.apps(t)
    return search.search(apps, search.postings(apps, "app_id", {"A": ["name"], "B": ["developer"]}), "app_id", "name", "blue wiget")


def _followed(t: Tables) -> index.StoredIndex:
    """An index of documents as they were, which has then taken in a batch: changed texts, new documents and ones that went."""
    docs, _ = _index(t)
    stored = index.StoredIndex(fresh_snapshots(t.part.sparkSession, "index"), "id", index.search_terms("id", {"A": ["a"], "C": ["c"]}), buckets=16)
    was = docs.where("id % 5 <> 1").withColumn("a", F.when(F.col("id") % 7 == 0, "src3 fr").otherwise(F.col("a"))).withColumn("c", F.when(F.col("id") % 7 == 0, "ou en sh").otherwise(F.col("c")))
    extra = was.limit(0).unionAll(docs.where("id % 11 = 0").select((-F.col("id") - 1).alias("id"), F.lit("src3 fr en").alias("a"), F.lit("ou sh").alias("c")))
    stored.build(was.unionAll(extra))
    stored.apply(docs.where("id % 5 = 1 or id % 7 = 0"), 1, gone=extra.select("id"))
    return stored


@query(SQL["fts_match_and"])
def stored_match_and(t: Tables) -> DataFrame:
    """fts_match_and from the buckets of its lexemes, after an index has followed a batch of changes."""
    return index.match(_followed(t), "the src3, FR ou").select("id")


@query(SQL["fts_weighted_rank"])
def stored_weighted_rank(t: Tables) -> DataFrame:
    """fts_weighted_rank likewise, after the batch was folded into the buckets."""
    stored = _followed(t)
    stored.compact()
    return rel.top(index.match(stored, "en sh"), 24, F.desc("rank"), F.asc("id"))


@query(SQL["trigram_search"])
def stored_trigram_search(t: Tables) -> DataFrame:
    """trigram_search from the postings of the query's grams."""
    stored = index.StoredIndex(fresh_snapshots(t.part.sparkSession, "grams"), "app_id", index.gram_terms("app_id", "name"), buckets=16)
    apps = views.apps(t)
    stored.build(apps.withColumn("name", F.when(F.col("app_id") % 3 == 0, F.lit("red wigdet")).otherwise(F.col("name"))))
    stored.apply(apps.where("app_id % 3 = 0"), 1)
    return index.similar(stored, "red wigdet")


@query(
    """WITH n AS (SELECT DISTINCT lower(p_name) AS text FROM part WHERE starts_with(p_name, 'red')),
    p AS (SELECT text, 0 AS source, row_number() OVER (ORDER BY text) AS place FROM n
      UNION ALL SELECT text, 1, row_number() OVER (ORDER BY text DESC) FROM (SELECT DISTINCT upper(p_name) AS text FROM part WHERE contains(p_name, 'r') AND contains(p_name, 'ring'))),
    u AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY source, place) AS r FROM p)
    SELECT text, source, CAST(place AS INTEGER) AS place FROM u WHERE r = 1 ORDER BY source, place LIMIT 8"""
)
def suggestions_merge(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rank = lambda df, order: df.withColumn("place", F.row_number().over(Window.orderBy(order)))  # noqa: E731  over a list of names
    popular = t.part.where(F.col("p_name").startswith("red")).select(F.lower("p_name").alias("text")).distinct()
    names = t.part.where(F.col("p_name").contains("r") & F.col("p_name").contains("ring")).select(F.upper("p_name").alias("text")).distinct()
    return rel.merged_suggestions([rank(popular.orderBy("text").limit(8), F.asc("text")), rank(names.orderBy(F.desc("text")).limit(16), F.desc("text"))], "text", "place", 8)


_STEM = "lexeme"
for _pattern, _kept in tx.ENDINGS:
    _STEM = f"regexp_replace({_STEM}, '{_pattern}', '{_kept.replace('$', chr(92))}')"
_STEMMED = f"""WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS lexeme, 0.4::DOUBLE AS weight FROM documents
  UNION ALL SELECT doc_id, unnest(string_split_regex(lower(lang || ' ' || source), '[^a-z0-9]+')), 0.1::DOUBLE FROM documents),
i AS (SELECT id, CASE WHEN length(lexeme) > 3 THEN {_STEM} ELSE lexeme END AS lexeme, max(weight) AS weight FROM w WHERE lexeme <> '' AND lexeme NOT IN ({_STOP}) GROUP BY ALL)
"""


@query(_STEMMED + "SELECT id, count(*) AS n_lexemes, round(sum(weight), 4) AS total FROM i GROUP BY id")
def fts_stemmed_postings(t: Tables) -> DataFrame:
    return _stemmed(t).groupBy("id").agg(F.count("*").alias("n_lexemes"), F.round(F.sum("weight"), 4).alias("total"))


@query(_STEMMED + "SELECT id, round(sum(weight), 6) AS rank FROM i WHERE lexeme IN ('src1', 'er') GROUP BY id HAVING count(*) = 2")
def fts_stemmed_match(t: Tables) -> DataFrame:
    """A query whose words and those of the texts are stemmed alike, with the least weight class too."""
    return search.match(_stemmed(t), "id", "SRC1 ering", stems=True)


def _stemmed(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("b"), F.concat_ws(" ", "lang", "source").alias("d"))
    return search.postings(docs, "id", {"B": ["b"], "D": ["d"]}, stems=True)


@query("SELECT p_partkey AS app_id, p_name AS name, CAST(least(100, p_size * 2) AS INTEGER) AS quality_score FROM part ORDER BY quality_score DESC, -p_partkey DESC, app_id LIMIT 24")
def search_sorted(t: Tables) -> DataFrame:
    """A page by the default order: quality, then newest (the greatest number here), whatever the query."""
    found = views.apps(t).withColumns({"first_seen_at": -F.col("app_id"), "rank": F.lit(1.0)})
    return rel.top(found, 24, *search.sort_order("relevance")).select("app_id", "name", F.col("quality_score").cast("int").alias("quality_score"))


@query(
    """WITH d AS (SELECT doc_id, text, regexp_extract(text, '(?s)\\bby\\s+([A-Z][\\w .,&-].*)', 1) AS said,
      list_filter(string_split_regex(text, '[\\s)]+'), lambda w: regexp_matches(w, 'https?://.')) AS words FROM documents)
    SELECT doc_id, trim(left(string_split_regex(said, '[^\\w .,&-]')[1], 81)) AS developer, coalesce(regexp_extract(words[1], 'http(s:|:).*'), '') AS address FROM d"""
)
def captured_groups(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.author_named(F.col("text")).alias("developer"), tx.first_address(F.col("text")).alias("address"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso,
    'https://r.example/servers/' || replace(o_orderpriority, ' ', '%20') AS address FROM orders"""
)
def display_labels(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    address = F.concat(F.lit("https://r.example/servers/"), tx.url_quoted(F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", tx.day_label(at).alias("day"), tx.iso_label(at).alias("iso"), address.alias("address"))


_DIRECTORY = """WITH c AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, 'https://d.example/apps/' || p_partkey AS detail_url FROM part)
"""


def _listing(t: Tables) -> DataFrame:
    """Pages of a directory made of parts: ten cards a page, the first card of a page once more on the one before it."""
    k = F.col("p_partkey")
    card = F.concat(F.lit('<a href="/apps/'), k, F.lit('" data-description="a '), "p_type", F.lit('">'), "p_name", F.lit("</a>"))
    both = t.part.select(k.alias("k"), card.alias("card"), F.explode(F.array((k / 10).cast("bigint"), ((k - 1) / 10).cast("bigint"))).alias("page"))
    pages = both.distinct().groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "card"))).alias("c"))
    return pages.select("page", F.lit("https://d.example/list?p=1").alias("url"), F.array_join(F.transform("c", lambda x: x["card"]), "\n").alias("html"))


@query(_DIRECTORY + "SELECT detail_url, name, 'a ' || type AS summary, (k - 1) // 10 AS page FROM c")
def directory_cards(t: Tables) -> DataFrame:
    """Cards of all pages, each once, from the first page that lists it."""
    listed = cards(_listing(t), "page").withColumn("slug", F.lit(""))
    return first_seen_cards(listed, [F.asc("page"), F.asc("place")]).select("detail_url", "name", "summary", "page")


@query(
    _DIRECTORY
    + """SELECT detail_url AS external_id, name, CASE WHEN k % 2 = 0 THEN brand ELSE 'Maker ' || size END AS developer_name, CASE WHEN k % 3 = 0 THEN 'https://s.example/' || k ELSE '' END AS official_page_url,
    CASE type WHEN 'ECONOMY' THEN 'budget' ELSE '' END AS category, CASE WHEN size % 2 = 0 THEN 'desktop,web' ELSE '' END AS platforms,
    CASE WHEN k % 5 = 0 THEN 'yes' END AS oauth, CASE WHEN k % 7 = 0 THEN 'yes' END AS remote, CASE WHEN size % 4 = 0 THEN 'yes' END AS write FROM c"""
)
def directory_drafts(t: Tables) -> DataFrame:
    """Cards with their detail pages as drafts: the information table first, else what the paragraphs say."""
    k, size = F.col("p_partkey"), F.col("p_size")
    row = lambda label, value, when: F.when(when, F.concat(F.lit(f"<tr><th>{label}</th><td>"), value, F.lit("</td></tr>"))).otherwise("")
    rows = [
        row("Developer", F.col("p_brand"), k % 2 == 0),
        row("Category", F.col("p_type"), F.lit(True)),
        row("Surfaces", F.lit("Web app, Desktop"), size % 2 == 0),
        row("Authentication", F.lit("OAuth 2"), k % 5 == 0),
        row("Transport", F.lit("Streamable HTTP"), k % 7 == 0),
    ]
    text = F.concat(
        F.lit("<p>Made by Maker "), size, F.lit(" Category &amp; more</p>"), F.when(k % 3 == 0, F.concat(F.lit("<p>See https://s.example/"), k, F.lit(" now</p>"))).otherwise(""),
        F.when(size % 4 == 0, "<p>You can create and update.</p>").otherwise(""),
    )
    html = F.concat(F.lit("<html><h1>"), "p_name", F.lit("</h1><table>"), *rows, F.lit("</table>"), text, F.lit("</html>"))
    found = details(spread(t.part).select(k.alias("page"), F.concat(F.lit("https://d.example/apps/"), k).alias("url"), html.alias("html")), "page")
    listed = first_seen_cards(cards(_listing(t), "page").withColumn("slug", F.lit("")), [F.asc("page"), F.asc("place")])
    drafts = detail_drafts(with_details(listed.drop("page", "place", "slug"), found), "directory", {"economy": "budget"})
    has = lambda c: F.col("capabilities")[c].alias(c)
    return drafts.select(
        "external_id", "name", "developer_name", F.coalesce("official_page_url", F.lit("")).alias("official_page_url"), F.concat_ws(",", "categories").alias("category"),
        F.concat_ws(",", "platforms").alias("platforms"), has("oauth"), has("remote"), has("write"),
    )


@query(f"SELECT page_id, {_IDENTITY} AS identity FROM pages")
def url_identity(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.url_identity(F.col("url")).alias("identity"))


@query(f"SELECT regexp_replace({_HOST}, '^www\\.', '') AS domain, count(*) AS n FROM pages GROUP BY ALL")
def url_domain_counts(t: Tables) -> DataFrame:
    return t.pages.groupBy(tx.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(
    f"""WITH u AS (SELECT page_id, 'https://github.com/' || replace({_HOST}, '.', '-') || {_PATH} AS url FROM pages)
    SELECT page_id, CASE WHEN len(list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')) >= 2 THEN 'github.com/' ||
      list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')[1] || '/' || list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')[2] ELSE '' END AS repo FROM u"""
)
def repo_identity(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://github.com/"), F.replace(tx.host(F.col("url")), F.lit("."), F.lit("-")), tx.url_path(F.col("url")))
    return t.pages.select("page_id", tx.repo_identity(url).alias("repo"))


@query(f"SELECT {_IDENTITY} AS identity, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1")
def exact_url_duplicates(t: Tables) -> DataFrame:
    return t.pages.groupBy(tx.url_identity(F.col("url")).alias("identity")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1")


@query(
    """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS digest FROM pages"""
)
def html_strip_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(tx.stripped_html(F.col("html"))).alias("digest"))


@query(
    """SELECT page_id, url, md5(substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 2000)) AS digest FROM pages"""
)
def fetched_context(t: Tables) -> DataFrame:
    """What a model is given of a fetched page: its text up to a limit, which is the feature (2,000 characters here)."""
    return t.pages.select("page_id", "url", F.md5(tx.context_text(F.col("html"), 2000)).alias("digest"))


@query(
    """WITH d AS (SELECT doc_id, substr(text, 1, 30) AS short, list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS b FROM documents),
    f AS (SELECT doc_id, list_filter(b, lambda x: length(x) >= 60 AND x <> trim(short))[1] AS p FROM d WHERE length(trim(short)) < 60)
    SELECT doc_id AS app_id, substr(regexp_extract(p, '^(.*?[.!?])\\s', 1) || CASE WHEN regexp_matches(p, '^.*?[.!?]\\s') THEN '' ELSE p END, 1, 280) AS planned FROM f WHERE p IS NOT NULL"""
)
def trust_descriptions(t: Tables) -> DataFrame:
    """A sentence of the long description for texts whose short one is too short."""
    apps = t.documents.select(F.col("doc_id").alias("app_id"), F.substring("text", 1, 30).alias("short_description"), F.col("text").alias("long_description"))
    return trust.description_backfill(apps.select("app_id"), apps)


@query()
def html_cards(t: Tables) -> DataFrame:
    """Links of each page as directory cards: place, name and address, first of each address."""
    return cards(t.pages.select("page_id", "url", "html"), "page_id")


@query("SELECT doc_id, md5(string_split_regex(trim(text), '[.!?]\\s+')[1]) AS head FROM documents WHERE length(trim(text)) > 0")
def first_sentence(t: Tables) -> DataFrame:
    sentence = F.regexp_replace(tx.first_sentence(F.col("text")), r"[.!?]$", "")
    both = t.documents.where(F.length(F.trim("text")) > 0)
    whole = F.element_at(F.split(F.trim("text"), r"(?<=[.!?])\s+", 2), 1) == F.trim("text")  # one sentence keeps its mark
    return both.select("doc_id", F.md5(F.when(whole, F.trim("text")).otherwise(sentence)).alias("head"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\bin the\\b')")
def regex_beta_flag(t: Tables) -> DataFrame:
    return t.documents.where(F.lower("text").rlike(r"\bin the\b")).select("doc_id")


@query(
    """SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'ou') THEN 'read' END,
    CASE WHEN contains(lower(text), 'write') OR contains(lower(text), 'the') OR contains(lower(text), 'update') THEN 'write' END,
    CASE WHEN contains(lower(text), 'oauth') OR contains(lower(text), 'sign in') THEN 'auth' END) AS found FROM conversations"""
)
def keyword_capabilities(t: Tables) -> DataFrame:
    low = F.lower("text")
    has = lambda *w: rel.any_of([low.contains(x) for x in w])
    found = [F.when(has("ou"), "read"), F.when(has("write", "the", "update"), "write"), F.when(has("oauth", "sign in"), "auth")]
    return t.conversations.select("conv_id", "turn", F.concat_ws(",", *found).alias("found"))


@query("SELECT doc_id, md5(substr(text, 1, 280)) AS cut, length(substr(text, 1, 280)) AS n FROM documents")
def truncate_280(t: Tables) -> DataFrame:
    cut = F.substring("text", 1, 280)
    return t.documents.select("doc_id", F.md5(cut).alias("cut"), F.length(cut).cast("bigint").alias("n"))


@query("SELECT p_partkey AS app_id, '{\"@type\":\"SoftwareApplication\",\"name\":\"' || p_name || '\"' || CASE WHEN p_size >= 35 THEN ',\"rating\":' || (p_size * 2 // 20) ELSE '' END || '}' AS doc FROM part")
def json_ld_docs(t: Tables) -> DataFrame:
    rating = F.when(F.col("p_size") >= 35, F.floor(F.col("p_size") * 2 / 20).cast("int"))
    return t.part.select(F.col("p_partkey").alias("app_id"), F.to_json(F.struct(F.lit("SoftwareApplication").alias("@type"), F.col("p_name").alias("name"), rating.alias("rating"))).alias("doc"))
