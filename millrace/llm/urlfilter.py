"""URL filters: a weighted vocabulary that an Aho-Corasick automaton counts in the whole url, query and fragment included.

A strict term rejects a url by itself, soft terms by SOFT_HITS distinct ones. A hit needs boundaries: no letter or
digit before or after it. Before the vocabulary come rules for a host with its subdomains and a path prefix; the
longest rule that fits decides.

The vocabulary and the rules are parameters with a fixed size; the automaton is built once in each task. Only urls
are read, and nothing is shuffled.

Defined results: a url that is null or has no `://` has an empty host and path and fits no rule, so that its words
decide (null has none and is allowed); of a strict and a soft hit the strict one decides; repeated rows get a row each; an
empty table gives an empty one; other columns pass through, but columns `filter`, `hits` and `_url` are replaced or left out.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, with_column_from_text

#: One of these rejects a url.
STRICT = (
    "adult", "bets", "betting", "casino", "escort", "hentai", "jackpot", "malware", "nude", "phishing", "pills", "poker",
    "porn", "porno", "sex", "spam", "viagra", "warez", "xxx",
)
#: Several different ones of these reject a url.
SOFT = (
    "ad", "ads", "affiliate", "banner", "bonus", "cheap", "click", "coupon", "crack", "dating", "deal", "deals", "discount",
    "farm", "free", "loan", "loans", "lottery", "popup", "prize", "promo", "seo", "sponsor", "track", "tracker", "tracking", "win",
)
SOFT_HITS = 2
#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
HITS = "struct<n_strict:bigint,n_soft:bigint>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    rest = F.when(url.contains("://"), F.substr(url, F.locate("://", url) + F.lit(3)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def vocabulary_hits(df: DataFrame, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with a struct column `hits` of distinct strict and soft terms in lower-cased `text`."""
    held: list = []

    def automaton():
        a = ahocorasick.Automaton()
        for kind, terms in enumerate((strict, soft)):
            for term in terms:
                a.add_word(term, (kind, term))
        a.make_automaton()
        return a

    def values(texts: list[bytes], _) -> pa.Array:
        held or held.append(automaton())
        found = []
        for text in (t.decode().lower() for t in texts):
            kinds: tuple[set, set] = set(), set()
            for last, (kind, term) in held[0].iter(text):
                first = last - len(term) + 1
                if not (first and text[first - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
                    kinds[kind].add(term)
            found.append((len(kinds[0]), len(kinds[1])))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["n_strict", "n_soft"])

    return with_column_from_text(df, "hits", HITS, values, text=text, keep=keep)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(df: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with a struct column `filter`: host, path, rule, verdict, n_strict, n_soft."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("filter", "_url", "hits")]
    host, path = host_and_path(F.col(url))
    parts = df.select(*(F.col(f"`{c}`") for c in keep), F.struct(host.alias("host"), path.alias("path")).alias("filter"), F.col(url).alias("_url"))
    hits = vocabulary_hits(parts, text="_url", keep=[*keep, "filter"])
    rule = longest_rule(F.col("filter.host"), F.col("filter.path"))
    own = F.when((F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= SOFT_HITS), F.lit("block")).otherwise(F.lit("allow"))
    whole = F.struct("filter.host", "filter.path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], own).alias("verdict"), "hits.n_strict", "hits.n_soft")
    return hits.select(*(F.col(f"`{c}`") for c in keep), whole.alias("filter"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "filter.*")


def _count(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^\\pL\\pN]){t}($|[^\\pL\\pN])')::INT" for t in terms)


OP9_SQL = rf"""
WITH r AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM r),
h AS (
  SELECT *, CAST({_count(STRICT)} AS BIGINT) AS n_strict, CAST({_count(SOFT)} AS BIGINT) AS n_soft
  FROM (SELECT *, lower(coalesce(url, '')) AS u FROM p)),
j AS (
  SELECT page_id, host, path, n_strict, n_soft,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM h)
SELECT page_id, host, path, rule, n_strict, n_soft,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
