"""Full-text search over weighted postings, trigram fallback, suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENDINGS, stemmed, trigrams, words
from ..storage import materialise

FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
SIMILARITY = 0.25
#: Words that carry no meaning in a query.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def postings(docs: DataFrame, key: str, fields: dict[str, list[str]], stems: bool = False) -> DataFrame:
    """(key, lexeme, weight): the best weight of each lexeme of a document. fields: columns by weight class; stems: lexemes
    are stems, and a query needs stems too."""
    weighted = lambda cols, weight: F.transform(F.array_distinct(words(F.concat_ws(" ", *cols))), lambda x: F.struct(x.alias("lexeme"), F.lit(weight).alias("weight")))
    found = [weighted(cols, FIELD_WEIGHTS[w]) for w, cols in fields.items()]
    # texts are dealt by key, so that what is made of them need not be; the outer form cuts up each text once, and its nulls are no words
    dealt = docs.select(key, *dict.fromkeys(c for cols in fields.values() for c in cols if c != key)).repartition(key)
    whole = dealt.select(key, F.explode_outer(F.concat(*found)).alias("_w")).select(key, "_w.*").where(~F.col("lexeme").isin(*STOPWORDS))
    whole = whole.withColumn("lexeme", stemmed(F.col("lexeme"))) if stems else whole
    return whole.groupBy(key, "lexeme").agg(F.max("weight").alias("weight"))


def lexemes(query: str, stems: bool = False) -> list[str]:
    """The distinct lexemes of a query, as postings cut them."""
    import re

    out = [w for w in re.split("[^a-z0-9]+", query.lower()) if w and w not in STOPWORDS]
    if stems:
        out = [reduce(lambda w, e: re.sub(e[0], e[1].replace("$1", r"\1"), w), ENDINGS, w) if len(w) > 3 else w for w in out]
    return list(dict.fromkeys(out))


def match(index: DataFrame, key: str, query: str, stems: bool = False) -> DataFrame:
    """(key, rank) of documents that hold every lexeme of the query; the filter on lexemes reaches the index's scan."""
    asked = lexemes(query, stems)
    if not asked:
        return index.select(key).limit(0).select(key, F.lit(0.0).alias("rank"))
    found = index.where(F.col("lexeme").isin(*asked)).groupBy(key).agg(F.count("*").alias("_n"), F.round(F.sum("weight"), 6).alias("rank"))
    return found.where(F.col("_n") == len(asked)).select(key, "rank")


def similar(docs: DataFrame, key: str, text: str, query: str, above: float = SIMILARITY) -> DataFrame:
    """(key, similarity) of texts whose trigram similarity with the query is above the threshold."""
    asked = trigrams(F.lit(query))
    own = docs.select(key, trigrams(F.col(text)).alias("g"))
    shared = F.size(F.array_intersect("g", asked))
    score = shared / F.greatest(F.lit(1), F.size("g") + F.size(asked) - shared)
    return own.select(key, F.round(score, 6).alias("similarity"), score.alias("_s")).where(F.col("_s") > above).drop("_s")


def similar_pairs(docs: DataFrame, key: str, text: str, above: float) -> DataFrame:
    """Pairs of distinct texts whose trigram similarity is above the threshold.

    Trigrams are ordered, the rare ones first. Two sets of n and m trigrams that share more than above * max(n, m) share
    one of the first n - ceil(above n) + 1 and m - ceil(above m) + 1 in that order, so only those meet, and only sets
    whose sizes can be that similar. Texts of one common trigram are not compared for it."""
    own = docs.groupBy(F.col(text).alias("t")).agg(F.min(key).alias("k")).withColumn("g", trigrams(F.col("t"))).where(F.size("g") > 0)
    own = materialise(own.select("k", "g"))
    each = own.select("k", F.size("g").alias("n"), F.explode("g").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("c"))
    ordered = each.join(counts, "gram").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("o"))
    head = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * above - 1e-9).cast("int") + 1)
    first = ordered.select("k", "n", F.explode(F.transform(head, lambda x: x["gram"])).alias("gram"))
    a, b = (first.select("gram", F.col("k").alias(f"k{s}"), F.col("n").alias(f"n{s}")) for s in "12")
    near = (F.col("k1") < F.col("k2")) & (F.col("n1") >= F.col("n2") * above) & (F.col("n2") >= F.col("n1") * above)
    met = a.join(b, "gram").where(near).select("k1", "k2").distinct()
    sets = lambda s: own.select(F.col("k").alias(f"k{s}"), F.col("g").alias(f"g{s}"))
    both = met.join(sets(1), "k1").join(sets(2), "k2").withColumn("c", F.size(F.array_intersect("g1", "g2")))
    score = F.col("c") / (F.size("g1") + F.size("g2") - F.col("c"))
    return both.where(score > above).select("k1", "k2", F.round(score, 6).alias("similarity"))


def search(docs: DataFrame, index: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Matches by lexemes; if there are none, texts that are similar, all with rank 1. One lazy plan: the fallback is
    kept only if the count of matches, a single row, is 0."""
    hits = match(index, key, query)
    none = hits.agg((F.count("*") == 0).alias("_none"))
    fallback = similar(docs, key, text, query).select(key, F.lit(1.0).alias("rank"))
    return hits.unionAll(fallback.join(F.broadcast(none.where("_none")), how="left_semi"))


def sort_order(how: str, query: str = "") -> list[Column]:
    """The order of search results: by relevance (only with a query), newest, name, or else quality."""
    if how == "relevance" and query:
        return [F.desc("rank"), F.desc("quality_score"), F.asc("app_id")]
    if how == "newest":
        return [F.desc("first_seen_at"), F.asc("app_id")]
    if how == "name":
        return [F.asc("name"), F.asc("app_id")]
    return [F.desc("quality_score"), F.desc("first_seen_at"), F.asc("app_id")]
