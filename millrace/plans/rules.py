"""Rules, scores, duplicates and merges over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import named_failures
from ..operators import identity, merge, rank, relational as rel, rules
from ..tables import Tables
from . import views
from .registry import query

_FACTS = """WITH o AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p,
    max(o_orderdate) AS last FROM orders GROUP BY ALL),
f AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, c_name, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(p, 0) AS p, last FROM customer LEFT JOIN o ON k = c_custkey)
"""


def _facts(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.count_if(status == "F").alias("f"), F.count_if(status == "P").alias("p"), F.max("o_orderdate").alias("last")
    )
    return t.customer.join(o, "c_custkey", "left").fillna(0, ["n", "f", "p"])


@query(
    _FACTS
    + """SELECT c_custkey, greatest(0, least(100,
      15 * (c_nationkey % 2 = 0)::INT + 10 * (c_acctbal > 5000)::INT + 10 * (c_mktsegment = 'BUILDING')::INT + 15 * (n > 0 AND f > 0)::INT + 10 * (c_acctbal > 0)::INT
      + 10 * (n >= 5)::INT + 10 * (f >= 5)::INT + 5 + 5 * (c_nationkey < 12)::INT + 5 * coalesce(last > TIMESTAMP '2001-07-02', false)::INT + 5 * (c_nationkey > 3)::INT
      - 10 * (c_acctbal < -900)::INT - 10 * (n = 0)::INT - 5 * (p > 0)::INT)) AS score FROM f"""
)
def rule_quality_score(t: Tables) -> DataFrame:
    facts = _facts(t).select(
        "c_custkey",
        (F.col("c_nationkey") % 2 == 0).alias("is_official"),
        (F.col("c_acctbal") > 5000).alias("is_reviewed"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_claimed"),
        (F.col("n") > 0).alias("has_page"),
        (F.col("f") > 0).alias("has_install"),
        (F.col("c_acctbal") > 0).alias("has_verdict"),
        F.col("n").alias("n_use_cases"),
        F.col("f").alias("n_explicit_capabilities"),
        F.lit(True).alias("has_developer"),
        (F.col("c_nationkey") < 12).alias("has_logo"),
        F.col("last").alias("last_checked_at"),
        (F.col("c_nationkey") > 3).alias("has_repo"),
        (F.col("c_acctbal") < -900).alias("is_deprecated"),
        F.col("n").alias("n_curated_sources"),
        F.col("p").alias("n_link_failures"),
    )
    return facts.select("c_custkey", rank.quality_score(facts, F.lit("2001-08-01").cast("timestamp_ntz")).alias("score"))


@query(
    """WITH s AS (SELECT s_suppkey, s_nationkey, s_name, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_linenumber) AS lines, count(DISTINCT l_returnflag) AS flags,
      count(DISTINCT l_linestatus) AS states FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT s_suppkey, 20 * parts + 15 * lines + 10 * flags + 5 * states + 8 * (s_nationkey < 5)::INT + 5 * (s_nationkey > 20)::INT + length(s_name) // 20 AS score FROM s"""
)
def canonical_score(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        *(F.count_distinct(c).alias(n) for c, n in (("l_partkey", "parts"), ("l_linenumber", "lines"), ("l_returnflag", "flags"), ("l_linestatus", "states")))
    )
    both = t.supplier.join(by, "s_suppkey", "left").fillna(0, ["parts", "lines", "flags", "states"])
    flags = [(F.col("s_nationkey") < 5, 8), (F.col("s_nationkey") > 20, 5)]
    score = rank.canonical_score(F.col("parts"), F.col("lines"), F.col("flags"), F.col("states"), flags, F.col("s_name"))
    return both.select("s_suppkey", score.alias("score"))


_BLOCKERS = """b AS (SELECT c_custkey, c_mktsegment, list_filter([CASE WHEN n = 0 THEN 'no_source' END, CASE WHEN f < 3 THEN 'few_capabilities' END,
    CASE WHEN c_acctbal < 0 THEN 'bad_verdict' END, CASE WHEN p >= 3 THEN 'conflict' END, CASE WHEN c_nationkey NOT IN (1,2,3,4,5,6,7,8,9,10,11,12) THEN 'region' END],
    lambda x: x IS NOT NULL) AS blockers FROM f)
"""


def _decisions(t: Tables) -> DataFrame:
    return rules.decided(
        _facts(t),
        [
            ("no_source", F.col("n") == 0),
            ("few_capabilities", F.col("f") < 3),
            ("bad_verdict", F.col("c_acctbal") < 0),
            ("conflict", F.col("p") >= 3),
            ("region", ~F.col("c_nationkey").isin(*range(1, 13))),
        ],
    )


@query(_FACTS + "," + _BLOCKERS + "SELECT c_custkey, array_to_string(blockers, ',') AS blockers, len(blockers) = 0 AS allowed FROM b")
def autopublish_decisions(t: Tables) -> DataFrame:
    return _decisions(t).select("c_custkey", F.concat_ws(",", "blockers").alias("blockers"), "allowed")


@query(_FACTS + "," + _BLOCKERS + "SELECT blocker, count(*) AS n FROM (SELECT unnest(blockers) AS blocker FROM b) GROUP BY ALL")
def blocker_histogram(t: Tables) -> DataFrame:
    return rules.blocker_counts(_decisions(t))


@query(_FACTS + "," + _BLOCKERS + "SELECT count(*) AS evaluated, count(*) FILTER (len(blockers) = 0) AS would_publish FROM b")
def autopublish_report(t: Tables) -> DataFrame:
    return rules.decision_report(_decisions(t), "would_publish")


@query(
    """WITH d AS (SELECT doc_id, length(trim(substr(text, 1, 70), ' ')) AS s, length(trim(text, ' ')) AS l, quality, toxic, lang FROM documents LEFT JOIN labels USING (doc_id)),
    e AS (SELECT *, s >= 20 AND l >= 60 AS compact FROM d)
    SELECT doc_id, concat_ws(',', CASE WHEN s < 60 AND NOT compact THEN 'short_description_too_short' END, CASE WHEN coalesce(quality, 0) = 0 THEN 'no_platform' END,
      CASE WHEN toxic = 1 THEN NULL WHEN toxic IS NULL THEN 'no_category' ELSE NULL END,
      CASE WHEN length(lang) < CASE WHEN compact THEN 2 ELSE 3 END THEN 'few_capabilities' END) AS missing FROM e"""
)
def publish_checklist(t: Tables) -> DataFrame:
    both = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.lit("x").alias("name"),
        F.substring("text", 1, 70).alias("short_description"),
        F.col("text").alias("long_description"),
        F.col("quality").alias("n_platforms"),
        F.when(F.col("toxic").isNotNull(), 1).alias("n_categories"),
        F.length("lang").alias("n_capabilities"),
        F.lit("https://a.example").alias("official_page_url"),
        F.lit("").alias("install_url"),
        F.lit("y").alias("developer_name"),
    )
    return rules.decided(both, rules.publish_rules()).select("doc_id", F.concat_ws(",", "blockers").alias("missing"))


@query("SELECT p_name AS name, min(p_partkey) AS app_id FROM part GROUP BY ALL")
def keep_first_dedup(t: Tables) -> DataFrame:
    named = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("app_id"))
    return rel.first_by(named, ["name"], F.asc("app_id"))


@query(
    f"""WITH q(a, b, score) AS ({views.ratios_sql(views.part_names(), views.part_names(), identity.WEAK_WITH_DOMAIN)}),
    n AS (SELECT p_name AS name, min(p_partkey) AS id, min(p_brand) AS brand FROM part GROUP BY ALL),
    p AS (SELECT x.id AS id1, y.id AS id2, score FROM n x JOIN n y ON x.id <> y.id JOIN q ON a = y.name AND b = x.name WHERE score >= {identity.WEAK} OR x.brand = y.brand)
    SELECT id1, id2, score, CAST(row_number() OVER (PARTITION BY id1 ORDER BY score DESC, id2) AS INTEGER) AS rank FROM p QUALIFY rank <= 5"""
)
def weak_top5(t: Tables) -> DataFrame:
    """For each name the five most similar names, of one brand or very similar."""
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("brand"))
    a, b = (names.select(*(F.col(c).alias(c + s) for c in ("id", "p_name", "brand"))) for s in "12")
    branded = a.join(b, F.col("brand1") == F.col("brand2")).where("id1 <> id2").select("id1", "id2")
    pairs = branded.union(identity.close_pairs(names, "id", "p_name")).distinct().join(a, "id1").join(b, "id2")
    same = F.coalesce(F.col("brand1") == F.col("brand2"), F.lit(False))
    return identity.weak_matches(pairs, "id1", "id2", F.col("p_name2"), F.col("p_name1"), same).select("id1", "id2", "score", "rank")


_DRAFTED = ("small", "red", "blue", "hot", "green", "cold")


@query(
    f"""WITH alike(dn, an, ratio) AS ({views.ratios_sql([f"{x} ring" for x in _DRAFTED], views.part_names(), identity.STRONG)}),
    d AS (SELECT c_custkey AS draft_id, c_custkey % 4 AS m, {list(_DRAFTED)}[c_custkey % 6 + 1] || ' ring' AS dn, c_custkey AS k FROM customer),
    a AS (SELECT p_partkey AS app_id, p_partkey % 4 AS m, p_name AS an, p_partkey AS k, p_size FROM part),
    x AS (SELECT draft_id, app_id, p_size, 1 AS kind FROM d JOIN a ON d.m = 0 AND a.m = 0 AND d.k % 50 = a.k % 50
      UNION ALL SELECT draft_id, app_id, p_size, 2 FROM d JOIN a ON d.m = 1 AND a.m = 1 AND d.k % 70 = a.k % 70
      UNION ALL SELECT draft_id, app_id, p_size, 3 FROM d JOIN a ON d.m = 2 AND a.m = 2 AND d.k % 25 = a.k % 25 JOIN alike USING (dn, an)
      UNION ALL SELECT draft_id, app_id, p_size, 4 FROM d JOIN a ON dn = an),
    r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY p_size DESC, app_id, kind) AS r FROM x)
    SELECT draft_id, app_id, kind FROM r WHERE r = 1"""
)
def first_match_wins(t: Tables) -> DataFrame:
    """All drafts against apps: the first app by quality that shares a repository, an address, the developer's domain and a
    similar name, or a slug."""

    def addresses(key: Column, repo: str, page: str, home: str, variant: str) -> dict[str, Column]:
        of = lambda m, n, head, tail: F.when(key % 4 == m, F.concat(F.lit(head), (key % n).cast("string"), F.lit(tail))).otherwise("")
        none = {c: F.lit("") for c in identity.URLS}
        return none | {"repo_url": of(0, 50, repo, "/" + variant), "official_page_url": of(1, 70, page, ".example/Path/"), "developer_url": of(2, 25, "https://dev", home)}

    own, key = F.col("c_custkey"), F.col("p_partkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, _DRAFTED)), (own % 6 + 1).cast("int")), F.lit(" ring"))
    drafts = t.customer.select(own.alias("draft_id"), name.alias("name"), F.lit("").alias("slug_hint"), *(v.alias(c) for c, v in addresses(own, "https://github.com/Org", "https://www.site", ".example/team", "tool.git").items()))
    apps = t.part.select(key.alias("app_id"), F.col("p_name").alias("name"), F.lit("").alias("slug_hint"), "p_size", *(v.alias(c) for c, v in addresses(key, "http://github.com/org", "http://site", ".example/", "Tool/issues").items()))
    return identity.strong_matches(drafts, apps, [F.desc("p_size")])


@query(
    """WITH d AS (SELECT c_custkey AS draft_id, ['small','red','blue','hot','green'][c_custkey % 5 + 1] || ' ring' AS name FROM customer),
    b AS (SELECT p_name AS name, p_partkey AS app_id, 4 AS kind FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) = 1)
    SELECT draft_id, app_id, kind FROM d JOIN b USING (name)"""
)
def first_match_wins_all(t: Tables) -> DataFrame:
    """All drafts against apps by slugs alone."""
    none = {c: F.lit("") for c in identity.URLS}
    first = F.element_at(F.array(*map(F.lit, _DRAFTED)), (F.col("c_custkey") % 5 + 1).cast("int"))
    drafts = t.customer.select(F.col("c_custkey").alias("draft_id"), F.concat(first, F.lit(" ring")).alias("name"), F.lit("").alias("slug_hint"))
    apps = t.part.select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.lit("").alias("slug_hint"), "p_size")
    return identity.strong_matches(drafts.withColumns(none), apps.withColumns(none), [F.desc("p_size")])


@query(
    """WITH m AS (SELECT p_partkey AS source, (p_partkey // 10) * 10 AS target FROM part WHERE p_partkey % 10 IN (1, 2)),
    r AS (SELECT coalesce(target, l_partkey) AS app_id, l_suppkey AS use_case, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem LEFT JOIN m ON source = l_partkey GROUP BY ALL)
    SELECT app_id, use_case, id FROM r"""
)
def usecase_merge(t: Tables) -> DataFrame:
    moves = t.part.where("p_partkey % 10 in (1, 2)").select(F.col("p_partkey").alias("source"), (F.floor(F.col("p_partkey") / 10) * 10).cast("bigint").alias("target"))
    rows = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_suppkey").alias("use_case"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return identity.repointed(rows, "app_id", "use_case", moves)


@query(
    """WITH r AS (SELECT o_custkey % 100 AS owner, o_orderkey AS id, o_orderstatus = 'P' AS p FROM orders),
    f AS (SELECT owner, min(id) AS first FROM r WHERE p GROUP BY ALL)
    SELECT owner, id, coalesce(id = first, false) AS is_primary FROM r LEFT JOIN f USING (owner)"""
)
def primary_flag_keep(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 100).alias("owner"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("is_primary"))
    return identity.one_primary(rows, "owner")


@query(
    """WITH s AS (SELECT p_name, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY ALL HAVING count(*) > 1),
    q AS (SELECT a, b, x.p_size AS sa, y.p_size AS sb FROM s JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b)
    SELECT a, b, CASE WHEN sa >= sb THEN a ELSE b END AS target, CASE WHEN sa >= sb THEN b ELSE a END AS source FROM q"""
)
def merge_targets(t: Tables) -> DataFrame:
    pairs = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b")).where("a < b").select("a", "b")
    size = lambda k: t.part.select(F.col("p_partkey").alias(k), F.col("p_size").alias("s" + k))
    return identity.merge_target(pairs.join(size("a"), "a").join(size("b"), "b"), "a", "b", "sa", "sb").select("a", "b", "target", "source")


@query(
    """WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-15') AS b, list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-15') AS a FROM events GROUP BY ALL)
    SELECT user_id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS added,
    array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS removed FROM s"""
)
def set_added_removed(t: Tables) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(~late, F.col("event_type"))).alias("b"), F.collect_set(F.when(late, F.col("event_type"))).alias("a"))
    added, removed = rel.added_removed(F.col("b"), F.col("a"))
    return sets.select("user_id", F.concat_ws(",", added).alias("added"), F.concat_ws(",", removed).alias("removed"))


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING bool_and(event_type IN ('view', 'click', 'purchase', 'signup'))")
def subset_dismiss(t: Tables) -> DataFrame:
    sets = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.collect_set("event_type").alias("s"))
    return sets.where(rel.only_within(F.col("s"), F.array(*map(F.lit, ("view", "click", "purchase", "signup"))))).select("user_id", "day")


@query(
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') || [lower(p_type)] || string_split(p_name, ' ') AS l FROM part),
    u AS (SELECT p_partkey, x, min(i) AS i FROM (SELECT p_partkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w) GROUP BY ALL)
    SELECT p_partkey, string_agg(x, ',' ORDER BY i) AS tags FROM u GROUP BY ALL"""
)
def ordered_union(t: Tables) -> DataFrame:
    name = F.split("p_name", " ")
    return t.part.select("p_partkey", F.concat_ws(",", rel.ordered_union(name, F.array(F.lower("p_type")), name)).alias("tags"))


@query(
    """SELECT page_id, concat_ws(',', CASE WHEN NOT starts_with(url, 'https') THEN 'insecure' END, CASE WHEN contains(url, '#') THEN 'fragment' END,
    CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN length(html) < 1500 THEN 'thin' END) AS reasons FROM pages"""
)
def eligibility_reasons(t: Tables) -> DataFrame:
    url = F.col("url")
    reasons = named_failures([("insecure", ~url.startswith("https")), ("fragment", url.contains("#")), ("query", url.contains("?")), ("thin", F.length("html") < 1500)])
    return t.pages.select("page_id", F.concat_ws(",", reasons).alias("reasons"))


@query(
    """SELECT page_id, CASE WHEN contains(url, '#') THEN NULL WHEN contains(url, '?') THEN string_split(url, '?')[1] ELSE url END AS fetch_url FROM pages"""
)
def fetch_url_choice(t: Tables) -> DataFrame:
    """The address to fetch: the first that is not blank of the clean one and the one without its query."""
    url = F.col("url")
    clean = F.when(~url.contains("#") & ~url.contains("?"), url)
    cut = F.when(~url.contains("#") & url.contains("?"), F.substring_index(url, "?", 1))
    return t.pages.select("page_id", F.coalesce(clean, cut).alias("fetch_url"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS segment FROM customer"""
)
def fill_empty_merge(t: Tables) -> DataFrame:
    name = F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name"))
    segment = F.when(F.col("c_nationkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    current = t.customer.select("c_custkey", name.alias("name"), segment.alias("segment"))
    proposed = t.customer.select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("c_name").alias("segment"))
    return merge.fill_empty(current, proposed, "c_custkey", ["name", "segment"])


@query(
    """SELECT c_custkey, 'segment' AS field, CASE WHEN c_acctbal < 0 THEN 'fill' ELSE 'review' END AS action FROM customer WHERE c_nationkey % 2 = 0
    UNION ALL SELECT c_custkey, 'nation', 'review' FROM customer WHERE c_nationkey <> 7"""
)
def merge_actions(t: Tables) -> DataFrame:
    current = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    proposed = t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit("!"))).otherwise("").alias("segment"), F.lit("7").alias("nation"))
    return merge.merge_actions(current, proposed, "c_custkey", ["segment", "nation"]).select("c_custkey", "field", "action")


@query(
    """SELECT event_id, k AS first, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS kept, event_type AS added FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"""
)
def metadata_map_merge(t: Tables) -> DataFrame:
    """Shallow merge of two maps, the existing value first."""
    from ..functions.values import merged_map

    old = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("old"))).otherwise(F.create_map().cast("map<string,string>"))
    new = F.create_map(F.lit("a"), F.lit("new"), F.lit("t"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    m = t.events.select("event_id", merged_map(old, new).alias("m"))
    return m.select("event_id", F.col("m")["k"].cast("bigint").alias("first"), F.col("m")["a"].alias("kept"), F.col("m")["t"].alias("added"))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_name AS name FROM customer WHERE c_custkey % 10 <> 1),
    b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment, c_name AS name FROM customer WHERE c_custkey % 10 <> 2)
    SELECT k, 'segment' AS field, a.segment AS before, b.segment AS after FROM a FULL JOIN b USING (k) WHERE a.segment IS DISTINCT FROM b.segment
    UNION ALL SELECT k, 'name', a.name, b.name FROM a FULL JOIN b USING (k) WHERE a.name IS DISTINCT FROM b.name"""
)
def drift_diff(t: Tables) -> DataFrame:
    own = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    now = own.where("k % 10 <> 2").withColumn("segment", F.when(F.col("k") % 7 == 0, "OTHER").otherwise(F.col("segment")))
    return merge.drift(own.where("k % 10 <> 1"), now, "k", ["segment", "name"])


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'lang' WHEN 1 THEN 'source' ELSE 'page_url' END AS field,
      CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/x' ELSE 'nowhere' END END AS value,
      (doc_id % 10) / 10.0::DOUBLE + 0.2 AS confidence, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'said' END AS evidence FROM documents)
    SELECT doc_id, field, CASE WHEN confidence < 0.7 THEN 'low_confidence' WHEN trim(evidence) = '' THEN 'no_evidence'
      WHEN field = 'lang' AND value NOT IN ('en', 'fr') THEN 'unknown_value' WHEN field = 'page_url' AND value = 'nowhere' THEN 'bad_url' END AS dropped FROM p"""
)
def validate_proposals(t: Tables) -> DataFrame:
    k, spark = F.col("doc_id"), t.documents.sparkSession
    allowed = spark.createDataFrame([("lang", "en"), ("lang", "fr")], "field string, value string")
    proposals = t.documents.select(
        "doc_id",
        F.when(k % 3 == 0, "lang").when(k % 3 == 1, "source").otherwise("page_url").alias("field"),
        F.when(k % 3 == 0, F.col("lang")).when(k % 3 == 1, F.col("source")).otherwise(F.when(k % 2 == 0, "https://a.example/x").otherwise("nowhere")).alias("value"),
        ((k % 10) / F.lit(10.0) + F.lit(0.2)).alias("confidence"),
        F.when(k % 13 == 0, " ").otherwise("said").alias("evidence"),
    )
    return merge.validated(proposals, allowed).select("doc_id", "field", "dropped")


@query(
    """SELECT o_custkey AS app_id, array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), ',') AS values FROM orders
    WHERE o_orderpriority = '1-URGENT' GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1"""
)
def queue_conflicts(t: Tables) -> DataFrame:
    """Apps for which the review queue holds different proposals of one field."""
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("app_id"), F.lit("status").alias("field"), "o_orderstatus")
    return rules.conflicting(urgent, "app_id", "field", "o_orderstatus").select("app_id", F.concat_ws(",", "values").alias("values"))


@query(
    f"""SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey < 5 THEN 'official' END, CASE WHEN c_acctbal > 5000 THEN 'reviewed' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'claimed' END) AS badges FROM customer"""
)
def trust_badges(t: Tables) -> DataFrame:
    flags = (F.when(F.col("c_nationkey") < 5, "official"), F.when(F.col("c_acctbal") > 5000, "reviewed"), F.when(F.col("c_mktsegment") == "BUILDING", "claimed"))
    return t.customer.select("c_custkey", F.concat_ws(",", rules.badges(*(F.coalesce(f, F.lit("")) for f in flags))).alias("badges"))


_AUTO = """WITH c AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n_platforms, count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'N') AS n_caps, count(*) FILTER (l_quantity > 49) AS n_bad,
  bool_or(l_suppkey % 50 = 0) AS reg FROM lineitem GROUP BY ALL),
f AS (SELECT p_partkey, p_size, p_partkey % 10 = 0 AS trusted, length(p_name) * 5 AS s, CASE WHEN p_size % 4 = 0 THEN 0 ELSE length(p_name) * 6 END AS l, p_type, p_brand,
  coalesce(n_platforms, 0) AS n_platforms, coalesce(n_caps, 0) AS n_caps, coalesce(n_bad, 0) AS n_bad, coalesce(reg, false) AS reg FROM part LEFT JOIN c ON k = p_partkey)
"""


@query(
    _AUTO
    + """SELECT p_partkey AS app_id, concat_ws(',', CASE WHEN reg THEN 'mcp_source_requires_include_mcp' END, CASE WHEN p_size = 50 THEN 'mcp_platform_requires_include_mcp' END,
    CASE WHEN p_type = 'PROMO' THEN 'mcp_listing_type_requires_include_mcp' END, CASE WHEN trusted AND s < 20 THEN 'short_description_lt_20' END,
    CASE WHEN trusted AND s < 60 AND l < 60 THEN 'long_description_lt_60' END, CASE WHEN NOT trusted AND s < 60 THEN 'short_description_lt_60' END,
    CASE WHEN l = 0 THEN 'long_description_required' END, CASE WHEN p_size % 9 = 0 THEN 'listing_type_required' END, CASE WHEN n_platforms = 0 THEN 'platform_required' END,
    CASE WHEN p_size % 8 = 0 THEN 'category_required' END, CASE WHEN trusted AND n_caps < 2 THEN 'explicit_capabilities_lt_2' END, CASE WHEN NOT trusted AND n_caps < 3 THEN 'explicit_capabilities_lt_3' END,
    CASE WHEN p_size % 7 = 0 THEN 'official_or_install_url_required' END, CASE WHEN p_size % 3 = 0 THEN 'platform_verification_unknown' END,
    CASE WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'official_directory_url_required' END, CASE WHEN p_brand = 'Brand#1' THEN 'deprecated_launch_status' END,
    CASE WHEN n_bad > 0 THEN 'link_health_failures' END, CASE WHEN p_size % 11 = 0 THEN 'pending_duplicate_candidate' END) AS blockers FROM f"""
)
def autopublish_blockers(t: Tables) -> DataFrame:
    """The library's rules over parts joined with counts of their lines."""
    line = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count_distinct("l_suppkey").alias("n_platforms"),
        F.count_distinct(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))).alias("n_capabilities"),
        F.count_if(F.col("l_quantity") > 49).alias("n_failing_links"),
        F.bool_or(F.col("l_suppkey") % 50 == 0).alias("reg"),
    )
    size = F.col("p_size")
    filler = lambda n: F.repeat(F.lit("x"), n.cast("int"))
    facts = t.part.join(line, "p_partkey", "left").select(
        F.col("p_partkey").alias("app_id"),
        F.coalesce("reg", F.lit(False)).alias("has_registry_source"),
        (size == 50).alias("on_registry_platform"),
        (F.col("p_type") == "PROMO").alias("is_registry_type"),
        (F.col("p_partkey") % 10 == 0).alias("trusted"),
        filler(F.length("p_name") * 5).alias("short_description"),
        F.when(size % 4 == 0, "").otherwise(filler(F.length("p_name") * 6)).alias("long_description"),
        F.when(size % 9 == 0, 0).otherwise(1).alias("n_types"),
        "n_platforms",
        F.when(size % 8 == 0, 0).otherwise(1).alias("n_categories"),
        "n_capabilities",
        F.when(size % 7 == 0, "").otherwise("https://a.example").alias("official_page_url"),
        F.lit("").alias("install_url"),
        F.when(size % 3 == 0, "unknown").when(size % 3 == 1, "official").otherwise("listed").alias("verification"),
        (size % 2 == 1).alias("has_directory_url"),
        F.when(F.col("p_brand") == "Brand#1", "deprecated").otherwise("live").alias("launch_status"),
        "n_failing_links",
        F.when(size % 11 == 0, 1).otherwise(0).alias("n_pending_duplicates"),
    )
    return rules.decided(facts, rules.autopublish_rules()).select("app_id", F.concat_ws(",", "blockers").alias("blockers"))


@query(
    """WITH e AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority LIKE '1%' AS odd, CASE o_orderstatus WHEN 'F' THEN 'verdict ' || (o_orderkey % 2) WHEN 'O' THEN 'x' ELSE '' END AS v,
      CASE o_orderkey % 9 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' WHEN 2 THEN 'odd' ELSE '' END AS p, CASE o_orderkey % 13 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'beta' WHEN 2 THEN 'none' WHEN 3 THEN 'live' ELSE '' END AS s,
      o_orderkey % 31 = 0 AS skipped FROM orders),
    a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'verdict 1' ELSE '' END AS av, CASE WHEN c_custkey % 3 = 0 THEN 'free' ELSE 'unknown' END AS ap FROM customer),
    b AS (SELECT * FROM e JOIN a USING (k)),
    f AS (SELECT k, min(id) FILTER (NOT odd AND av = '' AND length(v) > 3) AS vi, min(id) FILTER (NOT odd AND ap = 'unknown' AND p IN ('free', 'paid')) AS pi FROM b GROUP BY k),
    g AS (SELECT f.*, x.v AS fv, y.p AS fp FROM f LEFT JOIN b x ON x.id = vi AND x.k = f.k LEFT JOIN b y ON y.id = pi AND y.k = f.k),
    c AS (SELECT b.k, unnest([CASE WHEN odd THEN 'unsafe_review_kind:other' END, CASE WHEN NOT odd AND skipped THEN 'review_has_skipped_updates' END,
      CASE WHEN NOT odd AND av <> '' AND v <> '' AND v <> av THEN 'review_would_overwrite_verdict' END, CASE WHEN NOT odd AND av = '' AND v <> '' AND id > vi AND v <> fv THEN 'review_conflicting_verdict' END,
      CASE WHEN NOT odd AND s = 'none' THEN 'invalid_launch_status' END, CASE WHEN NOT odd AND s = 'deprecated' THEN 'review_proposes_deprecated' END,
      CASE WHEN NOT odd AND s = 'beta' THEN 'review_would_change_launch_status' END, CASE WHEN NOT odd AND p = 'odd' THEN 'invalid_pricing_model' END,
      CASE WHEN NOT odd AND p IN ('free', 'paid') AND p <> ap AND ap <> 'unknown' THEN 'review_would_overwrite_pricing_model' END,
      CASE WHEN NOT odd AND p IN ('free', 'paid') AND ap = 'unknown' AND id > pi AND p <> fp THEN 'review_conflicting_pricing_model' END]) AS code FROM b JOIN g USING (k))
    SELECT g.k AS app_id, coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM c WHERE c.k = g.k), '') AS blockers, fv AS verdict, fp AS pricing_model FROM g"""
)
def review_plans(t: Tables) -> DataFrame:
    """Orders as review entries of customers."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    entries = t.orders.select(
        F.col("o_custkey").alias("app_id"),
        key.alias("entry_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "other").otherwise("enriched").alias("kind"),
        (key % 31 == 0).alias("skipped"),
        F.when(status == "F", F.concat(F.lit("verdict "), key % 2)).when(status == "O", "x").alias("verdict"),
        F.when(key % 13 == 0, "deprecated").when(key % 13 == 1, "beta").when(key % 13 == 2, "none").when(key % 13 == 3, "live").alias("launch_status"),
        F.when(key % 9 == 0, "free").when(key % 9 == 1, "paid").when(key % 9 == 2, "odd").alias("pricing_model"),
    )
    own = F.col("c_custkey")
    apps = t.customer.select(own.alias("app_id"), F.when(own % 4 == 0, "verdict 1").otherwise("").alias("verdict"), F.lit("live").alias("launch_status"), F.when(own % 3 == 0, "free").otherwise("unknown").alias("pricing_model"))
    plans = rules.review_plans(entries, apps, ("live", "beta", "deprecated"), ("free", "paid", "unknown"), F.length("verdict") > 3)
    return plans.select("app_id", F.concat_ws(",", "blockers").alias("blockers"), "verdict", "pricing_model")
