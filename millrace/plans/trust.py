"""Trusted back-fills, merge plans and repairs over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import apply, trust
from ..tables import Tables
from .registry import query

#: Suppliers are sources: even nations are of type 'dir'; customers are apps with links made of their segment.
_DIRECTORIES = {"dir": {"dir.example": "/apps"}}
_SQL = """WITH src AS (SELECT s_suppkey AS app_id, CASE WHEN s_nationkey % 2 = 0 THEN 'dir' ELSE 'registry' END AS source_type, s_acctbal > 0 AS is_active FROM supplier),
lnk AS (SELECT c_custkey AS app_id, CASE WHEN c_nationkey % 3 = 0 THEN 'https://dir.example/apps/' || c_custkey WHEN c_nationkey % 3 = 1 THEN 'https://dir.example/other' ELSE '' END AS u FROM customer),
found AS (SELECT DISTINCT app_id FROM src JOIN lnk USING (app_id) WHERE source_type = 'dir' AND is_active AND starts_with(u, 'https://dir.example/apps'))
"""


def _found(t: Tables) -> DataFrame:
    sources = t.supplier.select(F.col("s_suppkey").alias("app_id"), F.when(F.col("s_nationkey") % 2 == 0, "dir").otherwise("registry").alias("source_type"), (F.col("s_acctbal") > 0).alias("is_active"))
    url = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("https://dir.example/apps/"), "c_custkey")).when(F.col("c_nationkey") % 3 == 1, "https://dir.example/other").otherwise("")
    links = t.customer.select(F.col("c_custkey").alias("app_id"), url.alias("official_directory_url"))
    return trust.trusted(links, sources, links, _DIRECTORIES)


def _apps(t: Tables) -> DataFrame:
    status = F.when(F.col("c_acctbal") > 3000, "official").otherwise("unknown")
    return t.customer.select(F.col("c_custkey").alias("app_id"), status.alias("verification"))


@query(_SQL + "SELECT c_custkey AS app_id, 'official' AS planned FROM customer WHERE c_acctbal <= 3000 AND c_custkey IN (SELECT app_id FROM found)")
def trust_verification(t: Tables) -> DataFrame:
    return trust.verification_backfill(_found(t), _apps(t)).select("app_id", "planned")


@query(
    _SQL
    + """, k AS (SELECT o_custkey AS app_id, max(o_orderstatus) AS s FROM orders GROUP BY ALL),
    d AS (SELECT * FROM (VALUES ('read', 'yes'), ('write', 'no')) v(capability, target)),
    v AS (SELECT app_id, 'read' AS capability, CASE s WHEN 'P' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'unknown' END AS value FROM k)
    SELECT f.app_id, d.capability, d.target, CASE WHEN v.value IS NULL THEN 'plan' ELSE 'skip' END AS action FROM found f CROSS JOIN d
    LEFT JOIN (SELECT * FROM v WHERE value <> 'unknown') v ON v.app_id = f.app_id AND v.capability = d.capability WHERE v.value IS NULL OR v.value <> d.target"""
)
def trust_capabilities(t: Tables) -> DataFrame:
    value = F.when(F.col("s") == "P", "yes").when(F.col("s") == "O", "no").otherwise("unknown")
    known = t.orders.groupBy(F.col("o_custkey").alias("app_id")).agg(F.max("o_orderstatus").alias("s")).select("app_id", F.lit("read").alias("capability"), value.alias("value"))
    return trust.capability_backfill(_found(t), known, {"read": "yes", "write": "no"})


_MEANWHILE = "CASE WHEN c_custkey % 4 = 0 AND c_acctbal <= 3000 THEN 'listed' WHEN c_acctbal > 3000 THEN 'official' ELSE 'unknown' END"


def _applied(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The plan of verifications applied to apps of which some changed and some went since it was made."""
    apps = _apps(t)
    plan = apply.made_from(trust.verification_backfill(_found(t), apps).select("app_id", "planned"), apps, ["app_id"], ["verification"])
    now = apps.where("app_id % 9 <> 0").withColumn("verification", F.when((F.col("app_id") % 4 == 0) & (F.col("verification") == "unknown"), "listed").otherwise(F.col("verification")))
    return apply.applied_if_same(now, plan, ["app_id"], ["verification"], {"verification": "planned"})


@query(
    _SQL
    + f"""SELECT c_custkey AS app_id, CASE WHEN c_acctbal <= 3000 AND c_custkey % 4 <> 0 AND c_custkey IN (SELECT app_id FROM found) THEN 'official' ELSE {_MEANWHILE} END AS verification
    FROM customer WHERE c_custkey % 9 <> 0"""
)
def trust_verification_applied(t: Tables) -> DataFrame:
    return _applied(t)[0]


@query(
    _SQL
    + """SELECT c_custkey AS app_id, CASE WHEN c_custkey % 9 = 0 THEN 'gone' ELSE 'changed' END AS reason FROM customer
    WHERE c_acctbal <= 3000 AND c_custkey IN (SELECT app_id FROM found) AND (c_custkey % 9 = 0 OR c_custkey % 4 = 0)"""
)
def trust_verification_skipped(t: Tables) -> DataFrame:
    """Planned rows that are not what the plan was made from any more."""
    return _applied(t)[1]


@query(
    _SQL
    + """SELECT c_custkey AS app_id, 'dev' AS planned FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 5000 AND c_custkey IN (SELECT app_id FROM found)
    UNION ALL SELECT c_custkey, 'home' FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey IN (SELECT app_id FROM found)"""
)
def trust_categories(t: Tables) -> DataFrame:
    raw = t.customer.select(F.col("c_custkey").alias("app_id"), F.concat(F.lit(" "), "c_mktsegment").alias("label"))
    existing = t.customer.where("c_acctbal >= 5000").select(F.col("c_custkey").alias("app_id"), F.lit("dev").alias("category"))
    found = trust.category_backfill(_found(t), raw, existing, {"building": "dev", "household": "home"})
    return found.select("app_id", F.concat_ws(",", "planned").alias("planned"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bin beta\\b|\\bpublic beta\\b') THEN 'beta' WHEN regexp_matches(lower(text), '\\bwaitlist\\b') THEN 'waitlist' ELSE 'live' END AS planned FROM documents")
def trust_launch_status(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", trust.launch_from_text(F.col("text")).alias("planned"))


@query(
    """WITH s AS (SELECT l_partkey AS app_id, list(DISTINCT l_linenumber) AS t FROM lineitem GROUP BY ALL)
    SELECT app_id, CASE WHEN list_contains(t, 6) AND list_contains(t, 7) THEN '6,7' WHEN list_contains(t, 6) THEN '6' ELSE '7' END AS planned_remove
    FROM s WHERE (list_contains(t, 6) OR list_contains(t, 7)) AND list_contains(t, 1)"""
)
def trust_taxonomy(t: Tables) -> DataFrame:
    types = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_linenumber").cast("string").alias("listing_type"))
    out = trust.taxonomy_repair(types.select("app_id").distinct(), types, ("6", "7"), ("1",))
    return out.select("app_id", F.concat_ws(",", "planned_remove").alias("planned_remove"))


@query(
    """WITH g AS (SELECT p_name, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY ALL HAVING count(*) > 1),
    p AS (SELECT a AS pair_id, a, b, CASE WHEN a % 3 = 0 THEN 'exact_url' ELSE 'exact_name' END AS reason, CASE WHEN a % 4 = 0 THEN 'dismissed' ELSE 'pending' END AS status FROM g),
    c AS (SELECT l_partkey AS app_id, l_linenumber AS cap, max(CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'unknown' END) AS v FROM lineitem GROUP BY ALL),
    k AS (SELECT pair_id, 'capability_conflict:' || x.cap AS code FROM p JOIN c x ON x.app_id = a JOIN c y ON y.app_id = b AND y.cap = x.cap WHERE x.v <> 'unknown' AND y.v <> 'unknown' AND x.v <> y.v),
    kk AS (SELECT pair_id, string_agg(code, ',' ORDER BY code) AS codes FROM k GROUP BY ALL),
    s AS (SELECT p.*, concat_ws(',', CASE WHEN status <> 'pending' THEN 'duplicate_not_pending' END, CASE WHEN reason <> 'exact_name' THEN 'unsupported_match_reason:' || reason END,
      CASE WHEN x.p_size < 10 OR y.p_size < 10 THEN 'requires_two_drafts' END, CASE WHEN x.p_type = 'LARGE' OR y.p_type = 'LARGE' THEN 'guarded_identity' END, codes) AS blockers
      FROM p JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b LEFT JOIN kk USING (pair_id))
    SELECT pair_id, a, b, blockers, blockers = '' AS would_merge FROM s"""
)
def merge_plan(t: Tables) -> DataFrame:
    from .views import capabilities

    pairs = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b")).where("a < b")
    pairs = pairs.select(F.col("a").alias("pair_id"), "a", "b", F.when(F.col("a") % 3 == 0, "exact_url").otherwise("exact_name").alias("reason"), F.when(F.col("a") % 4 == 0, "dismissed").otherwise("pending").alias("status"))
    apps = t.part.select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") >= 10, "draft").otherwise("published").alias("status"), (F.col("p_type") == "LARGE").alias("guarded"))
    return trust.merge_plan(pairs, apps, capabilities(t), ("exact_name",)).withColumn("blockers", F.concat_ws(",", "blockers"))


@query(
    """WITH s AS (SELECT o_custkey AS app_id, o_orderkey AS source_id FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT app_id, source_id, source_id = min(source_id) OVER (PARTITION BY app_id) AS keeps FROM s QUALIFY count(*) OVER (PARTITION BY app_id) > 1"""
)
def split_sources(t: Tables) -> DataFrame:
    return trust.split_plan(t.orders.select(F.col("o_custkey").alias("app_id"), F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("source_type")), "1-URGENT")


@query("SELECT event_id, user_id AS app_id, event_type AS link_type, user_id IN (SELECT s_suppkey FROM supplier) AND event_type = 'click' AS valid FROM events")
def link_attribution(t: Tables) -> DataFrame:
    clicks = t.events.select("event_id", F.col("user_id").alias("app_id"), F.col("event_type").alias("link_type"), F.concat(F.lit("u"), "user_id").alias("url"))
    links = t.supplier.select(F.col("s_suppkey").alias("app_id"), F.lit("click").alias("link_type"), F.concat(F.lit("u"), "s_suppkey").alias("url"))
    return trust.attributed(clicks, links).select("event_id", "app_id", "link_type", "valid")


@query("SELECT r_name AS kind, string_agg(n_name, ',' ORDER BY n_name) AS slugs FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def taxonomy_snapshot(t: Tables) -> DataFrame:
    dims = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return trust.taxonomy(dims, "r_name", "n_name").select(F.col("r_name").alias("kind"), F.concat_ws(",", "slugs").alias("slugs"))
