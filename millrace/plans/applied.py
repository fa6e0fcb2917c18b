"""Plans and drafts applied to tables that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import apply, identity
from ..operators.state import budget_gates
from ..sinks import tables as sink
from ..sinks.snapshots import Snapshots
from ..tables import Tables
from .derived import published
from .registry import AS_OF_TEXT, as_of, query


def _written(df: DataFrame, name: str) -> DataFrame:
    return published(df.sparkSession, {name: df}).read(name)


def _upsert(t: Tables) -> Snapshots:
    """Customers as drafts, parts as apps, some of them with sources: all tables of the run as one commit."""
    key = F.col("c_custkey")
    drafts = t.customer.select(
        key.alias("draft_id"),
        F.when(key % 2 == 0, "registry").otherwise("feed").alias("source_type"),
        F.when(key % 5 == 0, "").otherwise((key % 700).cast("string")).alias("external_id"),
        F.concat(F.lit("p"), key).alias("payload"),
        F.when(key % 3 == 0, "official").otherwise("unknown").alias("verification"),
        F.col("c_mktsegment").alias("name"),
        F.col("c_name").alias("developer"),
    )
    own = F.col("p_partkey")
    apps = t.part.select(own.alias("app_id"), F.when(own % 4 == 0, "unknown").otherwise("listed").alias("verification"), F.when(own % 3 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(own % 2 == 0, "").otherwise(F.col("p_brand")).alias("developer"))
    sources = t.part.where("p_partkey <= 400").select(F.lit("registry").alias("source_type"), own.cast("string").alias("external_id"), own.alias("app_id"), F.lit("old").alias("payload"))
    matches = t.part.where("p_size > 45").select(own.alias("draft_id"), own.alias("app_id"))
    slug = lambda c: F.concat(F.lit("n"), c)
    platforms = t.part.select(own.alias("app_id"), slug(F.col("p_size") % 25).alias("slug"))
    nations = t.nation.where("n_nationkey < 20").select(slug(F.col("n_nationkey")).alias("slug"))
    segments = t.customer.select(F.col("c_mktsegment").alias("slug")).where("slug <> 'MACHINERY'")
    bridges = {
        "platforms": (platforms, t.customer.select(key.alias("draft_id"), slug(F.col("c_nationkey")).alias("slug")), nations),
        "categories": (platforms.limit(0), t.customer.select(key.alias("draft_id"), F.col("c_mktsegment").alias("slug")), segments),
    }
    tables = apply.upserted_tables(apps, sources, drafts, matches, ["name", "developer"], bridges, ("platforms",), identity.duplicate_candidates)
    return published(t.part.sparkSession, tables, times=1)


_UPSERT = """WITH d AS (SELECT c_custkey AS draft_id, CASE WHEN c_custkey % 2 = 0 THEN 'registry' ELSE 'feed' END AS source_type,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 700 AS VARCHAR) END AS external_id, 'p' || c_custkey AS payload,
  CASE WHEN c_custkey % 3 = 0 THEN 'official' ELSE 'unknown' END AS verification, c_mktsegment AS name, c_name AS developer FROM customer),
a AS (SELECT p_partkey AS app_id, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'listed' END AS verification,
  CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS developer FROM part),
s AS (SELECT 'registry' AS source_type, CAST(p_partkey AS VARCHAR) AS external_id, p_partkey AS app_id, 'old' AS payload FROM part WHERE p_partkey <= 400),
o AS (SELECT d.*, s.app_id AS known, p_partkey AS match FROM d LEFT JOIN s ON d.external_id <> '' AND d.source_type = s.source_type AND d.external_id = s.external_id
  LEFT JOIN part ON p_partkey = draft_id AND p_size > 45),
k AS (SELECT * FROM o WHERE known IS NOT NULL QUALIFY row_number() OVER (PARTITION BY known ORDER BY draft_id) = 1),
f AS (SELECT * FROM o WHERE known IS NULL AND match IS NULL
  QUALIFY row_number() OVER (PARTITION BY source_type, external_id, CASE WHEN external_id = '' THEN draft_id END ORDER BY draft_id) = 1),
n AS (SELECT *, (SELECT max(app_id) FROM a) + row_number() OVER (ORDER BY draft_id) AS app_id FROM f),
w AS (SELECT * FROM o WHERE external_id <> '' QUALIFY row_number() OVER (PARTITION BY source_type, external_id ORDER BY draft_id) = 1)
"""


@query(
    _UPSERT
    + """SELECT a.app_id, CASE WHEN a.verification = 'unknown' THEN coalesce(k.verification, 'unknown') ELSE a.verification END AS verification,
    CASE WHEN trim(a.name) = '' THEN k.name ELSE a.name END AS name, CASE WHEN a.developer = '' THEN k.developer ELSE a.developer END AS developer
    FROM a LEFT JOIN k ON k.known = a.app_id UNION ALL SELECT app_id, verification, name, developer FROM n"""
)
def upserted_apps(t: Tables) -> DataFrame:
    return _upsert(t).read("apps")


@query(
    _UPSERT
    + """, x AS (SELECT draft_id, source_type, external_id, match AS app_id, payload FROM o WHERE known IS NULL AND match IS NOT NULL AND external_id <> ''
      UNION ALL SELECT draft_id, source_type, external_id, app_id, payload FROM n WHERE external_id <> ''),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY source_type, external_id ORDER BY draft_id) = 1)
    SELECT s.source_type, s.external_id, s.app_id, coalesce(w.payload, s.payload) AS payload FROM s LEFT JOIN w USING (source_type, external_id)
    UNION ALL SELECT source_type, external_id, app_id, payload FROM y"""
)
def upserted_sources(t: Tables) -> DataFrame:
    return _upsert(t).read("sources")


@query(
    _UPSERT
    + """SELECT p_partkey AS app_id, 'n' || (p_size % 25) AS slug FROM part
    UNION SELECT known, 'n' || c_nationkey FROM o JOIN customer ON c_custkey = draft_id WHERE known IS NOT NULL AND c_nationkey < 20
    UNION SELECT app_id, 'n' || c_nationkey FROM n JOIN customer ON c_custkey = draft_id WHERE c_nationkey < 20"""
)
def upserted_platforms(t: Tables) -> DataFrame:
    """Platforms of apps that drafts made or whose sources they renewed."""
    return _upsert(t).read("platforms")


@query(_UPSERT + "SELECT app_id, c_mktsegment AS slug FROM n JOIN customer ON c_custkey = draft_id WHERE c_mktsegment <> 'MACHINERY'")
def upserted_categories(t: Tables) -> DataFrame:
    """Categories of apps that drafts made; slugs that are none are left out."""
    return _upsert(t).read("categories")


@query(
    _UPSERT
    + """, z AS (SELECT a.app_id, lower(CASE WHEN trim(a.name) = '' THEN k.name ELSE a.name END) AS name FROM a LEFT JOIN k ON k.known = a.app_id
      UNION ALL SELECT app_id, lower(name) FROM n)
    SELECT n.app_id, z.app_id AS candidate_app_id, 1.0::DOUBLE AS score FROM n JOIN z ON z.name = lower(n.name) AND z.app_id < n.app_id
    QUALIFY row_number() OVER (PARTITION BY n.app_id ORDER BY z.app_id) <= 5"""
)
def upserted_candidates(t: Tables) -> DataFrame:
    """For review: apps of lower ids with names like that of an app that the run made, earlier ones of the run too. Here
    names are market segments, which are alike only if they are equal."""
    return _upsert(t).read("candidates")


@query(
    """WITH w AS (SELECT o_custkey AS app_id, ['MACHINERY', 'BUILDING', 'NONE'][o_orderkey % 3 + 1] AS slug FROM orders)
    SELECT DISTINCT c_custkey AS app_id, c_mktsegment AS slug FROM customer UNION SELECT app_id, slug FROM w WHERE slug IN (SELECT c_mktsegment FROM customer)"""
)
def attached_categories(t: Tables) -> DataFrame:
    """Categories added through orders; one of them is no category and is left out."""
    slug = F.element_at(F.array(*map(F.lit, ("MACHINERY", "BUILDING", "NONE"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    bridge = t.customer.select(F.col("c_custkey").alias("app_id"), F.col("c_mktsegment").alias("slug"))
    return _written(apply.attached(bridge, t.orders.select(F.col("o_custkey").alias("app_id"), slug.alias("slug")), bridge.select("slug"), "app_id", "slug"), "categories")


_TITLES = """WITH t AS (SELECT p_partkey AS app_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || '!' END AS title FROM part),
s AS (SELECT *, replace(replace(lower(title), '!', ''), ' ', '-') AS slug FROM t),
k AS (SELECT DISTINCT replace(p_name, ' ', '-') AS slug, p_name AS title FROM part WHERE starts_with(p_name, 'red'))
"""


def _use_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("!")))
    titles = t.part.select(F.col("p_partkey").alias("app_id"), F.lit(0).alias("place"), title.alias("title"))
    dim = t.part.where(F.col("p_name").startswith("red")).select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.col("p_name").alias("title")).distinct()
    return apply.attached_use_cases(titles.limit(0).select("app_id", F.lit("").alias("slug")), dim, titles, "app_id")


@query(_TITLES + "SELECT DISTINCT app_id, slug FROM s")
def attached_use_cases(t: Tables) -> DataFrame:
    return _written(_use_cases(t)[0], "use-cases")


@query(_TITLES + "SELECT slug, title FROM k UNION ALL SELECT slug, arg_min(title, app_id) FROM s WHERE slug NOT IN (SELECT slug FROM k) GROUP BY slug")
def created_use_cases(t: Tables) -> DataFrame:
    return _written(_use_cases(t)[1], "use-case-titles")


_PLAN = """WITH a AS (SELECT p_partkey AS app_id, CASE WHEN p_size > 30 THEN '' ELSE p_name END AS name, CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS developer, 'draft' AS status FROM part),
p AS (SELECT s_suppkey AS app_id, CASE WHEN s_nationkey % 2 = 0 THEN s_name END AS name, s_name AS developer FROM supplier)
"""


def _plan(t: Tables) -> tuple[DataFrame, DataFrame]:
    apps = t.part.select(F.col("p_partkey").alias("app_id"), F.when(F.col("p_size") > 30, "").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") >= 10, F.col("p_brand")).alias("developer"), F.lit("draft").alias("status"))
    plan = t.supplier.select(F.col("s_suppkey").alias("app_id"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_name").alias("developer"))
    return apply.applied_fields(apps, plan, "app_id")


@query(
    _PLAN
    + """SELECT app_id, CASE WHEN trim(coalesce(a.name, '')) = '' THEN coalesce(p.name, a.name) ELSE a.name END AS name,
    CASE WHEN trim(coalesce(a.developer, '')) = '' THEN coalesce(p.developer, a.developer) ELSE a.developer END AS developer, status FROM a LEFT JOIN p USING (app_id)"""
)
def applied_plan(t: Tables) -> DataFrame:
    """A plan of fields after the check that they are still blank."""
    return _written(_plan(t)[0], "planned")


@query(
    _PLAN
    + """SELECT app_id, 'name' AS field, p.name AS planned FROM a JOIN p USING (app_id) WHERE trim(coalesce(a.name, '')) <> '' AND p.name <> a.name
    UNION ALL SELECT app_id, 'developer', p.developer FROM a JOIN p USING (app_id) WHERE trim(coalesce(a.developer, '')) <> '' AND p.developer <> a.developer"""
)
def applied_plan_skipped(t: Tables) -> DataFrame:
    """What the plan wanted to write and was filled in meanwhile."""
    return _plan(t)[1]


@query(
    """WITH k AS (SELECT l_partkey AS app_id, l_linenumber AS capability, max(CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'unknown' END) AS value FROM lineitem GROUP BY ALL),
    p AS (SELECT p_partkey AS app_id, p_size % 9 AS capability, CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS value, ' ' || p_name AS note FROM part),
    q AS (SELECT * FROM p WHERE value <> 'maybe')
    SELECT app_id, capability, CASE WHEN q.value IS NOT NULL AND coalesce(k.value, 'unknown') = 'unknown' THEN q.value ELSE k.value END AS value,
    CASE WHEN q.value IS NOT NULL AND coalesce(k.value, 'unknown') = 'unknown' THEN trim(q.note) ELSE CASE WHEN k.value IS NOT NULL THEN 'old' END END AS note FROM k FULL JOIN q USING (app_id, capability)"""
)
def applied_capabilities(t: Tables) -> DataFrame:
    from .views import capabilities

    size = F.col("p_size")
    value = F.when(size % 3 == 0, "yes").when(size % 3 == 1, "no").otherwise("maybe")
    plan = t.part.select(F.col("p_partkey").alias("app_id"), (size % 9).alias("capability"), value.alias("value"), F.concat(F.lit(" "), "p_name").alias("note"))
    return _written(apply.applied_capabilities(capabilities(t).withColumn("note", F.lit("old")), plan, ["app_id", "capability"]), "capabilities")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 100000 THEN 'official' ELSE 'unknown' END AS verification FROM orders"""
)
def bulk_flagged(t: Tables) -> DataFrame:
    own = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.lit("unknown").alias("verification"))
    done, _ = apply.flagged(own, F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") > 100_000, "verification", "official")
    return _written(done.select("o_orderkey", "verification"), "flagged")


@query("SELECT count(*) FILTER (o_totalprice > 100000) AS n_flagged, count(*) FILTER (NOT o_totalprice > 100000) AS n_skipped FROM orders WHERE o_orderpriority LIKE '1%'")
def bulk_flag_report(t: Tables) -> DataFrame:
    own = t.orders.withColumn("verification", F.lit("unknown"))
    return apply.flagged(own, F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") > 100_000, "verification", "official")[1]


_DRIFT = """WITH b AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation,
  CASE c_custkey % 5 WHEN 0 THEN '{"rank":' || c_custkey || ',"live":true,"ratio":0.25,"drift":"old"}' WHEN 1 THEN '{"nested":{"b":[1,2.5,"x"],"c":null},"none":null}'
    WHEN 2 THEN '[1,{"a":"b"}]' WHEN 3 THEN 'no json' END AS payload FROM customer),
d AS (SELECT k, 'nation' AS field, CAST(nation AS VARCHAR) AS before, CAST(nation + 1 AS VARCHAR) AS after FROM b WHERE k % 3 = 0
  UNION ALL SELECT k, 'segment', segment, 'NEW' FROM b WHERE k % 5 = 0),
e AS (SELECT k, '[' || string_agg('{"field":"' || field || '","before":"' || before || '","after":"' || after || '"}', ',' ORDER BY field) || ']' AS changes,
  '[' || string_agg('{"after":"' || after || '","before":"' || before || '","field":"' || field || '"}', ',' ORDER BY field) || ']' AS nested FROM d GROUP BY k)
"""


def _payloads(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    payload = F.when(k % 5 == 0, text('{"rank":', k.cast("string"), ',"live":true,"ratio":0.25,"drift":"old"}')).when(k % 5 == 1, '{"nested":{"b":[1,2.5,"x"],"c":null},"none":null}')
    payload = payload.when(k % 5 == 2, '[1,{"a":"b"}]').when(k % 5 == 3, "no json")
    return t.customer.select(k.alias("k"), (k + 7).alias("source_id"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("last_enriched_at"), payload.alias("payload"))


def _drift(t: Tables) -> tuple[DataFrame, DataFrame]:
    from ..operators.merge import drift

    k = F.col("c_custkey")
    before = t.customer.select(k.alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    after = before.select("k", F.when(F.col("k") % 3 == 0, F.col("nation") + 1).otherwise(F.col("nation")).alias("nation"), F.when(F.col("k") % 5 == 0, "NEW").otherwise(F.col("segment")).alias("segment"))
    return apply.persisted_drift(drift(before, after, "k", ["nation", "segment"]), _payloads(t), "k", as_of())


@query(_DRIFT + "SELECT k, changes FROM e")
def drift_entries(t: Tables) -> DataFrame:
    """Entries for review: only where something changed."""
    return _written(_drift(t)[0], "entries")


@query(
    _DRIFT
    + f"""SELECT k, k + 7 AS source_id, TIMESTAMP '{AS_OF_TEXT}' AS last_enriched_at,
    CASE k % 5 WHEN 0 THEN '{{"rank":' || k || ',"live":true,"ratio":0.25,' WHEN 1 THEN '{{"nested":{{"b":[1,2.5,"x"],"c":null}},"none":null,'
      WHEN 2 THEN '{{"_original":[1,{{"a":"b"}}],' WHEN 3 THEN '{{"_original":"no json",' ELSE '{{' END || '"drift":' || coalesce(nested, '[]') || '}}' AS payload
    FROM b LEFT JOIN e USING (k)"""
)
def drift_sources(t: Tables) -> DataFrame:
    """Sources of a drift run: all get its time, and what changed in their payload, of which all else stays as it is."""
    return _written(_drift(t)[1], "checked")


@query(_DRIFT + "SELECT k, CASE k % 5 WHEN 2 THEN 'not_an_object' ELSE 'not_json' END AS problem FROM b WHERE k % 5 IN (2, 3)")
def payload_problems(t: Tables) -> DataFrame:
    """Payloads that are kept beside what is added to them, as they are no JSON objects."""
    return _payloads(t).select("k", apply.payload_problem(F.col("payload")).alias("problem")).where("problem is not null")


_VANISHED = """WITH c AS (SELECT user_id AS app_id, 'u' || (event_id % 4) AS url, max(event_id) AS consecutive_failures FROM events WHERE event_type = 'error' GROUP BY ALL),
s AS (SELECT user_id AS app_id, event_id AS source_id, 'u' || (event_id % 4) AS source_url, event_type = 'view' AS is_active FROM events)
"""


def _vanished(t: Tables) -> tuple[DataFrame, DataFrame]:
    url = F.concat(F.lit("u"), F.col("event_id") % 4)
    crossings = t.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("app_id"), url.alias("url")).agg(F.max("event_id").alias("consecutive_failures")).withColumn("target", F.lit("official"))
    sources = t.events.select(F.col("user_id").alias("app_id"), F.col("event_id").alias("source_id"), url.alias("source_url"), (F.col("event_type") == "view").alias("is_active"))
    return apply.vanished(crossings, sources)


@query(_VANISHED + "SELECT s.app_id, source_id, source_url, is_active AND url IS NULL AS is_active FROM s LEFT JOIN c ON c.app_id = s.app_id AND url = source_url")
def vanished_sources(t: Tables) -> DataFrame:
    """Sources after links that failed too often: only those with the very url are switched off."""
    return _written(_vanished(t)[0], "sources")


@query(
    _VANISHED
    + """SELECT c.app_id, url, consecutive_failures, count(source_id) FILTER (is_active) AS sources_deactivated FROM c LEFT JOIN s ON s.app_id = c.app_id AND source_url = url GROUP BY ALL"""
)
def vanished_entries(t: Tables) -> DataFrame:
    return _vanished(t)[1].select("app_id", "url", "consecutive_failures", "sources_deactivated")


@query(
    f"""SELECT * FROM events WHERE NOT (ts < TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 20 DAY AND event_type IN ('view', 'click'))"""
)
def retention_rewrite(t: Tables) -> DataFrame:
    """The table after retention; only rows of some types may go."""
    return _written(sink.without_expired(t.events, "ts", as_of(), 20, F.col("event_type").isin("view", "click")), "events")


@query(
    """WITH l AS (SELECT DISTINCT l_partkey AS app_id, 's' || l_suppkey AS slug FROM lineitem), x AS (SELECT app_id, list_sort(list(slug)) AS slugs FROM l GROUP BY app_id)
    SELECT p_partkey AS app_id, '{"app_id":' || p_partkey || ',"name":"' || p_name || '","platforms":[' || coalesce(array_to_string(list_transform(slugs, lambda s: '"' || s || '"'), ','), '') || ']}' AS json
    FROM part LEFT JOIN x ON app_id = p_partkey"""
)
def nested_json(t: Tables) -> DataFrame:
    apps = t.part.select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"))
    slugs = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.concat(F.lit("s"), "l_suppkey").alias("slug"))
    return sink.nested(apps, "app_id", ["name"], {"platforms": (slugs, "slug")})


_MERGE = """WITH m AS (SELECT p_partkey AS source, (p_partkey // 10) * 10 AS target FROM part WHERE p_partkey % 10 IN (1, 2) AND p_partkey > 10),
"""


def _moves(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 10 in (1, 2) and p_partkey > 10").select(F.col("p_partkey").alias("source"), (F.floor(F.col("p_partkey") / 10) * 10).cast("bigint").alias("target"))


@query(
    _MERGE
    + """r AS (SELECT 'platforms' AS relation, l_partkey AS app_id, CAST(l_suppkey AS VARCHAR) AS item, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY ALL
      UNION ALL SELECT 'clicks', user_id, CAST(event_id AS VARCHAR), event_id FROM events
      UNION ALL SELECT 'capabilities', l_partkey, CAST(l_linenumber AS VARCHAR), min(l_orderkey) FROM lineitem GROUP BY ALL)
    SELECT relation, coalesce(target, app_id) AS app_id, item, arg_min(id, {'was': CASE WHEN target IS NULL THEN 0 ELSE app_id END, 'id': id}) AS id
    FROM r LEFT JOIN m ON source = app_id GROUP BY ALL"""
)
def merged_relations(t: Tables) -> DataFrame:
    """Relations of merged apps moved to their targets; of rows that meet the target's own stays."""
    own = t.lineitem.select(F.col("l_partkey").alias("app_id"), "l_suppkey", "l_linenumber", "l_orderkey")
    relations = {
        "platforms": own.groupBy("app_id", F.col("l_suppkey").cast("string").alias("item")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")),
        "clicks": t.events.select(F.col("user_id").alias("app_id"), F.col("event_id").cast("string").alias("item"), F.col("event_id").alias("id")),
        "capabilities": own.groupBy("app_id", F.col("l_linenumber").cast("string").alias("item")).agg(F.min("l_orderkey").alias("id")),
    }
    done = apply.repointed_all({k: (v, ["item"]) for k, v in relations.items()}, _moves(t))
    first, *rest = (df.select(F.lit(k).alias("relation"), "app_id", "item", "id") for k, df in done.items())
    for df in rest:
        first = first.unionByName(df)
    return _written(first, "relations")


@query(
    _MERGE
    + """a AS (SELECT p_partkey AS app_id, CASE WHEN p_partkey % 20 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 10 = 1 THEN ' ' ELSE p_brand END AS developer FROM part),
    g AS (SELECT target, arg_min(name, app_id) FILTER (trim(name) <> '') AS name, arg_min(developer, app_id) FILTER (trim(developer) <> '') AS developer FROM a JOIN m ON source = app_id GROUP BY target)
    SELECT app_id, CASE WHEN trim(a.name) = '' THEN coalesce(g.name, a.name) ELSE a.name END AS name, CASE WHEN trim(a.developer) = '' THEN coalesce(g.developer, a.developer) ELSE a.developer END AS developer
    FROM a LEFT JOIN g ON target = app_id WHERE app_id NOT IN (SELECT source FROM m)"""
)
def merged_apps(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    apps = t.part.select(key.alias("app_id"), F.when(key % 20 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(key % 10 == 1, " ").otherwise(F.col("p_brand")).alias("developer"))
    return _written(apply.merged_apps(apps, _moves(t), ["name", "developer"]), "merged")


_CHAINS = """WITH RECURSIVE m AS (SELECT p_partkey AS source, CASE WHEN p_partkey % 100 = 1 THEN p_partkey + 2 ELSE p_partkey - 1 END AS target
  FROM part WHERE p_partkey % 100 BETWEEN 1 AND 60),
s(source, here, n) AS (SELECT source, target, 1 FROM m UNION ALL SELECT s.source, m.target, n + 1 FROM s JOIN m ON s.here = m.source WHERE n < 70),
"""


def _chains(t: Tables) -> DataFrame:
    """Parts 1 to 60 of a hundred go to the one before; the first goes to the third, so that they end in a circle of three."""
    own = F.col("p_partkey")
    return t.part.where((own % 100).between(1, 60)).select(own.alias("source"), F.when(own % 100 == 1, own + 2).otherwise(own - 1).alias("target"))


@query(
    _CHAINS
    + """e AS (SELECT source, min(least(source, here)) AS least FROM s GROUP BY source) SELECT source, least AS target FROM e WHERE source <> least"""
)
def merge_chains(t: Tables) -> DataFrame:
    """Where chains of merges end: here in the least member of the circle that they lead into, which stays."""
    return apply.resolved_moves(_chains(t))


@query(
    """WITH g AS (SELECT p_partkey AS app_id, p_partkey % 100 AS k FROM part),
    r AS (SELECT CASE WHEN k BETWEEN 1 AND 60 THEN app_id - k + 1 ELSE app_id END AS app_id, l_suppkey AS item, l_orderkey * 10 + l_linenumber AS id, k NOT BETWEEN 2 AND 60 AS own, app_id AS was
      FROM g JOIN lineitem ON l_partkey = app_id)
    SELECT app_id, item, arg_min(id, {'own': NOT own, 'was': CASE WHEN own THEN 0 ELSE was END, 'id': id}) AS id FROM r GROUP BY ALL"""
)
def merged_chains(t: Tables) -> DataFrame:
    """A relation after chained merges: all its rows on the last targets, one for each item."""
    rows = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_suppkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return _written(apply.repointed_all({"items": (rows, ["item"])}, apply.resolved_moves(_chains(t)))["items"], "items")


_CASCADE = f"""WITH o AS (SELECT * FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-06-01' AND o_orderstatus = 'F')),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 25 DAY)
"""


def _cascade(t: Tables) -> Snapshots:
    """Orders by date and state with their lines; the lines' notes (one of each line number) with the lines; events by themselves."""
    notes = t.lineitem.select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), F.lit("note").alias("note"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    as_of_orders = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    tables = sink.retained(
        {
            "orders": sink.Retained(t.orders, "o_orderdate", 0, F.col("o_orderstatus") == "F"),
            "lines": sink.Retained(lines, parent=("orders", "l_orderkey", "o_orderkey")),
            "notes": sink.Retained(notes, parent=("lines", "line", "line")),
        },
        as_of_orders,
    )
    tables |= sink.retained({"events": sink.Retained(t.events, "ts", 25)}, as_of())
    return published(t.part.sparkSession, {k: v for k, v in tables.items() if k != "orders"} | {"orders": tables["orders"]}, times=1)


@query(
    _CASCADE
    + """SELECT 'orders' AS name, count(*) AS n, sum(o_orderkey) AS keys FROM o UNION ALL SELECT 'lines', count(*), sum(l_orderkey) FROM l
    UNION ALL SELECT 'notes', count(*), sum(l_orderkey) FROM l UNION ALL SELECT 'events', count(*), sum(event_id) FROM e"""
)
def retention_cascade(t: Tables) -> DataFrame:
    """What retention leaves of four tables: children go with their parents, and one commit publishes all."""
    kept = _cascade(t)
    each = {"orders": "o_orderkey", "lines": "l_orderkey", "notes": "l_orderkey", "events": "event_id"}
    first, *rest = (kept.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(k).cast("decimal(38,0)").alias("keys")) for n, k in each.items())
    for df in rest:
        first = first.unionAll(df)
    return first


@query(_CASCADE + "SELECT l_orderkey, l_linenumber, l_partkey FROM l")
def retention_children(t: Tables) -> DataFrame:
    """The lines that are left when the orders that expire take theirs along."""
    return _cascade(t).read("lines").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS total, CASE month(o_orderdate) % 3 WHEN 0 THEN 0 ELSE 20000000 END AS budget FROM orders GROUP BY ALL),
    r AS (SELECT *, CASE WHEN budget > 0 THEN round(CAST(total AS DOUBLE) / budget, 4) END AS utilization FROM m)
    SELECT CAST(month AS DATE) AS month, utilization, coalesce(budget > 0 AND total >= budget, false) AS hard_stopped, coalesce(budget > 0 AND total >= budget * 0.8, false) AS discovery_disabled FROM r"""
)
def budget_gate_flags(t: Tables) -> DataFrame:
    """Gates of each month: a budget of 0 sets none."""
    month = F.trunc("o_orderdate", "MM").alias("month")
    totals = t.orders.groupBy(month).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total"))
    budget = F.when(F.month("month") % 3 == 0, F.lit(0)).otherwise(F.lit(20_000_000))
    return budget_gates(totals.withColumn("budget", budget), "total", "budget").select("month", "utilization", "hard_stopped", "discovery_disabled")


@query(
    """SELECT p_partkey AS app_id, CASE WHEN p_size % 3 = 0 THEN 'web,mcp' WHEN p_size % 3 = 1 THEN 'web' ELSE '' END AS platforms,
    CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'scope ' || p_size END AS verdict, 'scope ' || p_size AS scope, substr(repeat(p_name, 40), 1, 280) AS short_description FROM part"""
)
def proposal_drafts(t: Tables) -> DataFrame:
    size = F.col("p_size")
    types = F.when(size % 3 == 0, F.array(*map(F.lit, ("app", "server", "app", "none")))).when(size % 3 == 1, F.array(F.lit("extension"))).otherwise(F.array().cast("array<string>"))
    proposals = t.part.select(
        F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.repeat("p_name", F.lit(40)).alias("short_description"), types.alias("listing_types"),
        F.when(size % 2 == 0, F.col("p_type")).otherwise(" ").alias("proposed_verdict"), F.concat(F.lit("scope "), size).alias("scope_summary"), F.lit('{"a":1}').alias("payload"),
    )
    made = apply.proposal_drafts(proposals, {"app": "web", "server": "mcp", "extension": "web"}, "proposal")
    said = lambda key: F.get_json_object("payload", f"$.{key}")
    return made.select("app_id", F.concat_ws(",", "platforms").alias("platforms"), said("proposed_verdict").alias("verdict"), said("scope_summary").alias("scope"), "short_description")


@query(
    """WITH s AS (SELECT l_partkey AS app_id, l_orderkey * 10 + l_linenumber AS id, l_linestatus AS st, l_quantity AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1)
    SELECT app_id, 'https://r.example/servers/' || id AS official_directory_url, CASE WHEN st = 'F' THEN 'sse' ELSE 'http' END AS transport, CASE WHEN q > 25 THEN 'run ' || CAST(q AS BIGINT) END AS command,
    CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'official' WHEN p_size % 3 = 0 THEN 'listed' ELSE 'unknown' END AS verification FROM s JOIN part ON p_partkey = app_id"""
)
def payload_backfill(t: Tables) -> DataFrame:
    is_f, q = F.col("l_linestatus") == "F", F.col("l_quantity")
    transports = F.to_json(F.struct(F.struct(F.lit(False).alias("stdio"), is_f.alias("sse"), F.lit(True).alias("http")).alias("transports"), F.struct(F.when(q > 25, F.concat(F.lit("run "), q.cast("bigint"))).alias("command")).alias("install")))
    sources = t.lineitem.select(F.col("l_partkey").alias("app_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), transports.alias("payload")).withColumn("external_id", F.col("source_id").cast("string"))
    size = F.col("p_size")
    apps = t.part.select(F.col("p_partkey").alias("app_id"), F.when(size % 3 == 0, "listed").otherwise("unknown").alias("verification"), F.when(size % 2 == 0, "unreviewed").otherwise("reviewed").alias("review"))
    done = apply.payload_backfill(sources, apps, "https://r.example/")
    return done.select("app_id", "official_directory_url", F.col("metadata")["transport"].alias("transport"), F.col("metadata")["install_command"].alias("command"), "verification")
