"""Views, filters, joins, facets, ranks and pages of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import editorial, rank, relational as rel
from ..tables import Tables, published, published_loose
from . import views
from .registry import AS_OF_TEXT, as_of, query

_TRENDING = f"""WITH c AS (
  SELECT user_id AS app_id, (epoch_us(TIMESTAMP '{AS_OF_TEXT}') - epoch_us(ts)) / 3.6e9::DOUBLE AS age,
    CASE event_type WHEN 'click' THEN 1.2::DOUBLE WHEN 'view' THEN 0.8::DOUBLE WHEN 'purchase' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '{AS_OF_TEXT}'),
h AS (SELECT app_id, w / (1 + age / 24) AS heat, age FROM c),
s AS (SELECT app_id, sum(heat) FILTER (age <= 24) AS h1, sum(heat) FILTER (age <= 168) AS h7, sum(heat) FILTER (age <= 720) AS h30 FROM h GROUP BY app_id),
a AS (SELECT p_partkey AS app_id, least(100, p_size * 2) AS q FROM part),
t AS (SELECT app_id, q AS quality_score,
  round(coalesce(h1 * greatest(0.1, q / 100.0::DOUBLE), q / 100.0::DOUBLE), 6) AS score_1d,
  round(coalesce(h7 * greatest(0.1, q / 100.0::DOUBLE), q / 100.0::DOUBLE), 6) AS score_7d,
  round(coalesce(h30 * greatest(0.1, q / 100.0::DOUBLE), q / 100.0::DOUBLE), 6) AS score_30d
  FROM a LEFT JOIN s USING (app_id))
"""


def _trending(t: Tables) -> DataFrame:
    return rank.trending(views.apps(t), views.clicks(t), as_of(), weights=views.EVENT_WEIGHTS)


@query(_TRENDING + "SELECT * FROM t")
def trending_scores(t: Tables) -> DataFrame:
    return _trending(t)


@query(_TRENDING + "SELECT app_id, score_7d FROM t ORDER BY score_7d DESC, quality_score DESC, app_id LIMIT 9")
def trending_top9(t: Tables) -> DataFrame:
    return rel.top(_trending(t), 9, *rank.trending_order(7)).select("app_id", "score_7d")


@query(
    _TRENDING
    + """SELECT w, app_id, place FROM (SELECT w, app_id, CAST(row_number() OVER (PARTITION BY w ORDER BY s DESC, quality_score DESC, app_id) AS INTEGER) AS place
    FROM (SELECT app_id, quality_score, unnest([1, 7, 30]) AS w, unnest([score_1d, score_7d, score_30d]) AS s FROM t)) WHERE place <= 10"""
)
def trending_windows_1_7_30(t: Tables) -> DataFrame:
    rows = F.inline(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"score_{w}d").alias("s")) for w in rank.WINDOWS)))
    long = _trending(t).select("app_id", "quality_score", rows)
    return rel.top_by(long, ["w"], 10, F.desc("s"), F.desc("quality_score"), F.asc("app_id"), rank="place").select("w", "app_id", "place")


def _orders_as_apps(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("hidden")
    launch = F.element_at(F.array(*map(F.lit, ("live", "beta", "waitlist", "deprecated"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("app_id"), status.alias("status"), (F.col("o_custkey") % 5 != 0).alias("is_indexable"), launch.alias("launch_status"))


_APPS_SQL = """SELECT o_orderkey AS app_id, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'hidden' END AS status,
  o_custkey % 5 <> 0 AS is_indexable, ['live', 'beta', 'waitlist', 'deprecated'][o_orderkey % 4 + 1] AS launch_status FROM orders"""


@query(f"WITH a AS ({_APPS_SQL}) SELECT * FROM a WHERE status = 'published' AND is_indexable AND launch_status IN ('live', 'beta', 'waitlist')")
def published_view(t: Tables) -> DataFrame:
    return published(_orders_as_apps(t))


@query(
    f"""WITH a AS ({_APPS_SQL}) SELECT launch_status, count(*) AS n_loose, count(*) FILTER (launch_status <> 'deprecated') AS n_public
    FROM a WHERE status = 'published' AND is_indexable GROUP BY launch_status"""
)
def published_counts(t: Tables) -> DataFrame:
    loose = published_loose(_orders_as_apps(t))
    return loose.groupBy("launch_status").agg(F.count("*").alias("n_loose"), F.count_if(F.col("launch_status") != "deprecated").alias("n_public"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR o_orderdate < TIMESTAMP '1996-01-01'")
def filter_null_or_stale(t: Tables) -> DataFrame:
    checked = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.where(checked.isNull() | (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def filter_prefix(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%#1%'")
def filter_icontains(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%RING%") | F.col("p_brand").ilike("%#1%")).select("p_partkey")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
def filter_range_date(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-02-01"))
    return t.orders.where((at >= low) & (at < high)).select("o_orderkey", at.cast("date").alias("day"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props->>'$.k' IS NOT NULL AND props->>'$.z' IS NULL AND CAST(props->>'$.k' AS BIGINT) >= 90")
def filter_json_has_key(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.where(k.isNotNull() & F.get_json_object("props", "$.z").isNull() & (k.cast("bigint") >= 90)).select("event_id", k.cast("bigint").alias("k"))


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def filter_optional_params(t: Tables) -> DataFrame:
    return rel.optional_filters(t.part, p_type="ECONOMY", p_brand=None, p_name="").select("p_partkey")


@query("SELECT count(*) AS n FROM part WHERE p_size = 1 OR p_size = 7 OR p_brand = 'Brand#3'")
def filter_dynamic_or(t: Tables) -> DataFrame:
    return t.part.where(rel.any_of([F.col("p_size") == 1, F.col("p_size") == 7, F.col("p_brand") == "Brand#3"])).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS app_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7)")
def m2m_semi_filter(t: Tables) -> DataFrame:
    wanted = t.supplier.where(F.col("s_nationkey") == 7).select(F.col("s_suppkey").alias("platform_id"))
    links = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_suppkey").alias("platform_id"))
    return rel.having_any(views.apps(t).select("app_id"), rel.having_any(links, wanted, "platform_id"), "app_id")


@query(
    f"""WITH c AS ({views.CAPABILITIES_SQL}) SELECT p_partkey AS app_id FROM part
    WHERE p_partkey IN (SELECT app_id FROM c WHERE value = 'yes' AND capability IN (1, 2, 3) GROUP BY app_id HAVING count(DISTINCT capability) = 3)"""
)
def m2m_all_capabilities(t: Tables) -> DataFrame:
    yes = views.capabilities(t).where(F.col("value") == "yes")
    return rel.having_all(views.apps(t).select("app_id"), yes, "app_id", "capability", [1, 2, 3])


@query(
    """SELECT p_partkey AS app_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS same_row,
    p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') AS any_row FROM part"""
)
def same_row_vs_any_row(t: Tables) -> DataFrame:
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    flags = t.lineitem.groupBy(F.col("l_partkey").alias("app_id")).agg(F.bool_or(r & o).alias("same"), (F.bool_or(r) & F.bool_or(o)).alias("each"))
    both = views.apps(t).select("app_id").join(flags, "app_id", "left")
    return both.select("app_id", F.coalesce("same", F.lit(False)).alias("same_row"), F.coalesce("each", F.lit(False)).alias("any_row"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_unseen(t: Tables) -> DataFrame:
    seen = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.having_none(t.customer.select("c_custkey"), seen, "c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")
def semi_having_multi(t: Tables) -> DataFrame:
    many = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n > 12")
    return rel.having_any(t.customer.select("c_custkey", "c_mktsegment"), many, "c_custkey")


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS has_rich FROM nation")
def exists_probe(t: Tables) -> DataFrame:
    rich = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("r", F.lit(True))
    return t.nation.join(rich, "n_nationkey", "left").select("n_nationkey", F.coalesce("r", F.lit(False)).alias("has_rich"))


_SIMILAR = """WITH b AS (SELECT DISTINCT l_partkey AS app, l_suppkey AS s FROM lineitem),
    p AS (SELECT DISTINCT x.app AS app_id, y.app AS other FROM b x JOIN b y USING (s) WHERE x.app <> y.app),
    r AS (SELECT app_id, other, CAST(row_number() OVER (PARTITION BY app_id ORDER BY p_size DESC, other) AS INTEGER) AS rank FROM p JOIN part ON p_partkey = other)
    SELECT * FROM r WHERE rank <= 6"""


@query(_SIMILAR)
def similar_items_top6(t: Tables) -> DataFrame:
    """For each app the six best others that share a platform, over all links."""
    sizes = t.part.select(F.col("p_partkey").alias("app_id"), "p_size")
    links = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_suppkey").alias("platform_id")).distinct().join(sizes, "app_id")
    return rel.related_top(links, "app_id", "platform_id", 6, "-p_size")


@query(_SIMILAR)
def similar_items_top6_all(t: Tables) -> DataFrame:
    """The earlier name of similar_items_top6, when that was cut by date."""
    return similar_items_top6(t)


@query(
    """SELECT l_suppkey AS platform_id, p_type AS category, count(DISTINCT l_partkey) AS n_apps FROM lineitem JOIN part ON p_partkey = l_partkey
    GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 3"""
)
def cross_dim_min3(t: Tables) -> DataFrame:
    both = views.bridge(t).join(views.apps(t).select("app_id", "category"), "app_id")
    return both.groupBy("platform_id", "category").agg(F.count("*").alias("n_apps")).where("n_apps >= 3")


@query(
    """SELECT l_partkey AS app_id, l_orderkey AS source_id, l_linenumber AS line FROM (SELECT *, row_number() OVER
    (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1"""
)
def primary_source_per_item(t: Tables) -> DataFrame:
    """max_by over a struct aggregates on the map side, where a window would sort every source."""
    order = F.struct((F.col("l_returnflag") == "R").alias("p"), "l_shipdate", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("l"))
    best = t.lineitem.groupBy(F.col("l_partkey").alias("app_id")).agg(F.max(order).alias("m"))
    return best.select("app_id", (-F.col("m.o")).alias("source_id"), (-F.col("m.l")).alias("line"))


@query(
    """SELECT coalesce(m.to_name, 'other') AS category, count(*) AS n FROM part
    LEFT JOIN (VALUES ('ECONOMY', 'budget'), ('SMALL', 'compact'), ('LARGE', 'bulk')) m(name, to_name) ON m.name = p_type GROUP BY ALL"""
)
def map_lookup_categories(t: Tables) -> DataFrame:
    names = F.create_map(*(F.lit(x) for x in ("ECONOMY", "budget", "SMALL", "compact", "LARGE", "bulk")))
    return t.part.groupBy(F.coalesce(F.try_element_at(names, F.col("p_type")), F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT DISTINCT p_name, p_brand, p_type FROM part),
    a AS (SELECT x.p_brand AS a, y.p_brand AS b FROM (SELECT p_name, min(p_brand) AS p_brand FROM part GROUP BY p_name) x
      JOIN (SELECT p_name, max(p_brand) AS p_brand FROM part GROUP BY p_name) y USING (p_name))
    SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM a WHERE a <> b GROUP BY ALL"""
)
def pair_symmetric_match(t: Tables) -> DataFrame:
    ends = t.part.groupBy("p_name").agg(F.max("p_brand").alias("a"), F.min("p_brand").alias("b")).where("a <> b")
    return rel.ordered_pair(ends, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    """SELECT c_mktsegment AS source_type, count(*) AS n_calls, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""
)
def three_hop_cost_by_source(t: Tables) -> DataFrame:
    calls = t.lineitem.select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"))
    calls = calls.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))  # sums first: fewer rows travel
    chain = calls.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return chain.groupBy(F.col("c_mktsegment").alias("source_type")).agg(F.sum("n").alias("n_calls"), F.sum("cost").cast("double").alias("cost"))


_FACET = "SELECT p_partkey FROM part WHERE p_size >= 20"


def _facet_apps(t: Tables) -> DataFrame:
    return t.part.where("p_size >= 20").select(F.col("p_partkey").alias("app_id"))


@query(
    f"""SELECT s_nationkey AS platform, count(DISTINCT l_partkey) AS n_apps FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_partkey IN ({_FACET}) GROUP BY ALL"""
)
def facets_platform(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_partkey").alias("app_id"), "l_suppkey").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    links = links.select("app_id", F.col("s_nationkey").alias("platform"))
    dim = t.nation.select(F.col("n_nationkey").alias("platform"))
    return rel.facet_counts(_facet_apps(t), links, dim, "app_id", "platform").select("platform", "n_apps")


@query(f"SELECT p_type AS category, count(*) AS n_apps FROM part WHERE p_partkey IN ({_FACET}) GROUP BY ALL")
def facets_category(t: Tables) -> DataFrame:
    links = views.apps(t).select("app_id", "category")
    return rel.facet_counts(_facet_apps(t), links, links.select("category").distinct(), "app_id", "category").select("category", "n_apps")


@query(
    f"""WITH c AS ({views.CAPABILITIES_SQL}) SELECT capability, count(DISTINCT app_id) AS n_apps FROM c
    WHERE value = 'yes' AND app_id IN ({_FACET}) GROUP BY ALL"""
)
def facets_capability_correct(t: Tables) -> DataFrame:
    yes = views.capabilities(t).where(F.col("value") == "yes")
    return rel.having_any(yes, _facet_apps(t), "app_id").groupBy("capability").agg(F.count("*").alias("n_apps"))


@query(
    f"""WITH c AS ({views.CAPABILITIES_SQL}), h AS (SELECT * FROM c WHERE app_id IN ({_FACET})),
    y AS (SELECT app_id, count(*) AS k FROM h WHERE value = 'yes' GROUP BY app_id)
    SELECT capability, CAST(sum(k) AS BIGINT) AS n_apps FROM h JOIN y USING (app_id) GROUP BY ALL"""
)
def facets_capability_fanout(t: Tables) -> DataFrame:
    return rel.facet_counts_fanned(_facet_apps(t), views.capabilities(t), "app_id", "capability", F.col("value") == "yes")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 48")
def page_offset_clamped(t: Tables) -> DataFrame:
    return rel.page(t.orders.select("o_orderkey", "o_totalprice"), 3, 24, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 2475")
def page_deep(t: Tables) -> DataFrame:
    """A page far down an order: the counts of ranges tell which of them hold it, and only those are read."""
    rows, ranges = rel.counted_ranges(t.orders.select("o_orderkey", "o_totalprice"), "-o_totalprice", "o_orderkey")
    return rel.deep_page(rows, ranges, 100, 25, "-o_totalprice", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 40 OFFSET (SELECT ((count(*) - 1) // 40) * 40 FROM customer)")
def page_beyond_shows_last(t: Tables) -> DataFrame:
    """A page number beyond the last shows the last page."""
    return rel.shown_page(t.customer.select("c_custkey", "c_name"), 10**6, 40, F.asc("c_name"), F.asc("c_custkey"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 500 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 24")
def page_keyset(t: Tables) -> DataFrame:
    return rel.page_after(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", 500, 24, F.desc("o_orderdate"), F.desc("o_orderkey"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS checked_at FROM orders
    WHERE o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '2001-07-01' ORDER BY checked_at NULLS FIRST, o_orderkey LIMIT 50"""
)
def order_nulls_first(t: Tables) -> DataFrame:
    checked = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    due = t.orders.select("o_orderkey", checked.alias("checked_at")).where(F.col("checked_at").isNull() | (F.col("checked_at") < F.lit("2001-07-01").cast("timestamp_ntz")))
    return rel.top(due, 50, F.asc_nulls_first("checked_at"), F.asc("o_orderkey"))


@query("SELECT p_partkey AS app_id, p_name AS name, p_size AS quality FROM part WHERE p_type = 'SMALL' ORDER BY p_size DESC, p_name, p_partkey LIMIT 20")
def platform_top20(t: Tables) -> DataFrame:
    own = t.part.where(F.col("p_type") == "SMALL").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.col("p_size").alias("quality"))
    return rel.top(own, 20, F.desc("quality"), F.asc("name"), F.asc("app_id"))


@query(
    _TRENDING
    + """SELECT * FROM (
    (SELECT 'trending' AS shelf, app_id FROM t ORDER BY score_7d DESC, quality_score DESC, app_id LIMIT 9) UNION ALL
    (SELECT 'newest', app_id FROM t ORDER BY app_id DESC LIMIT 9) UNION ALL
    (SELECT 'featured', app_id FROM t WHERE quality_score >= 90 ORDER BY quality_score DESC, app_id LIMIT 6))"""
)
def home_bundle(t: Tables) -> DataFrame:
    scored = _trending(t)
    shelves = [
        ("trending", scored, 9, rank.trending_order(7)),
        ("newest", scored, 9, [F.desc("app_id")]),
        ("featured", scored.where("quality_score >= 90"), 6, [F.desc("quality_score"), F.asc("app_id")]),
    ]
    first, *rest = (rel.top(df, n, *order).select(F.lit(name).alias("shelf"), "app_id") for name, df, n, order in shelves)
    for shelf in rest:
        first = first.unionAll(shelf)
    return first


@query(
    """SELECT '/apps/' || p_partkey || '/' AS loc, 'weekly' AS changefreq, CASE WHEN p_size >= 35 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS priority
    FROM part WHERE p_size >= 10 UNION ALL SELECT DISTINCT '/category/' || lower(p_type) || '/', 'daily', 0.6::DOUBLE FROM part"""
)
def sitemap_rows(t: Tables) -> DataFrame:
    own = t.part.where("p_size >= 10").select(
        F.concat(F.lit("/apps/"), F.col("p_partkey"), F.lit("/")).alias("loc"), F.lit("weekly").alias("changefreq"), F.when(F.col("p_size") >= 35, 0.8).otherwise(0.5).alias("priority")
    )
    categories = t.part.select(F.concat(F.lit("/category/"), F.lower("p_type"), F.lit("/")).alias("loc")).distinct()
    return own.unionAll(categories.select("loc", F.lit("daily"), F.lit(0.6)))


@query("SELECT DISTINCT p_type AS slug, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'category' ELSE 'app' END AS kind FROM part")
def slug_dispatch(t: Tables) -> DataFrame:
    """A slug that is a category shows the category, else the app."""
    categories = t.part.where(F.col("p_type").isin("ECONOMY", "SMALL")).select(F.col("p_type").alias("slug")).distinct().withColumn("c", F.lit(True))
    slugs = t.part.select(F.col("p_type").alias("slug")).distinct()
    return slugs.join(categories, "slug", "left").select("slug", F.when(F.col("c"), "category").otherwise("app").alias("kind"))


_POSTS = """WITH p AS (SELECT o_orderkey AS post_id, CASE o_orderstatus WHEN 'P' THEN 'draft' ELSE 'published' END AS status, o_orderpriority AS post_type, o_orderdate AS published_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 40 DAY END AS featured_until FROM orders),
g AS (SELECT DISTINCT l_orderkey AS post_id, l_suppkey AS tag FROM lineitem)
"""
_POST_TIME = "2001-06-01"


def _posts(t: Tables) -> tuple[DataFrame, DataFrame, Column]:
    until = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(40)))
    posts = t.orders.select(
        F.col("o_orderkey").alias("post_id"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("status"), F.col("o_orderpriority").alias("post_type"),
        F.col("o_orderdate").alias("published_at"), until.alias("featured_until"),
    )
    return posts, t.lineitem.select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("tag")), F.lit(_POST_TIME).cast("timestamp_ntz")


@query(_POSTS + f"SELECT post_id FROM p WHERE status = 'published' AND published_at <= TIMESTAMP '{_POST_TIME}' AND post_type = '1-URGENT' AND post_id IN (SELECT post_id FROM g WHERE tag = 7)")
def posts_listed(t: Tables) -> DataFrame:
    posts, tags, now = _posts(t)
    return editorial.listed(posts, tags, now, 7, "1-URGENT").select("post_id")


@query(_POSTS + f"SELECT post_id, published_at FROM p WHERE status = 'published' AND featured_until > TIMESTAMP '{_POST_TIME}' ORDER BY published_at DESC, post_id LIMIT 5")
def posts_featured(t: Tables) -> DataFrame:
    posts, _, now = _posts(t)
    return editorial.featured(posts, now).select("post_id", "published_at")


@query(
    _POSTS
    + f""", v AS (SELECT * FROM p WHERE status = 'published' AND published_at <= TIMESTAMP '{_POST_TIME}'),
    b AS (SELECT post_type, post_id AS other, row_number() OVER (PARTITION BY post_type ORDER BY published_at DESC, post_id) AS r FROM v QUALIFY r <= 4)
    SELECT v.post_id, other, CAST(row_number() OVER (PARTITION BY v.post_id ORDER BY r) AS INTEGER) AS rank FROM v JOIN b ON v.post_type = b.post_type AND post_id <> other QUALIFY rank <= 3"""
)
def posts_related(t: Tables) -> DataFrame:
    posts, _, now = _posts(t)
    return editorial.related(posts, now)


@query(_POSTS + "SELECT tag, count(*) AS n_posts FROM g WHERE post_id IN (SELECT post_id FROM p WHERE status = 'published') GROUP BY tag ORDER BY n_posts DESC, tag LIMIT 10")
def tags_popular(t: Tables) -> DataFrame:
    posts, tags, _ = _posts(t)
    return editorial.popular_tags(posts, tags)
