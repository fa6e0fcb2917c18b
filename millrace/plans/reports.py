"""Reports: counts, costs, rates, gates and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import days_between, rate, token_cost
from ..operators import rank, relational as rel
from ..tables import Tables
from . import views
from .registry import AS_OF_TEXT, as_of, query

_NOW = f"TIMESTAMP '{AS_OF_TEXT}'"


@query(
    f"""SELECT trim(event_type || ' ' || (CAST(props->>'$.k' AS BIGINT) % 20)) AS query, count(*) AS search_count FROM events
    WHERE ts >= {_NOW} - INTERVAL 30 DAY AND CAST(props->>'$.k' AS BIGINT) > 0 GROUP BY ALL HAVING count(*) >= 5
    ORDER BY search_count DESC, query LIMIT 50"""
)
def popular_searches(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = t.events.select(F.concat_ws(" ", "event_type", k % 20).alias("query"), k.alias("results_count"), F.col("ts").alias("created_at"))
    return rank.popular_searches(log, as_of())


@query(
    f"""SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
    count(*) FILTER (event_type = 'click' AND ts >= {_NOW} - INTERVAL 7 DAY) AS clicks_7d, count(*) FILTER (ts >= {_NOW} - INTERVAL 1 DAY) AS events_1d FROM events"""
)
def analytics_report(t: Tables) -> DataFrame:
    click, since = F.col("event_type") == "click", lambda d: F.col("ts") >= as_of() - F.make_dt_interval(F.lit(d))
    return t.events.agg(
        F.count_if(click).alias("clicks"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(click & since(7)).alias("clicks_7d"),
        F.count_if(since(1)).alias("events_1d"),
    )


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10")
def top_clicked_10(t: Tables) -> DataFrame:
    counts = t.events.where(F.col("event_type") == "click").groupBy("user_id").agg(F.count("*").alias("n"))
    return rel.top(counts, 10, F.desc("n"), F.asc("user_id"))


@query("SELECT coalesce(nullif(event_type, 'error'), 'unknown') AS page_type, count(*) AS n FROM events GROUP BY ALL")
def page_type_counts(t: Tables) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("event_type"), F.lit("error")), F.lit("unknown"))
    return t.events.groupBy(kind.alias("page_type")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT CAST(ts AS DATE) AS day, count(*) AS n_calls, CAST(sum(CAST(value AS DECIMAL(10,6))) AS DOUBLE) AS cost FROM events
    WHERE ts >= {_NOW} - INTERVAL 30 DAY AND event_type <> 'error' GROUP BY ALL"""
)
def cost_by_day(t: Tables) -> DataFrame:
    real = t.events.where((F.col("ts") >= as_of() - F.make_dt_interval(F.lit(30))) & (F.col("event_type") != "error"))
    cost = F.sum(F.col("value").cast("decimal(10,6)")).cast("double")
    return real.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n_calls"), cost.alias("cost"))


@query(
    """SELECT event_type AS provider, CAST(props->>'$.k' AS BIGINT) % 3 AS model, count(*) AS n_calls,
    CAST(sum(CAST(value AS DECIMAL(10,6))) AS DOUBLE) AS cost FROM events GROUP BY ALL"""
)
def cost_by_model(t: Tables) -> DataFrame:
    model = F.get_json_object("props", "$.k").cast("bigint") % 3
    cost = F.sum(F.col("value").cast("decimal(10,6)")).cast("double")
    return t.events.groupBy(F.col("event_type").alias("provider"), model.alias("model")).agg(F.count("*").alias("n_calls"), cost.alias("cost"))


@query(
    f"""SELECT CAST(coalesce(sum(CAST(value AS DECIMAL(10,6))), 0) AS DOUBLE) AS total,
    coalesce(CAST(sum(CAST(value AS DECIMAL(10,6))) FILTER (event_type = 'nothing') AS DOUBLE), 0::DOUBLE) AS none,
    round(CAST(sum(CAST(value AS DECIMAL(10,6))) AS DOUBLE) / 50000, 4) AS utilization
    FROM events WHERE ts >= date_trunc('month', {_NOW})"""
)
def cost_month_total(t: Tables) -> DataFrame:
    month = F.trunc(as_of().cast("date"), "MM").cast("timestamp_ntz")
    money = F.col("value").cast("decimal(10,6)")
    total = F.coalesce(F.sum(money).cast("double"), F.lit(0.0))
    none = F.coalesce(F.sum(F.when(F.col("event_type") == "nothing", money)).cast("double"), F.lit(0.0))
    return t.events.where(F.col("ts") >= month).agg(total.alias("total"), none.alias("none"), F.round(total / 50000, 4).alias("utilization"))


@query(
    """SELECT o_custkey AS run_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM orders
    WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY ALL ORDER BY cost DESC, run_id LIMIT 10"""
)
def top_runs(t: Tables) -> DataFrame:
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    cost = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rel.top(recent.groupBy(F.col("o_custkey").alias("run_id")).agg(cost.alias("cost")), 10, F.desc("cost"), F.asc("run_id"))


@query(
    """WITH p(model, price, cached, output) AS (VALUES ('click', 1.5::DOUBLE, 0.5::DOUBLE, 6.0::DOUBLE), ('view', 0.5::DOUBLE, 0.1::DOUBLE, 2.0::DOUBLE)),
    c AS (SELECT event_type AS model, CAST(props->>'$.k' AS BIGINT) * 1000 AS total, CAST(props->>'$.k' AS BIGINT) * 1500 - 60000 AS held, user_id * 10 AS o FROM events),
    f AS (SELECT c.model, price IS NOT NULL AS priced,
      round(((total - greatest(0, least(held, total))) * price + greatest(0, least(held, total)) * cached + o * output) / 1e6::DOUBLE, 6) AS cost
      FROM c LEFT JOIN p USING (model))
    SELECT model, priced, count(*) AS n_calls, round(coalesce(sum(cost), 0::DOUBLE), 4) AS cost FROM f GROUP BY ALL"""
)
def price_table_cost(t: Tables) -> DataFrame:
    """Costs recomputed from a price table; models without a price are counted and cost nothing."""
    spark = t.events.sparkSession
    prices = spark.createDataFrame([("click", 1.5, 0.5, 6.0), ("view", 0.5, 0.1, 2.0)], "model string, price double, cached double, output double")
    k = F.get_json_object("props", "$.k").cast("bigint")
    calls = t.events.select(F.col("event_type").alias("model"), (k * 1000).alias("total"), (k * 1500 - 60000).alias("held"), (F.col("user_id") * 10).alias("out"))
    both = calls.join(F.broadcast(prices), "model", "left")  # a price table: two rows
    cost = token_cost(F.col("total"), F.col("held"), F.col("out"), F.col("price"), F.col("cached"), F.col("output"))
    each = both.select("model", F.col("price").isNotNull().alias("priced"), cost.alias("cost"))
    return each.groupBy("model", "priced").agg(F.count("*").alias("n_calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


@query("SELECT count(*) AS n_groups, coalesce(CAST(sum(c) AS BIGINT), 0) AS n_rows FROM (SELECT p_name, count(*) AS c FROM part GROUP BY p_name HAVING count(*) > 1)")
def duplicate_titles(t: Tables) -> DataFrame:
    groups = t.part.groupBy("p_name").agg(F.count("*").alias("c")).where("c > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"))


@query(
    """SELECT count(*) AS n_docs, count(*) FILTER (quality IS NULL) AS n_without_label, count(*) FILTER (coalesce(toxic, 0) = 1) AS n_toxic,
    count(*) FILTER (length(text) < 60) AS n_short FROM documents LEFT JOIN labels USING (doc_id)"""
)
def missing_meta(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", F.length("text").alias("n")).join(t.labels, "doc_id", "left")
    return both.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("quality").isNull()).alias("n_without_label"),
        F.count_if(F.coalesce("toxic", F.lit(0)) == 1).alias("n_toxic"),
        F.count_if(F.col("n") < 60).alias("n_short"),
    )


@query(
    """WITH s AS (SELECT o_orderpriority AS source_type, count(*) AS generated, count(*) FILTER (o_orderstatus = 'F') AS approved,
    count(*) FILTER (o_orderstatus <> 'O') AS decided FROM orders GROUP BY ALL),
    r AS (SELECT *, round(100.0::DOUBLE * approved / decided, 1) AS approval FROM s)
    SELECT *, generated >= 20 AND approval >= 50.0 AS passes FROM r"""
)
def gate_report(t: Tables) -> DataFrame:
    """Whether each source passes the gate: enough generated, and the rounded approval rate at half or more."""
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("source_type")).agg(
        F.count("*").alias("generated"), F.count_if(F.col("o_orderstatus") == "F").alias("approved"), F.count_if(F.col("o_orderstatus") != "O").alias("decided")
    )
    rated = counts.withColumn("approval", rate(F.col("approved"), F.col("decided"), 1))
    return rated.withColumn("passes", (F.col("generated") >= 20) & (F.col("approval") >= 50.0))


@query(
    """SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS resolved,
    round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'P')), 2) AS acceptance FROM orders GROUP BY ALL"""
)
def acceptance_rate(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("accepted"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("resolved")
    )
    return by.withColumn("acceptance", rate(F.col("accepted"), F.col("resolved")))


@query(
    """WITH e AS (SELECT CAST(props->>'$.k' AS BIGINT) AS issue, event_type, user_id FROM events),
    s AS (SELECT issue, count(DISTINCT user_id) AS delivered, count(DISTINCT user_id) FILTER (event_type = 'view') AS opened,
      count(DISTINCT user_id) FILTER (event_type = 'click') AS clicked FROM e GROUP BY issue)
    SELECT *, round(100.0::DOUBLE * opened / delivered, 2) AS open_rate, round(100.0::DOUBLE * clicked / delivered, 2) AS click_rate FROM s"""
)
def open_click_rate(t: Tables) -> DataFrame:
    """Unique opens and clicks of an issue; rates come from the events, two-phase: first a row for each user and issue."""
    issue = F.get_json_object("props", "$.k").cast("bigint").alias("issue")
    each = t.events.groupBy(issue, "user_id").agg(F.bool_or(F.col("event_type") == "view").alias("o"), F.bool_or(F.col("event_type") == "click").alias("c"))
    s = each.groupBy("issue").agg(F.count("*").alias("delivered"), F.count_if("o").alias("opened"), F.count_if("c").alias("clicked"))
    return s.withColumns({"open_rate": rate(F.col("opened"), F.col("delivered")), "click_rate": rate(F.col("clicked"), F.col("delivered"))})


_SLA_NOW = "TIMESTAMP '2001-08-02 12:00:00'"


def _pending(t: Tables) -> DataFrame:
    age = days_between(F.lit("2001-08-02 12:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.where(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("kind"), age.alias("age_days"))


@query(
    f"""SELECT o_orderpriority AS kind, count(*) AS pending, count(*) FILTER (age > 14) AS overdue, max(age) AS oldest_days FROM
    (SELECT *, CAST(floor(epoch({_SLA_NOW} - o_orderdate) / 86400) AS BIGINT) AS age FROM orders WHERE o_orderstatus = 'O') GROUP BY ALL"""
)
def sla_dashboard(t: Tables) -> DataFrame:
    return _pending(t).groupBy("kind").agg(F.count("*").alias("pending"), F.count_if(F.col("age_days") > 14).alias("overdue"), F.max("age_days").alias("oldest_days"))


@query(
    f"""SELECT o_orderkey AS entry_id, o_orderpriority AS kind, CAST(floor(epoch({_SLA_NOW} - o_orderdate) / 86400) AS BIGINT) AS age_days
    FROM orders WHERE o_orderstatus = 'O' ORDER BY age_days DESC, entry_id LIMIT 10"""
)
def oldest_pending_10(t: Tables) -> DataFrame:
    return rel.top(_pending(t), 10, F.desc("age_days"), F.asc("entry_id"))


@query(
    """SELECT p_partkey AS app_id, array_to_string(list(DISTINCT s_nationkey ORDER BY s_nationkey), ',') AS platforms, count(DISTINCT l_suppkey) AS n
    FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_type = 'SMALL' GROUP BY ALL"""
)
def collect_slugs(t: Tables) -> DataFrame:
    small = t.part.where(F.col("p_type") == "SMALL").select(F.col("p_partkey").alias("app_id"))
    links = rel.having_any(views.bridge(t), small, "app_id").join(t.supplier, F.col("platform_id") == F.col("s_suppkey"))
    lists = F.transform(F.array_sort(F.collect_set("s_nationkey")), lambda x: x.cast("string"))
    return links.groupBy("app_id").agg(F.concat_ws(",", lists).alias("platforms"), F.count("*").alias("n"))


@query(
    f"""WITH c AS ({views.CAPABILITIES_SQL}), k AS (SELECT unnest(range(1, 8)) AS capability)
    SELECT p_partkey AS app_id, string_agg(k.capability || '=' || coalesce(value, 'unknown'), ';' ORDER BY k.capability) AS caps,
    count(*) FILTER (coalesce(value, 'unknown') <> 'unknown') AS n_explicit
    FROM part CROSS JOIN k LEFT JOIN c ON c.app_id = p_partkey AND c.capability = k.capability WHERE p_size > 40 GROUP BY ALL"""
)
def capability_map_padded(t: Tables) -> DataFrame:
    """A map of all capabilities for each app; what it lacks is unknown."""
    from ..functions.values import padded_map

    own = t.part.where("p_size > 40").select(F.col("p_partkey").alias("app_id"))
    known = rel.having_any(views.capabilities(t), own, "app_id").groupBy("app_id").agg(F.map_from_entries(F.collect_list(F.struct("capability", "value"))).alias("m"))
    keys = F.sequence(F.lit(1), F.lit(7))
    empty = F.create_map().cast("map<int,string>")
    whole = own.join(known, "app_id", "left").select("app_id", padded_map(F.coalesce("m", empty), keys).alias("m"))
    text = F.concat_ws(";", F.transform(keys, lambda k: F.concat(k.cast("string"), F.lit("="), F.element_at("m", k))))
    explicit = F.size(F.filter(F.map_values("m"), lambda v: v != "unknown")).cast("bigint")
    return whole.select("app_id", text.alias("caps"), explicit.alias("n_explicit"))


@query(
    f"""WITH c AS (SELECT user_id AS app_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND ts >= {_NOW} - INTERVAL 7 DAY GROUP BY ALL ORDER BY clicks DESC, app_id LIMIT 10),
    n AS (SELECT o_orderkey AS app_id, o_orderdate AS added_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)
    SELECT app_id, CAST(row_number() OVER (ORDER BY clicks DESC, app_id) AS INTEGER) AS place, 'trending' AS part FROM c
    UNION ALL SELECT app_id, CAST((SELECT count(*) FROM c) + row_number() OVER (ORDER BY added_at DESC, app_id) AS INTEGER), 'new' FROM n"""
)
def newsletter_order(t: Tables) -> DataFrame:
    """Places of a weekly issue: trending apps first, new ones numbered on."""
    recent = t.events.where((F.col("event_type") == "click") & (F.col("ts") >= as_of() - F.make_dt_interval(F.lit(7))))
    clicks = recent.groupBy(F.col("user_id").alias("app_id")).agg(F.count("*").alias("clicks"))
    return rank.issue_order(clicks, t.orders.select(F.col("o_orderkey").alias("app_id"), F.col("o_orderdate").alias("added_at")))


@query(
    """SELECT p_partkey AS app_id, coalesce(n, 0) AS n_clicks FROM part LEFT JOIN (SELECT user_id, count(*) AS n FROM events
    WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-24' GROUP BY user_id) e ON user_id = p_partkey
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND coalesce(n, 0) > 0 ORDER BY n_clicks DESC, app_id LIMIT 10"""
)
def weekly_digest(t: Tables) -> DataFrame:
    week = t.events.where((F.col("event_type") == "click") & (F.col("ts") >= as_of() - F.make_dt_interval(F.lit(7))))
    counts = week.groupBy(F.col("user_id").alias("app_id")).agg(F.count("*").alias("n_clicks"))
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("app_id"))
    known = counts.join(views.apps(t).select("app_id"), "app_id")
    return rel.top(rel.having_any(known, returned, "app_id").select("app_id", "n_clicks"), 10, F.desc("n_clicks"), F.asc("app_id"))


@query(
    """SELECT n_name AS use_case, count(c_custkey) AS app_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY ALL"""
)
def use_case_counts(t: Tables) -> DataFrame:
    counts = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.join(counts, "n_nationkey", "left").select(F.col("n_name").alias("use_case"), F.coalesce("n", F.lit(0)).alias("app_count"))


@query(
    """WITH d AS (SELECT o_orderpriority AS kind, CAST(floor(epoch(TIMESTAMP '2001-08-02 12:00:00' - o_orderdate) / 86400) AS BIGINT) AS days FROM orders WHERE o_orderstatus = 'F')
    SELECT kind, median(days) AS median_days, count(*) AS n FROM d GROUP BY kind"""
)
def decision_time(t: Tables) -> DataFrame:
    """Median days to a decision of each kind: exact, as Spark keeps counts of distinct days."""
    age = days_between(F.lit("2001-08-02 12:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    done = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderpriority").alias("kind"), age.alias("days"))
    return done.groupBy("kind").agg(F.median("days").alias("median_days"), F.count("*").alias("n"))
