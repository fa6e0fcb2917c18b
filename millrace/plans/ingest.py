"""Ingest: records to drafts, dead letters and upsert outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, relational as rel
from ..sources import registry
from ..tables import Tables
from .registry import query


def _records(t: Tables) -> DataFrame:
    """Registry records made of events: wrapped ones, ones without a name, and broken ones."""
    k = F.get_json_object("props", "$.k").cast("int")
    inner = F.struct(
        F.concat(F.lit("srv-"), "event_id").alias("id"),
        F.when(k % 11 != 0, F.concat("event_type", F.lit("  tool"))).alias("name"),
        F.concat(F.lit("made of "), "props").alias("description"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit("sse").alias("type"), F.lit("https://r.example/").alias("url")))).alias("remotes"),
    )
    text = F.when(k % 13 == 0, F.lit("[1, 2]")).when(k % 3 == 0, F.to_json(F.struct(inner.alias("server")))).otherwise(F.to_json(inner))
    return t.events.select(F.col("event_id").alias("place"), text.alias("record"))


_K = "SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events"


@query(
    f"""SELECT event_id AS place, CASE WHEN k % 11 <> 0 THEN event_type || ' tool' ELSE 'srv-' || event_id END AS name, 'srv-' || event_id AS external_id,
    'made of ' || props AS short_description, CASE WHEN k % 2 = 0 THEN 'sse' ELSE '' END AS transports, CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'unknown' END AS remote
    FROM ({_K}) WHERE k % 13 <> 0"""
)
def json_normalize_drafts(t: Tables) -> DataFrame:
    good, _ = registry.split(registry.registry_drafts(_records(t)))
    return good.select("place", "name", "external_id", "short_description", F.concat_ws(",", "transports").alias("transports"), F.col("capabilities")["remote"].alias("remote"))


@query(f"SELECT event_id AS place, '[1, 2]' AS record, 'not an object' AS error FROM ({_K}) WHERE k % 13 = 0")
def json_dead_letter(t: Tables) -> DataFrame:
    return registry.split(registry.registry_drafts(_records(t)))[1]


@query(f"SELECT count(*) AS n, count(*) FILTER (k % 13 = 0) AS n_failed, count(*) FILTER (k % 13 = 0) >= 0.1 * count(*) AS alert FROM ({_K})")
def ingest_alert(t: Tables) -> DataFrame:
    return registry.failure_alert(registry.registry_drafts(_records(t)))


@query(
    """SELECT c_custkey AS draft_id, CASE WHEN c_custkey % 3 = 0 AND s_suppkey IS NOT NULL THEN 'updated' WHEN p_partkey IS NOT NULL THEN 'skipped' ELSE 'new' END AS outcome,
    coalesce(CASE WHEN c_custkey % 3 = 0 THEN s_suppkey + 1000000 END, p_partkey) AS app_id
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey AND p_size > 25"""
)
def upsert_outcomes(t: Tables) -> DataFrame:
    drafts = t.customer.select(F.col("c_custkey").alias("draft_id"), F.lit("registry").alias("source_type"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise("").alias("external_id"))
    sources = t.supplier.select(F.lit("registry").alias("source_type"), F.col("s_suppkey").cast("string").alias("external_id"), (F.col("s_suppkey") + 1_000_000).alias("app_id"))
    matches = t.part.where("p_size > 25").select(F.col("p_partkey").alias("draft_id"), F.col("p_partkey").alias("app_id"))
    return merge.upsert_outcomes(drafts, sources, matches)


@query(
    """SELECT CASE WHEN c_custkey % 3 = 0 AND s_suppkey IS NOT NULL THEN 'updated' WHEN p_partkey IS NOT NULL THEN 'skipped' ELSE 'new' END AS outcome, count(*) AS n
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey AND p_size > 25 GROUP BY ALL"""
)
def ingest_counters(t: Tables) -> DataFrame:
    return upsert_outcomes(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT p_type AS kind, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') GROUP BY ALL")
def discovery_batch(t: Tables) -> DataFrame:
    """Candidates that no source has seen, counted by class."""
    seen = t.lineitem.where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return rel.having_none(t.part, seen, "p_partkey").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT page_id FROM pages WHERE page_id IN (SELECT doc_id FROM documents WHERE length(text) > 500) AND page_id NOT IN (SELECT doc_id FROM labels) ORDER BY page_id LIMIT 20"""
)
def pending_enrichment(t: Tables) -> DataFrame:
    """Rows with a source to read and no result yet, oldest first."""
    own = t.pages.select(F.col("page_id").alias("doc_id"))
    due = rel.having_none(rel.having_any(own, t.documents.where(F.length("text") > 500).select("doc_id"), "doc_id"), t.labels.select("doc_id"), "doc_id")
    return rel.top(due.select(F.col("doc_id").alias("page_id")), 20, F.asc("page_id"))


@query(
    """WITH o AS (SELECT o_custkey, min(o_orderdate) AS oldest FROM orders WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL)
    SELECT c_custkey, oldest FROM customer JOIN o ON o_custkey = c_custkey ORDER BY oldest, c_custkey LIMIT 20"""
)
def overdue_reactualization(t: Tables) -> DataFrame:
    """Apps with an active source that is itself overdue, the oldest first."""
    old = t.orders.where((F.col("o_orderstatus") != "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    due = old.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("oldest"))
    return rel.top(t.customer.select("c_custkey").join(due, "c_custkey"), 20, F.asc_nulls_first("oldest"), F.asc("c_custkey"))
