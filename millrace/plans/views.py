"""The catalog's roles over the tables at hand: parts are apps, suppliers platforms, events clicks and probes."""

from __future__ import annotations

import difflib
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables

#: Weight of an event type, in the role of the page that a click came from.
EVENT_WEIGHTS = {"click": 1.2, "view": 0.8, "purchase": 1.1, "signup": 1.0}


def apps(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("developer"),
        F.col("p_type").alias("category"),
        F.least(F.lit(100), F.col("p_size") * 2).alias("quality_score"),
    )


def clicks(t: Tables) -> DataFrame:
    kept = t.events.where(F.col("event_type") != "error")
    return kept.select(F.col("user_id").alias("app_id"), F.col("event_type").alias("source_page"), F.col("ts").alias("created_at"))


def probes(t: Tables) -> DataFrame:
    """Link probes: an error is a failure; the target is the parity of the event's number in props."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select("event_id", F.col("user_id").alias("app_id"), F.when(k % 2 == 0, "official").otherwise("install").alias("target"), "ts", (F.col("event_type") != "error").alias("ok"))


def bridge(t: Tables) -> DataFrame:
    """Apps on platforms: distinct (app_id, platform_id)."""
    return t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_suppkey").alias("platform_id")).distinct()


def capabilities(t: Tables) -> DataFrame:
    """(app_id, capability, value) with the least value of yes, no, unknown by name; capabilities are order priorities' stand-ins, line numbers."""
    value = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "no").otherwise("unknown")
    rows = t.lineitem.select(F.col("l_partkey").alias("app_id"), F.col("l_linenumber").alias("capability"), value.alias("value"))
    return rows.groupBy("app_id", "capability").agg(F.max("value").alias("value"))


CAPABILITIES_SQL = """SELECT l_partkey AS app_id, l_linenumber AS capability,
  max(CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'unknown' END) AS value
  FROM lineitem GROUP BY ALL"""
PROBES_SQL = """SELECT event_id, user_id AS app_id,
  CASE WHEN CAST(props->>'$.k' AS BIGINT) % 2 = 0 THEN 'official' ELSE 'install' END AS target, ts, event_type <> 'error' AS ok
  FROM events"""


def part_names() -> list[str]:
    """All names that parts have."""
    nouns = ("ring", "bolt", "widget", "plate", "rod", "anvil", "gear", "gizmo")
    return [f"{a} {b}" for a, b in product(("blue", "red", "cold", "small", "hot", "old", "new", "large"), nouns)]


def ratios_sql(left: list[str], right: list[str], least: float) -> str:
    """VALUES (a, b, ratio) of names with a matching-block ratio of at least `least`, which SQL does not have."""
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
    rows = ((a, b, ratio(a, b)) for a, b in product(left, right))
    return "VALUES " + ", ".join(f"('{a}', '{b}', {r}::DOUBLE)" for a, b, r in rows if r >= least)
