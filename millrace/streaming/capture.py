"""Captured clicks as a stream: checked against the app's links, stored once, and latched.

A click counts if its address is http or https and one of the app's links of its type, by a join of the stream with the table of
links as it is when a batch runs. Batches go to a snapshot table, each to a slot of its own number, so a batch that runs
again after a failure replaces itself and every click is stored once. Latches hold a running total for each key in state
and fire once, in the order of time and number within a batch, however often the stream is stopped and started again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import is_http_url
from ..sinks.snapshots import Snapshots

#: The longest texts that a click keeps.
KEPT = {"source_page": 100, "referer": 500, "user_agent": 1000}


def checked(clicks: DataFrame, links: DataFrame) -> DataFrame:
    """clicks (app_id, link_type, url, ...) of a stream or table whose link is one of the app's (app_id, link_type, url); texts of
    KEPT are cut, and a position that is no whole number becomes null."""
    known = links.select("app_id", "link_type", F.trim("url").alias("url")).distinct()
    own = clicks.withColumn("url", F.trim("url")).where(is_http_url(F.col("url"))).join(known, ["app_id", "link_type", "url"], "left_semi")
    own = own.select(*clicks.columns).withColumns({c: F.left(F.coalesce(c, F.lit("")), F.lit(n)) for c, n in KEPT.items() if c in clicks.columns})
    return own.withColumn("source_position", F.expr("try_cast(source_position as int)")) if "source_position" in clicks.columns else own


def stored(stream: DataFrame, store: Snapshots, name: str, checkpoint: str):
    """A query that adds each micro-batch to a table of snapshots, once: batch n is slot n."""

    def run(batch: DataFrame, number: int) -> None:
        again = {name: [str(number)]}
        store.commit(slotted={name: (batch.withColumn("batch", F.lit(str(number))), "batch")}, emptied=again)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


LATCHED = "key string, latch string, at timestamp, event_id bigint, total bigint"


def latches(costs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The moments at which the running total of a key first reaches each limit: a stream (key, event_id, ts, cost) of whole
    numbers (micros, say). The state of a key is its total and the latches that have fallen; a limit of 0 never falls."""
    names = sorted(n for n, limit in limits.items() if limit > 0)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, fallen = state.get if state.exists else (0, "")
        done, rows = set(filter(None, fallen.split("\n"))), []
        for event in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            total += int(event.cost)
            for name in names:
                if name not in done and total >= limits[name]:
                    done.add(name)
                    rows.append((key[0], name, event.ts, event.event_id, total))
        state.update((total, "\n".join(sorted(done))))
        yield pd.DataFrame(rows, columns=["key", "latch", "at", "event_id", "total"])

    return costs.groupBy("key").applyInPandasWithState(step, LATCHED, "total bigint, fallen string", "append", GroupStateTimeout.NoTimeout)


def latches_of_table(costs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The same of a table, spread over ranges of time however many rows a key has."""
    from ..operators.scan import running_total

    total = running_total(costs, ["key"], ["ts", "event_id"], "cost")
    first = [F.min(F.when(F.col("total") >= limit, F.struct("ts", "event_id", "total"))).alias(n) for n, limit in limits.items() if limit > 0]
    each: list[Column] = [F.struct(F.lit(n).alias("latch"), F.col(n).alias("first")) for n, limit in limits.items() if limit > 0]
    rows = total.groupBy("key").agg(*first).select("key", F.inline(F.array(*each))).where("first is not null")
    return rows.select("key", "latch", F.col("first.ts").alias("at"), "first.event_id", "first.total")
