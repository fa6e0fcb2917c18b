"""Operators on small hand-made rows: nulls, ties, repeats, empty tables."""

import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from millrace.functions import text as tx, values as v
from millrace.operators import identity, merge, rank, relational as rel, rules, search, state


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_slugs(spark):
    assert one(spark, "  Crème Brûlée -- 2.0! ", tx.slugify) == "creme-brulee-20"
    assert one(spark, "__a b__", tx.slugify) == "a-b"
    assert one(spark, "日本", tx.slugify) == ""
    assert one(spark, None, tx.slugify) is None


def test_urls(spark):
    assert one(spark, "HTTPS://www.Example.com:80/A/b/?q#f", tx.url_identity) == "example.com/a/b"
    assert one(spark, "example.com", tx.url_identity) == "example.com/"
    assert one(spark, "", tx.url_identity) == ""
    assert one(spark, "https://github.com/Own/Repo.git/tree", tx.repo_identity) == "github.com/own/repo"
    assert one(spark, "https://github.com/own", tx.repo_identity) == ""
    assert one(spark, "https://a.b/x", tx.is_http_url) is True
    assert one(spark, None, tx.is_http_url) is False
    assert one(spark, "9.9.9.9, 1.1.1.1", lambda c: tx.client_ip(c, F.lit("r"))) == "9.9.9.9"


def test_text(spark):
    assert one(spark, "<p>a &amp;lt; b</p>\n<b>c</b>", tx.stripped_html) == "a &lt; b c"
    assert one(spark, "One. Two!", tx.first_sentence) == "One."
    assert one(spark, "x\n\ny long enough. z\n\nw", lambda c: tx.first_other_paragraph(c, F.lit("x"), 5)) == "y long enough."
    assert one(spark, "short", lambda c: tx.low_information(c, ("ok",), ("draft",))) is True
    assert sorted(one(spark, "Cat", tx.trigrams)) == ["  c", " ca", "at ", "cat"]


def test_maps_and_rules(spark):
    df = spark.sql("select map('a','1') old, map('a','2','b','3') new, cast(null as map<string,string>) none")
    row = df.select(v.merged_map(F.col("old"), F.col("new")).alias("m"), v.merged_map(F.col("none"), F.col("new")).alias("n"), v.padded_map(F.col("old"), F.array(F.lit("a"), F.lit("z"))).alias("p")).first()
    assert row.m == {"a": "1", "b": "3"} and row.n == {"a": "2", "b": "3"} and row.p == {"a": "1", "z": "unknown"}
    got = spark.range(1).select(v.named_failures([("x", F.lit(True)), ("y", F.lit(None).cast("boolean")), ("x", F.lit(True))]).alias("b")).first().b
    assert got == ["x"]


def test_token_cost(spark):
    row = spark.sql("select 100 t, 500 c, 10 o").select(v.token_cost(F.col("t"), F.col("c"), F.col("o"), F.lit(2.0), F.lit(1.0), F.lit(4.0)).alias("x")).first()
    assert row.x == 0.00014  # cached tokens never exceed the total


def test_trending_without_clicks(spark):
    apps = spark.createDataFrame([(1, 50), (2, 0)], "app_id bigint, quality_score int")
    clicks = spark.createDataFrame([(1, "home", dt.datetime(2024, 1, 1))], "app_id bigint, source_page string, created_at timestamp_ntz")
    rows = {r.app_id: r for r in rank.trending(apps, clicks, F.lit("2024-01-02").cast("timestamp_ntz")).collect()}
    assert rows[1].score_1d == 0.25 and rows[2].score_30d == 0.0
    empty = rank.trending(apps, clicks.limit(0), F.lit("2024-01-02").cast("timestamp_ntz"))
    assert {r.app_id: r.score_7d for r in empty.collect()} == {1: 0.5, 2: 0.0}


def test_streaks_and_health(spark):
    base = dt.datetime(2024, 1, 1)
    oks = [0, 0, 1, 0, 0, 0, 0, 1]
    probes = spark.createDataFrame([(i, 1, "t", base + dt.timedelta(hours=i), bool(o)) for i, o in enumerate(oks)], "event_id bigint, app_id bigint, target string, ts timestamp, ok boolean")
    s = state.failure_streaks(probes, ["app_id", "target"], "ts", "event_id")
    assert [r.consecutive_failures for r in s.orderBy("event_id").collect()] == [1, 2, 0, 1, 2, 3, 4, 0]
    assert [r.event_id for r in state.crossings(s, 2).orderBy("event_id").collect()] == [1, 4]
    h = state.link_health(s, ["app_id", "target"], "ts", "event_id", 4).first()
    assert h.consecutive_failures == 0 and h.deprecated and h.last_failed_at == base + dt.timedelta(hours=6)


def test_latches_follow_the_running_total(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=rng.randrange(60 * 24 * 28)), rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, c bigint").withColumn("c", F.col("c").cast("decimal(10,6)"))
    got = state.budget_latches(df, F.lit(10000).cast("decimal(10,2)"), "ts", "id", "c").first()
    total, stamps = 0, {}
    for i, ts, c in sorted(rows, key=lambda r: (r[1], r[0])):
        total += c
        for share in (0.8, 1.0):
            if total >= 10000 * share:
                stamps.setdefault(share, ts)
    assert (got.discovery_disabled_at, got.hard_stop_at) == (stamps.get(0.8), stamps.get(1.0)) and float(got.total) == total
    assert state.budget_latches(df, F.lit(0).cast("decimal(10,2)"), "ts", "id", "c").first().hard_stop_at is None


def test_throttle_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), dt.datetime.fromtimestamp(rng.randrange(2000), dt.UTC).replace(tzinfo=None)) for i in range(200)]
    got = {r.i: r.start_us for r in state.throttled(spark.createDataFrame(rows, "i bigint, h string, ts timestamp_ntz"), "h", "ts", "i", 5_000_000).collect()}
    free: dict[str, int] = {}
    for i, h, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        t = int(ts.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
        begin = max(t, free.get(h, t))
        free[h] = begin + 5_000_000
        assert got[i] == begin


def test_division_and_pages(spark):
    left = spark.createDataFrame([(1,), (2,)], "k bigint")
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "b")], "k bigint, item string")
    assert [r.k for r in rel.having_all(left, pairs, "k", "item", ["a", "b"]).collect()] == [1]
    assert rel.having_all(left, pairs, "k", "item", []).count() == 2
    assert [r.id for r in rel.page(spark.range(10), 2, 3, F.asc("id")).collect()] == [3, 4, 5]
    assert rel.page(spark.range(10), 0, 1000, F.asc("id")).count() == 10
    assert rel.last_valid_page(10, 99, 4) == 3 and rel.last_valid_page(0, 5, 4) == 1


def test_search_falls_back(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, None)], "id bigint, name string")
    index = search.postings(docs, "id", {"A": ["name"]})
    assert [(r.id, r.rank) for r in search.search(docs, index, "id", "name", "ring").collect()] == [(1, 1.0)]
    assert [r.id for r in search.search(docs, index, "id", "name", "rng").collect()] == []
    assert [r.id for r in search.search(docs, index, "id", "name", "blu").collect()] == [2]
    assert search.match(index, "id", "the").count() == 0


def test_strong_and_weak_matches(spark):
    cols = "id bigint, name string, slug_hint string, developer_url string, official_page_url string, install_url string, repo_url string, official_directory_url string, q int"
    apps = spark.createDataFrame(
        [(1, "Alpha Tool", "", "https://dev.example", "", "", "https://github.com/o/r", "", 5), (2, "Beta", "", "https://x.example/", "", "", "", "", 9), (3, None, None, None, None, None, None, None, 1)], cols
    ).withColumnRenamed("id", "app_id")
    drafts = spark.createDataFrame(
        [
            (10, "Other", "", "", "", "", "http://github.com/O/R.git", "", 0),
            (11, "Beta", "", "", "", "", "", "", 0),
            (12, "Alpha Tools", "", "https://www.dev.example/about", "", "", "", "", 0),
            (13, "Zed", "", "https://dev.example/z", "", "", "", "", 0),
        ],
        cols,
    ).withColumnRenamed("id", "draft_id").drop("q")
    got = {r.draft_id: (r.app_id, r.kind) for r in identity.strong_matches(drafts, apps, [F.desc("q")]).collect()}
    assert got == {10: (1, 1), 11: (2, 4), 12: (1, 3)}
    pairs = spark.createDataFrame([(1, 2, "alpha one", "alpha two"), (1, 3, "same name", "same name")], "a bigint, b bigint, x string, y string")
    weak = identity.weak_matches(pairs, "a", "b", F.col("x"), F.col("y"), F.lit(True)).collect()
    want = {2: round(difflib.SequenceMatcher(None, "alpha one", "alpha two").ratio(), 6), 3: 1.0}
    assert {r.b: r.score for r in weak} == {k: s for k, s in want.items() if s >= 0.65}


def test_merge_never_overwrites(spark):
    current = spark.createDataFrame([(1, "", "x"), (2, "y", None)], "k bigint, a string, b string")
    new = spark.createDataFrame([(1, "A", "B"), (2, "A", "B")], "k bigint, a string, b string")
    assert {tuple(r) for r in merge.fill_empty(current, new, "k", ["a", "b"]).collect()} == {(1, "A", "x"), (2, "y", "B")}
    acts = {(r.k, r.field): r.action for r in merge.merge_actions(current, new, "k", ["a", "b"]).collect()}
    assert acts == {(1, "a"): "fill", (1, "b"): "review", (2, "a"): "review", (2, "b"): "fill"}
    assert merge.fill_empty(current.limit(0), new, "k", ["a"]).count() == 0


def test_primary_and_repoint(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (1, 8, 3)], "owner bigint, item bigint, id bigint")
    moves = spark.createDataFrame([(2, 1)], "source bigint, target bigint")
    assert {tuple(r) for r in identity.repointed(rows, "owner", "item", moves).select("owner", "item", "id").collect()} == {(1, 7, 1), (1, 8, 3)}
    flags = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 3, False)], "owner bigint, id bigint, is_primary boolean")
    assert {r.id for r in identity.one_primary(flags, "owner").where("is_primary").collect()} == {1}


def test_decisions_of_nothing(spark):
    empty = rules.decided(spark.range(0), [("x", F.lit(True))])
    assert rules.decision_report(empty, "n_ok").first().asDict() == {"evaluated": 0, "n_ok": 0}
    assert rules.blocker_counts(empty).count() == 0


def test_first_match_of_every_draft(spark):
    """No draft is left out by its id, and rows before and after the reduction to the best app of a key are the same."""
    from millrace.plans import registry

    sf = "/root/testdata/sf0.01"
    got = {r.draft_id: r.app_id for r in registry.queries()["first_match_wins_all"](spark, sf).collect()}
    best = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").orderBy(F.desc("p_size"), "p_partkey").collect():
        best.setdefault(r.p_name, r.p_partkey)
    names = ("small", "red", "blue", "hot", "green")
    keys = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    assert max(got) >= 300 and got == {k: best[n] for k in keys if (n := f"{names[k % 5]} ring") in best}


def test_similar_items_over_the_whole_bridge(spark):
    from millrace.plans import registry
    from tests.parity import connect, difference

    sf = "/root/testdata/sf0.01"
    name = "similar_items_top6_all"
    assert difference(registry.queries()[name](spark, sf), connect(sf).sql(registry.oracle_sql()[name])) is None


def test_similar_names_by_brute_force(spark, tmp_path):
    """Every pair that the rules of weak_top5 and ratio_name_pairs take, among names that share no word too."""
    from millrace.plans import registry

    named = ["cold ring", "old ring", "cold plate", "old bolt", "old plate", "cold bolt", "a much longer name of an app", "a much longer nameof anapp", "much longer name of an app", "x", "xy"]
    rows = [(i, n, f"Brand#{i % 3}") for i, n in enumerate(named)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        parts = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("brand")).collect()
        ratio = {(a.id, b.id): round(difflib.SequenceMatcher(None, b.p_name, a.p_name).ratio(), 6) for a in parts for b in parts if a.id != b.id}
        brand, name = {r.id: r.brand for r in parts}, {r.id: r.p_name for r in parts}
        weak = {}
        for (a, b), r in ratio.items():
            if r >= 0.92 or brand[a] == brand[b] and r >= 0.65:
                weak.setdefault(a, []).append((-r, b))
        want = {(a, b, -r, k) for a, found in weak.items() for k, (r, b) in enumerate(sorted(found)[:5], 1)}
        assert {tuple(r) for r in registry.queries()["weak_top5"](spark, sf).collect()} == want
        got = {(r.k1, r.k2): r.ratio for r in registry.queries()["ratio_name_pairs"](spark, sf).collect()}
        first = lambda k: name[k].split(" ")[0]
        assert got == {(a, b): ratio[b, a] for a, b in ratio if a < b and (ratio[b, a] >= 0.92 or first(a) == first(b))}


def test_related_pairs_are_dealt_once(spark):
    import re

    from millrace.operators import relational as rel

    bridge = spark.createDataFrame([(1, 7, 3), (2, 7, 9), (3, 7, 1), (1, 8, 3), (2, 8, 9)], "app bigint, via bigint, size int")
    top = rel.related_top(bridge, "app", "via", 1, "-size")
    assert sorted((r.app, r.other) for r in top.collect()) == [(1, 2), (2, 1), (3, 2)]
    assert "hashpartitioning(app#" in (plan := top._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(app#\w+, other#", plan)
