"""Sources, sinks, streaming forms and rules on small hand-made rows."""

import datetime as dt
import difflib
import re
from html import unescape
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import text as tx
from millrace.operators import apply, identity, rules, search, state as batch, trust
from millrace.sinks import tables as sink
from millrace.sources import html_directory, pages, registry
from millrace.streaming import state
from tests.test_streaming import drain, landed

BASE = dt.datetime(2024, 1, 1)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_configure(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    assert session.configure(spark).conf.get("spark.sql.mapKeyDedupPolicy") == "LAST_WIN"


def test_pages_follow_text_cursors(spark):
    found = {("a", None): '{"servers": [{"name": "x"}], "next_cursor": "2"}', ("a", "2"): '{"metadata": {"nextCursor": 7}, "servers": []}', ("b", None): "[1]", ("d", None): '{"metadata": {"nextCursor": "z"}}'}
    got = pages.read_pages(spark, ["a", "b", "c", "d"], lambda url, cursor: found[url, cursor]).collect()
    assert sorted((r.url, r.page, r.error and r.error.split(":")[0]) for r in got) == [("a", 1, None), ("a", 2, None), ("b", 1, "not an object"), ("c", 1, "KeyError"), ("d", 1, None), ("d", 2, "KeyError")]
    raw = spark.createDataFrame([(t,) for t in ['{"next_cursor": "n"}', '{"next_cursor": 5, "metadata": {"nextCursor": "x"}}', '{"next_cursor": null, "metadata": {"nextCursor": "x"}}', '{"metadata": {"nextCursor": 3}}', "{}", "broken", None]], "raw string")
    assert [r[0] for r in raw.select(registry.next_cursor(F.col("raw"))).collect()] == ["n", None, "x", None, None, None, None]


def test_html_cards_by_patterns(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = set()
    for r in rows:
        seen = set()
        for place, (attrs, name) in enumerate((a, n) for a, n in re.findall(r"<a\b([^>]*)>(.*?)</a>", r.html, re.S) if re.search(r'href="[^"]+"', a) and re.sub("<[^>]+>", "", n).strip()):
            url = urljoin(r.url, unescape(re.search(r'href="([^"]*)"', attrs)[1]))
            if url not in seen:
                seen.add(url)
                want.add((r.page_id, place, " ".join(unescape(re.sub("<[^>]+>", "", name)).split()), url))
    got = html_directory.cards(spark.read.parquet(f"{sf}/pages.parquet"), "page_id")
    assert set(values(got, "page_id", "place", "name", "detail_url")) == want and want


def test_details_of_broken_pages(spark):
    rows = [(1, "http://d/1", "<title> A  page</title><dl><dt>Developer<dd> Me </dl><p>One.<p>Two."), (2, None, None), (3, "http://d/3", ""), (3, "http://d/3", "<h1>Late</h1>")]
    df = spark.createDataFrame(rows, "page int, url string, html string")
    got = {(r.page, r.title): (r.info, r.paragraphs) for r in html_directory.details(df, "page").collect()}
    assert got[1, "A page"] == ({"developer": "Me"}, ["One.", "Two."]) and got[2, ""] == got[3, ""] == ({}, [])
    listed = spark.createDataFrame([("http://d/1", "A", "reads"), ("http://d/9", "B", None)], "detail_url string, name string, summary string")
    drafts = {r.name: r for r in html_directory.detail_drafts(html_directory.with_details(listed, html_directory.details(df, "page")), "dir", {}).collect()}
    assert drafts["A"].developer_name == "Me" and drafts["A"].capabilities == {"read": "yes"} and drafts["B"].long_description == ""


def test_first_seen_cards(spark):
    rows = [(1, "u", "s", "A"), (2, "u", "t", "B"), (3, "", "s", "C"), (4, None, "s", "D"), (5, "", "", "E"), (6, "", "", "E")]
    df = spark.createDataFrame(rows, "k int, detail_url string, slug string, name string")
    assert sorted(values(html_directory.first_seen_cards(df, [F.asc("k")]), "k")) == [(1,), (3,), (5,)]


def test_unique_slugs_pass_over_taken_numbers(spark):
    rows = [(1, "red"), (2, "red"), (3, "red"), (4, "red-2"), (5, "red-3"), (6, "red-2"), (7, ""), (8, None), (9, "x" * 200), (10, "x" * 200), (11, "red-02")]
    got = dict(values(identity.unique_slugs(spark.createDataFrame(rows, "k int, base string"), "k", "base"), "k", "slug"))
    assert got == {1: "red", 2: "red-4", 3: "red-5", 4: "red-2", 5: "red-3", 6: "red-2-2", 7: "app", 8: "app-2", 9: "x" * 200, 10: "x" * 198 + "-2", 11: "red-02"}


def test_close_pairs_lose_none(spark):
    names = ["cold ring", "old ring", "cold rings", "ring", "brass ring", "brass rings", "b", "", "gold ring", "goldring"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    got = {tuple(sorted(p)) for p in values(identity.close_pairs(df, "k", "name"), "k1", "k2")}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            if a and b and max(ratio(a, b), ratio(b, a)) >= identity.WEAK:
                assert (j, i) in got, (a, b)


def test_similar_pairs_lose_none(spark):
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in ("alpha", "alpine", "beta", "betas", "gamma") for b in ("one", "ones", "two", "once"))] + [(99, "!!!")]
    df = spark.createDataFrame(rows, "k int, t string")
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)} if t != "!!!" else set()
    want = set()
    for i, a in rows:
        for j, b in rows:
            both = grams(a) | grams(b)
            if i < j and both and len(grams(a) & grams(b)) / len(both) > 0.35:
                want.add((i, j))
    assert set(values(search.similar_pairs(df, "k", "t", 0.35), "k1", "k2")) == want and want


def test_shared_domains(spark):
    urls = {c: "" for c in identity.URLS}
    make = lambda rows, key: spark.createDataFrame([(k, *({**urls, **u}[c] for c in identity.URLS)) for k, u in rows], f"{key} int, " + ", ".join(f"{c} string" for c in identity.URLS))
    a = make([(1, {"repo_url": "https://www.a.example/x", "install_url": "https://hub.example/1"}), (2, {"repo_url": "https://hub.example/2"})], "a")
    b = make([(7, {"developer_url": "http://A.example", "install_url": "https://hub.example/3"})], "b")
    assert values(identity.shared_domains(a, b, "a", "b", ignored=("hub.example",)), "a", "b", "domains") == [(1, 7, ["a.example"])]


def test_text_columns(spark):
    df = spark.createDataFrame([("<b>A&#66;&#x43;</b> &amp; &#0; &#xD800; &#128512; &nbsp;x", "tool by Acme Corp., now", "see (https://a.example/b) and c", "a b/c~d", 0.256)], "h string, d string, u string, q string, p double")
    got = df.select(tx.stripped_html(F.col("h")), tx.developer_named(F.col("d")), tx.first_address(F.col("u")), tx.url_quoted(F.col("q")), tx.percent_label(F.col("p")), tx.percent_label(F.lit(None).cast("double"))).first()
    assert tuple(got) == ("ABC & &#0; &#xD800; 😀 x", "Acme Corp., now", "https://a.example/b", "a%20b/c~d", "25.6%", "—")
    words = ["parties", "boxes", "glasses", "rings", "bus", "glass", "running", "string", "red", "wanted", "is", "apps", "matching"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(tx.stemmed(F.col("w"))).collect()]
    assert got == ["party", "box", "glass", "ring", "bus", "glass", "runn", "string", "red", "want", "is", "app", "match"]
    assert got == [search.lexemes(w, True)[0] if search.lexemes(w, True) else w for w in words]


def test_sort_order(spark):
    df = spark.createDataFrame([(1, "b", 5, 1, 0.1), (2, "a", 9, 2, 0.1), (3, "c", 5, 3, 0.9)], "app_id int, name string, quality_score int, first_seen_at int, rank double")
    order = lambda *how: [r.app_id for r in df.orderBy(*search.sort_order(*how)).collect()]
    assert order("relevance", "q") == [3, 2, 1] and order("relevance") == order("") == [2, 3, 1] and order("newest") == [3, 2, 1] and order("name") == [2, 1, 3]


def test_protected_columns(spark):
    apps = spark.createDataFrame([(1, "", "draft")], "app_id int, name string, status string")
    with pytest.raises(ValueError):
        apply.applied_fields(apps, apps.select("app_id", "status"), "app_id")
    plan = spark.createDataFrame([(1, "a"), (2, "b")], "app_id int, name string")
    once, _ = apply.applied_fields(apps, plan, "app_id")
    again, skipped = apply.applied_fields(once, plan, "app_id")
    assert values(once, "app_id", "name", "status") == values(again, "app_id", "name", "status") == [(1, "a", "draft")] and skipped.count() == 0
    assert trust.guarded_columns(plan) is plan


def test_upsert_twice_changes_nothing(spark):
    apps = spark.createDataFrame([(1, "unknown", ""), (2, "listed", "B")], "app_id bigint, verification string, name string")
    sources = spark.createDataFrame([("r", "x", 1, "old")], "source_type string, external_id string, app_id bigint, payload string")
    drafts = spark.createDataFrame([(1, "r", "x", "new", "official", "A"), (2, "r", "y", "p", "unknown", "C"), (3, "r", "y", "q", "unknown", "D"), (4, "f", "", "s", "unknown", "E"), (5, "r", "z", "t", "unknown", "F")], "draft_id bigint, source_type string, external_id string, payload string, verification string, name string")
    matches = spark.createDataFrame([(5, 2)], "draft_id bigint, app_id bigint")
    a, s, outcomes = apply.upserted(apps, sources, drafts, matches, ["name"])
    assert dict(values(outcomes, "draft_id", "outcome")) == {1: "updated", 2: "new", 3: "new", 4: "new", 5: "skipped"}
    assert sorted(values(a, "app_id", "verification", "name")) == [(1, "official", "A"), (2, "listed", "B"), (3, "unknown", "C"), (4, "unknown", "E")]
    assert sorted(values(s, "external_id", "app_id", "payload")) == [("x", 1, "new"), ("y", 3, "p"), ("z", 2, "t")]
    again = apply.upserted(a, s, drafts.where("external_id <> ''"), matches, ["name"])
    assert sorted(values(again[0], "app_id", "name")) == sorted(values(a, "app_id", "name")) and sorted(values(again[1], "external_id", "app_id")) == sorted(values(s, "external_id", "app_id"))


def test_replace_reads_what_it_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, day string")
    out = sink.replace(rows, path)
    out = sink.replace(out.where("k > 1").unionByName(rows.limit(0)), path)
    assert values(out, "k", "day") == [(2, "b")]
    parts = str(tmp_path / "p")
    sink.replace_partitions(rows, parts, ["day"])
    done = sink.replace_partitions(spark.createDataFrame([(9, "b")], "k int, day string"), parts, ["day"])
    assert sorted(values(done, "k", "day")) == [(1, "a"), (9, "b")]


def test_platforms_and_relations(spark):
    links = spark.createDataFrame([(1, "p", "", {"a": "1"})], "app int, platform string, scope string, metadata map<string,string>")
    wanted = spark.createDataFrame([(1, "p", "s", {"a": "2", "b": "3"}), (2, "p", "t", None)], "app int, platform string, scope string, metadata map<string,string>")
    got = {r.app: (r.scope, r.metadata) for r in apply.attached_platforms(links, wanted, ["app", "platform"], ["scope"]).collect()}
    assert got == {1: ("s", {"a": "1", "b": "3"}), 2: ("t", None)}
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, "y", 2), (2, "y", 9)], "app_id int, item string, id int")
    moves = spark.createDataFrame([(2, 1), (3, 1)], "source int, target int")
    assert sorted(values(apply.repointed_all({"r": (rows, ["item"])}, moves)["r"], "app_id", "item", "id")) == [(1, "x", 5), (1, "y", 9)]
    numbers = apply.numbered(spark.range(0, 5000, 7, 9).withColumnRenamed("id", "k"), "k", "n")
    assert sorted(values(numbers, "k", "n")) == [(k, i + 1) for i, k in enumerate(range(0, 5000, 7))]


def test_review_plan_of_one_app(spark):
    schema = "app_id int, entry_id int, kind string, skipped boolean, verdict string, launch_status string, pricing_model string"
    entries = spark.createDataFrame([(1, 1, "enriched", False, "x", None, None), (1, 2, "enriched", False, "long enough", "live", "free"), (1, 3, "enriched", True, "x", "", "paid"), (2, 4, "other", False, None, None, None)], schema)
    apps = spark.createDataFrame([(1, "", "live", "unknown"), (2, "", "live", "unknown")], "app_id int, verdict string, launch_status string, pricing_model string")
    got = {r.app_id: r for r in rules.review_plans(entries, apps, ("live",), ("free", "paid", "unknown"), F.length("verdict") > 5).collect()}
    assert got[1].blockers == ["review_conflicting_pricing_model", "review_conflicting_verdict", "review_has_skipped_updates"] and got[1].verdict == "long enough" and got[1].pricing_model == "free"
    assert got[2].blockers == ["unsafe_review_kind:other"] and got[2].verdict is None


def test_stream_throttle_is_the_batch_one(spark, tmp_path):
    rows = [(f"k{i % 2}", i, BASE + dt.timedelta(seconds=(i * 7) % 20 + i)) for i in range(30)]
    schema = "key string, event_id bigint, ts timestamp"
    stream = landed(spark, rows, schema, tmp_path / "t", 1)
    got = {r.event_id: r.start for r in drain(state.throttled(stream, "4 seconds"), "throttle")}
    want = batch.throttled(spark.createDataFrame(rows, schema), "key", "ts", "event_id", 4_000_000)
    assert got == {r.event_id: r.at for r in want.select("event_id", F.timestamp_micros("start_us").alias("at")).collect()}


def test_stream_retention_forgets_old_keys(spark, tmp_path):
    rows = [("a", BASE), ("a", BASE + dt.timedelta(hours=1)), ("b", BASE + dt.timedelta(days=9)), ("c", BASE + dt.timedelta(days=30))]
    stream = landed(spark, rows, "key string, ts timestamp", tmp_path / "r", 4)
    got = drain(state.retained(stream, 5), "retained")
    assert {(r.key, r.n_events, r.last_at) for r in got} == {("a", 2, BASE + dt.timedelta(hours=1)), ("b", 1, BASE + dt.timedelta(days=9))}


def test_stream_windows_and_sessions(spark, tmp_path):
    rows = [(1, BASE + dt.timedelta(minutes=m)) for m in (0, 10, 100)] + [(2, BASE + dt.timedelta(days=40))]
    stream = landed(spark, rows, "app_id bigint, created_at timestamp", tmp_path / "w", 1)
    got = {(r.app_id, r.until): r.n_clicks for r in drain(state.trending_windows(stream), "windows")}
    assert {k[1] for k in got if k[0] == 1} == {BASE + dt.timedelta(days=d) for d in range(1, 8)} and set(got.values()) == {3}
    runs = {(r.app_id, r.begin, r.n_events) for r in drain(state.sessions(stream, "app_id", "created_at"), "sessions")}
    assert runs == {(1, BASE, 2), (1, BASE + dt.timedelta(minutes=100), 1)}


def test_each_batch_gets_its_keys(spark, tmp_path):
    seen = []
    stream = landed(spark, [(1, "x"), (1, "y"), (2, "x")], "app_id int, what string", tmp_path / "b", 1)
    state.each_batch(stream, lambda rows, keys: seen.append((rows.count(), sorted(r[0] for r in keys.collect()))), ["app_id"], str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [(3, [1, 2])]
