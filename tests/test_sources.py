"""Landed files of every source: good, odd and broken records."""

import base64
import json

from pyspark.sql import functions as F

from millrace.sources import feeds, html_directory, registry


def test_registry_pages(spark, tmp_path):
    page = {
        "servers": [
            {"server": {"id": "x/1", "name": "one", "title": "One  Tool", "remotes": [{"type": "sse", "url": "https://r.example"}]}},
            {"name": "two", "packages": [{"identifier": "pkg", "transport": {"type": "stdio"}}]},
            {"description": "no name"},
            "text",
        ],
        "metadata": {"nextCursor": "c2"},
    }
    (tmp_path / "p.json").write_text(json.dumps(page))
    (tmp_path / "broken.json").write_text("{")
    pages = registry.landed(spark, str(tmp_path))
    good, dead = registry.split(registry.registry_drafts(registry.records(pages, ("$.servers",))))
    rows = {r.external_id: r for r in good.collect()}
    assert rows["x/1"]["name"] == "One Tool" and rows["x/1"].transports == ["sse"] and rows["x/1"].capabilities["remote"] == "yes"
    assert rows["two"].install_url == "pkg" and rows["two"].transports == ["stdio"] and rows["two"].place == 2
    assert sorted(r.error for r in dead.collect()) == ["no name", "not an object"]
    assert {r.c for r in pages.select(registry.next_cursor(F.col("raw")).alias("c")).collect()} == {"c2", None}


def test_feed(spark):
    raw = json.dumps([{"id": "a", "fullName": "Own/Repo", "extensionName": "Ext", "stars": 3, "hasMCP": True, "hasHooks": False}, {"stars": 1}])
    df = registry.feed_drafts(registry.records(spark.createDataFrame([(raw,)], "raw string"), ("$.extensions", "$.items", "$")))
    rows = df.orderBy("place").collect()
    assert rows[0].developer_url == "https://github.com/Own" and rows[0].capabilities["mcp"] == "yes" and rows[0].capability_evidence["context"] == "hasContext=absent"
    assert rows[1].error == "no name" and registry.failure_alert(df).first().alert


def test_rss_and_atom(spark):
    xml = """<rss><channel><item><title>A</title><link>https://a.example</link><description>&lt;b&gt;x&lt;/b&gt;</description></item>
    <item><title>none</title></item></channel></rss>"""
    atom = '<feed><entry><title>B</title><link href="https://b.example"/><summary>s</summary><updated>2024</updated></entry></feed>'
    rows = feeds.rss_items(spark.createDataFrame([(xml,), (atom,), (None,)], "xml string")).orderBy("url").collect()
    assert [(r.title, r.external_id, r.summary, r.published) for r in rows] == [("A", "rss:https://a.example", "x", None), ("B", "rss:https://b.example", "s", "2024")]


def test_an_item_is_parsed_once(spark):
    xml = """<rss><item><title>A<b>c</b></title><link> </link><guid>g1</guid><guid>g2</guid><dc:title>other</dc:title><pubDate>d</pubDate></item>
    <entry><link href="https://b.example"/><id>i</id><updated>u</updated><published>p</published></entry></rss>"""
    df = feeds.rss_items(spark.createDataFrame([(7, xml)], "k int, xml string"))
    assert [(r.k, r.title, r.url, r.summary, r.published) for r in df.orderBy("url").collect()] == [(7, "Ac", "g1", "", "d"), (7, "", "https://b.example", "", "p")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("/item/link") == 1


def test_code_search_and_readme(spark):
    raw = json.dumps({"items": [{"full_name": "O/my-tool", "html_url": "https://c.example/O"}, {"full_name": ""}]})
    found = feeds.candidate_drafts(feeds.search_candidates(spark.createDataFrame([(raw,), ("oops",)], "raw string"))).collect()
    assert [(r["name"], r.external_id) for r in found] == [("My Tool", "o/my-tool")]
    body = base64.b64encode("héllo".encode()).decode()
    assert spark.createDataFrame([(body,)], "b string").select(feeds.readme_text(F.col("b")).alias("t")).first().t == "héllo"


def test_seed(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps([{"model": "m", "pk": 1, "fields": {"name": "n", "sort": 2}}]))
    assert feeds.seed_fixtures(spark, str(tmp_path / "seed.json")).first().fields == {"name": "n", "sort": "2"}


def test_cards(spark):
    html = '<a href="/x">One</a><a href="/x">Again</a><a href="#">Top</a><a href="y">Two</a>'
    js = '<script type="application/ld+json">{"itemListElement": [{"item": {"name": "J", "url": "https://j.example", "description": "d"}}]}</script><script>{"name": 1'
    pages = spark.createDataFrame([(1, "https://h.example/a/b?q", html), (2, "https://h.example", js), (3, None, None)], "page_id bigint, url string, html string")
    rows = html_directory.cards(pages, "page_id").orderBy("page_id", "place").collect()
    assert [(r["name"], r.detail_url) for r in rows if r.page_id == 1] == [("One", "https://h.example/x"), ("Top", "https://h.example/a/b?q"), ("Two", "https://h.example/a/y")]
    assert [(r["name"], r.summary) for r in rows if r.page_id == 2] == [("J", "d")]


def test_card_drafts(spark):
    cards = spark.createDataFrame([("N  m", "u", "can write and sign in", "Dev", "Web app, b|b")], "name string, detail_url string, summary string, category string, labels string")
    row = html_directory.card_drafts(cards, "dir", {"dev": "developer-tools"}).first()
    assert row["name"] == "N m" and row.categories == ["developer-tools"] and row.capabilities == {"write": "yes", "oauth": "yes"} and row.platforms == ["web"] and row.use_cases == ["Web app", "b"]
