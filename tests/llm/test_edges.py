"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

pytest.importorskip("millrace.llm")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import bpe, decontaminate, html, linededup, lm, ngramjoin, quality, tokencount, toxicity, urlfilter  # noqa: E402
from tests.llm.common import CLASHING, TEXTS, messy  # noqa: E402


def kept_columns(out, *replaced):
    """Columns that are not the operator's own keep their values."""
    for c in set(CLASHING) - set(replaced):
        assert {r[0] for r in out.select(F.col(f"`{c}`")).collect()} <= {"own"}, c


BENCH = [(1, "line number 5 of a long text with some words\nline number 6 of a"), (2, "same text"), (3, None), (4, " "), (None, "long long")]


def test_decontamination(spark):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    out = decontaminate.contamination(messy(spark), bench).cache()
    assert out.count() == len(TEXTS)
    kept_columns(out, "hits")
    by = {r.doc_id: r.hits for r in out.collect()}
    assert by[2].n_words == 0 and by[3].n_hit == 0 and by[6]["items"] == ["2"] and by[8].n_hit == by[8].n_words == 40_000
    assert by[8]["items"] == [] and by[10]["items"] == ["1"] and by[10].n_hit == 15
    blocks = decontaminate.contamination(messy(spark), bench, block_words=1)
    assert {(r.doc_id, r.hits.n_hit, *r.hits["items"]) for r in blocks.collect()} == {(r.doc_id, r.hits.n_hit, *r.hits["items"]) for r in out.collect()}
    assert decontaminate.contamination(messy(spark), bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert decontaminate.contamination(messy(spark).limit(0), bench).count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(messy(spark), bench).collect()}
    assert "number 5 of" not in cut[10] and "number 4 of" in cut[10] and cut[2] is None
    assert {r.doc_id for r in decontaminate.remove_documents(messy(spark), bench).collect()} == {1, 2, 3, 4, None, 7, 9, 10, 11}


def test_quality(spark):
    out = quality.ledger(messy(spark)).cache()
    assert out.count() == len(TEXTS)
    kept_columns(out, "ledger", "failure_bits")
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].ledger.n_words == by[3].ledger.n_words == by[4].ledger.n_words == 0 and by[2].failure_bits & 1
    assert by[8].ledger.n_repeat_words == 40_000 and by[9].ledger.word_chars == 60_000 and by[1].ledger.n_dup_lines == 2
    report = {r.rule: r for r in quality.ablation(out, "v1").collect()}
    fails = [r.failure_bits for r in out.collect()]
    for k, (name, _) in enumerate(quality.rules()):
        assert report[name].n_failed == sum(b >> k & 1 for b in fails)
        assert report[name].n_failed_alone == sum(b == 1 << k for b in fails)
        assert report[name].n_kept_without == sum(b in (0, 1 << k) for b in fails)
    assert quality.ledger(messy(spark).limit(0)).count() == 0


def test_line_dedup(spark):
    out = linededup.dedup_lines(messy(spark)).cache()
    assert out.count() == len(TEXTS)
    kept_columns(out, "n_lines", "n_deleted")
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].text is None and by[3].text == "" and by[10].n_deleted == 0 and by[11].text == "" and by[11].n_deleted == 300
    assert by[5].n_deleted == 0 and by[6].n_deleted == 1
    assert linededup.dedup_lines(messy(spark).limit(0)).count() == 0


def test_lm(spark):
    out = lm.score(messy(spark)).collect()
    assert len(out) == len(TEXTS)
    by = {r.doc_id: r for r in out}
    assert by[2].n_tokens == by[3].n_tokens == 1 and by[8].n_tokens == 40_001 and by[9].score < 0
    assert lm.score(messy(spark).limit(0)).count() == 0


def test_bpe(spark):
    out = bpe.encode(messy(spark)).cache()
    assert out.count() == len(TEXTS)
    kept_columns(out, "bpe")
    by = {r.doc_id: r.bpe for r in out.collect()}
    assert by[2].ids == by[3].ids == by[4].ids == [] and by[2].decoded == ""
    again = bpe.decode(out.select("doc_id", "bpe.*").drop("decoded"))
    assert {(r.doc_id, r.decoded) for r in again.collect()} == {(d, b.decoded) for d, b in ((r.doc_id, r.bpe) for r in out.collect())}
    assert bpe.digests(messy(spark).limit(0)).count() == 0


def test_token_counts(spark):
    out = tokencount.token_counts(messy(spark)).cache()
    assert out.count() == len(TEXTS)
    kept_columns(out, "counts")
    by = {r.doc_id: r.counts for r in out.collect()}
    assert by[2].n_tokens == by[4].n_tokens == 0 and by[8].n_words == 40_000 and by[7].n_tokens > 100
    assert tokencount.token_counts(messy(spark).limit(0)).count() == 0


def test_toxicity(spark):
    labels = spark.createDataFrame([(d, d % 2) for d in (1, 3, 5, 7, 8, 9, 10, 11)] + [(None, 1), (5, None), (7, 0)], "doc_id bigint, toxic int")
    for own in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.Model(messy(spark), own)
        out = model.score(messy(spark), messy(spark).columns).cache()
        assert out.count() == len(TEXTS) and out.where("toxic_score between 0 and 1").count() == len(TEXTS)
        kept_columns(out)
    assert toxicity.remove_toxic(messy(spark).limit(0), labels).count() == 0


def test_html(spark):
    page = "<html><body><nav>menu</nav><article><h1>Head</h1><p>a &amp; b</p><p>c<br>d</p></article><footer>foot</footer></body></html>"
    rows = [(1, "http://h/a", page), (2, None, page), (3, "http://h/b", None), (4, "http://h/c", ""), (5, "http://h/d", "<p>broken &#xZZ; <b>x"), (5, "http://h/d", "<p>broken &#xZZ; <b>x"), (6, "x", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id bigint, url string, html string, parsed string, host string").repartition(2)
    out = html.extract(pages).collect()
    by = {r.page_id: r.extracted for r in out}
    assert len(out) == len(rows) and by[1] == by[2] == "Head\na & b\nc d" and by[3] == by[4] == "" and "broken" in by[5] and by[6] == "deep"
    assert {r.parsed for r in out} == {r.host for r in out} == {"own"}
    assert html.extract(pages.limit(0)).count() == 0


def test_html_wrappers_with_boilerplate_words():
    text = "<p>The first line of it.</p><p>The second line of it.</p>"
    lines = ["The first line of it.", "The second line of it."]
    ad = '<div class="ad">Buy</div>'
    kept = lambda page: [x for x, m in zip(*html.parse(page)[1:], strict=True) if m]
    for page in (
        f'<div class="page with-sidebar">{ad}<article>{text}{ad}</article></div>',
        f'<div class="layout has-nav">{ad}<main>{text}</main></div>',
        f'<article class="post no-comments">{text}{ad}</article>',
        f'{ad}<div class="content no-sidebar">{text}{ad}</div>',
        f'<article>{text}</article><div class="comments"><article class="comment"><p>{"A long comment. " * 20}</p></article></div>',
        f'<article>{text}<div class="related"><p>{"More to read. " * 20}</p></div></article>',
    ):
        assert kept(page) == lines, page
    decided, lines, _ = html.parse('<div class="menu">One</div><div class="promo">Two</div>')
    assert not decided and lines == ["One", "Two"]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.COM?x#y", "https://x.example.com/en/7", "http://com/en/", "http://casino.org/x", "http://a.org/free/deal", "http://dealer.org/freedom", "http://a.net/de/8", "http://b.example.net/de/8", "a://b://c/casino", "http://a.org/x?free=1#deal", "http://a.org/?to=casino", "casino"]
    df = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], "page_id bigint, url string, hits string, text string")
    out = urlfilter.judge_urls(df).orderBy("page_id").collect()
    assert [r["filter"].verdict for r in out] == ["allow"] * 5 + ["allow", "block", "block", "block", "allow", "allow", "block", "block", "block", "block", "block"]
    assert out[4]["filter"].host == "a.b.com" and out[4]["filter"].path == "" and out[5]["filter"].rule == "example.com/en/7" and {r.text for r in out} == {"own"}
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_jaccard(spark):
    out = ngramjoin.near_duplicates(messy(spark)).cache()
    assert out.count() == len(TEXTS)
    kept_columns(out, "component_node")
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[6].component_id == 5 and by[11].component_id == 10 and by[None].component_id is None
    assert by[8].n_shingles == 1 and by[9].n_shingles == 1
    ones = ngramjoin.one_of_each(messy(spark))
    assert sorted((r.doc_id or 0) for r in ones.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    kept_columns(ones)
    assert ngramjoin.near_duplicates(messy(spark).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = messy(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 5
