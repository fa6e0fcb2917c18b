"""HTML extraction against a plain version with a parser of its own, over an element tree and lists of pages."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

pytest.importorskip("millrace.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from millrace.llm import html  # noqa: E402


def longest_common(a, b):
    """Places in a of a longest common subsequence with b, by the table of all lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.sampled_from([1, 8, 1 << 28]))
@settings(max_examples=500, deadline=None)
def test_common_lines_are_longest(a, b, bits):
    """Whole alignments and such that are halved."""
    kept, html.ALIGN_BITS = html.ALIGN_BITS, bits
    try:
        at = html.common_lines(a, b)
    finally:
        html.ALIGN_BITS = kept
    assert len(at) == len(longest_common(a, b)) and at == sorted(set(at))
    rest = iter(b)
    assert all(a[i] in rest for i in at)  # a subsequence of b


def test_long_pages_of_equal_lines():
    start = time.process_time()
    assert len(html.common_lines([1] * 20_000, [1] * 19_000)) == 19_000
    assert len(html.common_lines([0, *[1, 2] * 10_000, 7], [9, *[2, 2, 1] * 6_000, 8])) >= 10_000
    pages = [html.Page(k, "h", "p", [k, *[1, 2] * 10_000], [[k, k], *[[1, 1], [2, 2]] * 10_000], [True] * 20_001) for k in range(2)]
    assert not html.copies(*pages) and html.template(*pages) == [*range(1, 20_001)]
    assert time.process_time() - start < 30


class Element:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def around(self):
        return [self, *(self.parent.around() if self.parent else [])]


class Tree(HTMLParser):
    """Elements with their children and texts; p and li end the one before."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "dt", "dd") and self.at.tag == tag:
            self.at = self.at.parent
        made = Element(tag, dict(attrs), self.at)
        self.at.children.append(made)
        if tag not in html.VOID:
            self.at = made

    def handle_endtag(self, tag):
        for e in self.at.around():
            if e.tag == tag and e.parent:
                self.at.children.append("\0" if tag in html.BLOCKS | html.DROPPED else "")
                self.at = e.parent
                break
        else:
            self.at.children.append("\0" if tag in html.BLOCKS | html.DROPPED else "")

    def handle_data(self, data):
        self.at.children.append(data)


def said(e):
    words = [t for a in ("class", "id", "role") for t in (e.attrs.get(a) or "").split()]
    kinds = [[p.lower() for p in re.findall("[a-z]+|[A-Z][a-z]*", w)] for w in words]
    boiler = [[p for p in k if p in html.BOILERPLATE] for k in kinds]
    sure = any(b and (all(p in html.BOILERPLATE or p in html.LAYOUT for p in k) or w.lower() in html.BOILERPLATE) for w, k, b in zip(words, kinds, boiler, strict=True))
    return "sure" if sure or any(p in html.COMMENTS for k in kinds for p in k) else "doubt" if any(boiler) else ""


def plain_lines(text):
    """(line, state) by markup: states as the module names them."""
    tree = Tree(text).root
    blocks, words = [], []

    def flush(e):
        line = re.sub(r"\s+", " ", "".join(words)).strip()
        words.clear()
        if line:
            blocks.append((line, e))

    def walk(e):
        for c in e.children:
            if isinstance(c, str):
                if c == "\0":
                    flush(e)
                else:
                    words.append(c)
                continue
            if c.tag in html.BLOCKS or c.tag in html.DROPPED:
                flush(e)
            elif c.tag in ("br", "td", "th"):
                words.append(" ")
            walk(c)
            flush(c) if c.tag in ("p", "li", "tr", "dt", "dd") else None

    walk(tree)
    flush(tree)
    holds = lambda e: e.tag in ("article", "main") or e.attrs.get("role") == "main"

    def facts(e):
        up = e.around()
        tops = [k for k, x in enumerate(up) if holds(x)]
        top = tops[-1] if tops else -1  # the outermost one
        free = lambda x: x.tag in ("html", "body") or top >= 0 and x is up[top]
        gone = any(x.tag in html.DROPPED or "hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" or "display:none" in (x.attrs.get("style") or "").replace(" ", "") for x in up)
        header = False
        for k, x in enumerate(up):
            if x.tag in html.HEADINGS:
                break
            if x.tag == "header":
                header = True
        gone |= any(x.tag == "header" and not any(map(holds, x.around()[1:])) for x in up) or header
        marks = [x for x in up if not free(x) and said(x) == "sure"]
        doubt = any(said(x) == "doubt" and not free(x) for x in up[: top if top >= 0 else len(up)])
        return gone, [x for x in up if x.tag == "article"], [x for x in up if holds(x) and x.tag != "article"], marks, doubt, [x for x in marks if top >= 0 and x in up[top:]]

    found = [(line, *facts(e)) for line, e in blocks]
    found = [f for f in found if not f[1]]
    inside = [f for f in found if f[2] or f[3]]
    held = []
    if not any(not f[4] for f in inside):
        held = [x for f in found for x in f[6]]
        if not held:
            size = Counter()
            for f in found:
                for x in f[4]:
                    size[x] += len(f[0])
            held = [x for x, n in size.items() if 2 * n > sum(len(f[0]) for f in found)]
    kept = [f for f in found if all(x in held for x in f[4])] or found
    for k in (2, 3):
        if any(f[k] for f in kept):
            return [(f[0], (html.OPEN if f[5] else html.SURE) if f[k] else html.OUT) for f in kept]
    return [(f[0], html.OPEN) for f in kept]


def hashes(words):
    """Spark's 32-bit hashes of words."""
    from pyspark.sql import SparkSession

    new = sorted(set(words) - hashes.known.keys())
    if new:
        rows = SparkSession.getActiveSession().createDataFrame([(w,) for w in new], "w string").selectExpr("w", "hash(w) as h").collect()
        hashes.known |= {r.w: r.h for r in rows}
    return {hashes.known[w] for w in words}


hashes.known = {}


def plain_copies(a, b):
    """Nine tenths of the lines shared; of the others, taken in turn between shared ones, half alike."""
    most = max(len(a), len(b))
    at = longest_common(a, b)
    if 10 * len(at) < 9 * most:
        return False
    rest = iter(enumerate(b))
    there = [next(j for j, y in rest if y == a[i]) for i in at]
    pairs = []
    for (i, j), (k, n) in zip([(-1, -1), *zip(at, there, strict=True)], [*zip(at, there, strict=True), (len(a), len(b))], strict=True):
        pairs += zip(a[i + 1 : k], b[j + 1 : n])
    alike = 0
    for x, y in pairs:
        mine, theirs = (set(sorted(hashes(z.split(" ")))[:4]) for z in (x, y))
        least = sorted(mine | theirs)[:4]
        alike += 2 * len(mine & theirs & set(least)) >= len(least)
    return 2 * alike >= min(len(a), len(b)) - len(at)


def plain_extract(pages):
    """Texts by page: each against the last page of the run before and the first of the run after."""
    parsed = {}
    for k, url, text in pages:
        host, path = re.match("^([^/?#]*)([^?#]*)", url.partition("://")[2]).groups() if url and "://" in url else ("", "")
        lines = plain_lines(text or "")
        parsed[k] = (host.lower(), path, [x for x, _ in lines], [s for _, s in lines])
    order = sorted((k for k in parsed if parsed[k][0]), key=lambda k: (parsed[k][:2], k))
    runs = []
    for k in order:
        last = runs[-1][-1] if runs else None
        if last is not None and parsed[last][0] == parsed[k][0] and plain_copies(parsed[k][2], parsed[last][2]):
            runs[-1].append(k)
        else:
            runs.append([k])
    out = {k: "\n".join(x for x, s in zip(*p[2:], strict=True) if s != html.OUT) for k, p in parsed.items()}
    for at, run in enumerate(runs):
        for k in run:
            host, path, lines, states = parsed[k]
            asked = []
            for forward, other in ((1, runs[at - 1][-1] if at else None), (0, runs[at + 1][0] if at + 1 < len(runs) else None)):
                if other is not None and parsed[other][0] == host and not plain_copies(lines, parsed[other][2]):
                    theirs = parsed[other][1]
                    same = next((i for i, (x, y) in enumerate(zip(path, theirs)) if x != y), min(len(path), len(theirs)))
                    asked.append((same, forward, other))
            shared = longest_common(lines, parsed[max(asked)[2]][2]) if asked else []
            out[k] = "\n".join(x for i, (x, s) in enumerate(zip(lines, states, strict=True)) if s == html.SURE or s == html.OPEN and i not in shared)
    return out


def extracted(spark, pages, ranges):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        return {r.page_id: r.extracted for r in html.extract(df.repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def some_pages(rng, marked):
    frame = [[f"Site {h} {x}" for x in ("name", "says hello", "slogan")] for h in range(3)]
    words = [f"v{i}" for i in range(300)]
    pages, prior = [], []
    for k in range(36):
        h = 0 if k % 2 else k % 3
        body = [" ".join(rng.choices(words, k=8)) for _ in range(rng.choice([1, 3, 9, 24]))]
        if k % 9 in (4, 5):
            body = prior  # a copy
        if k % 9 == 6:
            body = [*prior[:-1], prior[-1] + " edited"]
        prior = body
        inner = "".join(f"<p>{x}</p>" for x in body)
        if marked:
            inner = f'<article class="no-comments"><header><h1>Title {k}</h1><p>By {h}</p></header><section class="ad-free">{frame[h][0]}<p>Only {k}</p></section>{inner}<div class="share-box">{frame[h][1]}</div><p>{frame[h][2]}</p></article>'
        else:
            inner = f'<div class="legal-history">{frame[h][0]}</div>{inner}<div>{frame[h][1]}</div><div>{frame[h][2]}</div>'
        page = f'<header>Top {k}</header><nav><ul><li>A<li>B</ul></nav><div class="site-nav">menu {k}</div>{inner}<div id="comment-list"><p>Me too {k}</p></div><footer>&copy; {h}</footer>'
        pages.append((k, f"https://H{h}.example/{rng.choice('ab')}/{k:02d}?q={k}", page))
    return [*pages, (90, None, pages[0][2]), (91, "https://h9.example/", pages[1][2]), (92, "https://h1.example/a/92", None)]


@pytest.mark.parametrize("marked", [False, True])
def test_extraction_by_plain_version(spark, marked):
    """Differencing changes rows of marked and of unmarked pages, and the text does not depend on where ranges end."""
    pages = some_pages(random.Random(marked), marked)
    want = plain_extract(pages)
    open_line = "Site 0 name"
    assert sum(open_line in t for t in want.values()) < sum(open_line in (p[2] or "") for p in pages) / 2
    assert not marked or all(f"Site {0 if k % 2 else k % 3} slogan" in want[k] and f"Only {k}" in want[k] for k in range(36))  # what the article says stays
    assert not any(x in t for t in want.values() for x in ("menu", "Me too", "share", "Top", "By 0"))
    for ranges in (1, 8, 60):
        assert extracted(spark, pages, ranges) == want, ranges


def test_given_pages_by_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert {r.page_id: r.text for r in html.op8_html_extraction(spark, sf).collect()} == plain_extract(pages)


def test_long_runs_of_near_copies_lose_their_template(spark):
    """A run over many ranges asks the pages before and after it, whatever its length."""
    frame = [f"Template {i}" for i in range(40)]
    own = lambda k: [" ".join(f"{w}{k}{i}" for w in ("ab", "cd", "ef", "gh")) for i in range(3)]
    texts = {0: own(0), 1: own(1)} | {k: [*own(7)[:2], f"{own(7)[2]} edited{k}"] for k in range(2, 120)} | {120: own(120)}
    pages = [(k, f"http://one.example/en/{k:03d}", "".join(f"<div>{x}</div>" for x in [*frame, *texts[k]])) for k in texts]
    pages += [(k, f"http://copies.example/{k}", pages[5][2]) for k in range(200, 203)]  # copies only: nothing goes
    for ranges in (1, 7, 50):
        out = extracted(spark, pages, ranges)
        assert {k: out[k].split("\n") for k in texts} == texts, ranges
        assert all(out[k].startswith("Template 0\n") for k in range(200, 203))


def test_what_class_words_say():
    kept = lambda page: [x for x, s in zip(*html.parse(page)[1:], strict=True) if s]
    body = "<p>one</p><p>three</p>"
    for name in ("ad-free", "social-science", "legal-history", "related-work"):
        assert kept(f'<article>{body}<section class="{name}">two text</section></article>') == ["one", "three", "two text"]
    for name in ("ad", "related-posts", "share-buttons", "newsletter", "comment-list", "user-comments", "adSlot", "cookie-banner"):
        assert kept(f'<article>{body}<section class="{name}">two text</section></article>') == ["one", "three"], name
    assert kept(f"<article><header><h1>Head</h1><p>By me, today</p></header>{body}</article>") == ["Head", "one", "three"]
    assert kept(f"<header><h1>Site</h1></header><main>{body}</main>") == ["one", "three"]
