"""HTML extraction: page differencing with the nearest URL of the host, for every line that markup does not settle.

A page is parsed into blocks of text, its lines. Markup settles three kinds of lines. Menus, footers, sidebars, adverts,
forms, scripts, styles and the like go by element; so does what has a class, id or role made up of boilerplate and
layout words only (`ad`, `related-posts`, `site-nav`) or a word of comments, unless it holds the only article or, where none
is marked, most of the text. A header outside an article goes; of one inside it headings stay, datelines and bylines go. If
the page marks its article (article, main), what is outside goes and what is inside stays. All else is open: every line of a
page that marks no article, and lines inside an article under a class with a boilerplate word among others (`ad-free`,
`social-science`, `share-2`). Open lines are template if the page with the nearest URL has them too.

For that, pages are sorted by host and path. Pages that follow each other and are copies of one another (nine tenths of the
lines in common, and half of the lines that stand between the same ones alike in half of their words: near copies differ by an edit, articles under one template by all they say)
make a run, however long. The pages to ask are the last of the run before and the first of the run after, on the same
host; the one with the longer common start of the path counts (of two the one before). Both pages' lines are aligned by longest
common subsequence, and open lines in it are deleted. A page that is a copy of the one to ask is not compared with it; with
none to ask, nothing is deleted.

Scale: lines are compared by 64-bit hashes, so the range shuffle by (host, path) carries hashes and no text, and splits a
hot host over many tasks. A task walks its range and holds one page besides the one at hand. What it needs of other ranges is
found with numbers only (where runs start, by range: a row each) and sent to it by a shuffle: one page from each side,
so the text does not depend on where ranges end. Subsequences come from bit vectors (a step is a few operations on one
integer of as many bits as the other page has lines) and by halves where these would be large, so pages of many equal lines take
the time of their product over 64 and bounded memory. What is to go joins the parsed pages by number.

Defined results: null or empty html has an empty text; unclosed elements end with their parent; a broken character
reference stays as it is; pages without a url are not paired; repeated rows get a row each; other columns of pages
pass through `extract`, but `extracted` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_schema, materialise, sliced, table, with_column_from_text

PARSED = "struct<decided:boolean,lines:array<string>,states:array<int>>"
#: What markup says of a line: not of the text, open (differencing settles), of the text.
OUT, OPEN, SURE = 0, 1, 2
#: Bits of an alignment that are held at once; larger ones are halved.
ALIGN_BITS = 1 << 28
#: Hashes of words that stand for a line when edited lines are told from others.
LEAST_WORDS = 4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements without main text.
DROPPED = frozenset(
    "aside button canvas dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split()
)
#: Words of class, id and role that mark what is not main text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr hidden legal login menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Words that say where a part of a page is or what it looks like, and nothing of what it holds.
LAYOUT = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content desktop fixed global group header head icon icons inline inner item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot small sticky stories story sub top unit wide wrap wrapper".split()
)
#: Words of reader comments, which go whatever stands beside them.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


def verdict(tokens: list[str]) -> str | None:
    """What class, id and role say: "boilerplate", "doubt" (a boilerplate word among others) or nothing."""
    out = None
    for token in tokens:
        parts = {p.lower() for p in _PARTS.findall(token)}
        found = parts & BOILERPLATE
        if found and (parts <= BOILERPLATE | LAYOUT or token.lower() in BOILERPLATE) or parts & COMMENTS:
            return "boilerplate"
        if found:
            out = "doubt"
    return out


class State(NamedTuple):
    """What the open elements say of a text."""

    dropped: bool = False
    article: bool = False
    main: bool = False
    marked: tuple[int, ...] = ()  # elements around it that class, id or role call boilerplate
    holders: tuple[int, ...] = ()  # those of marked that are around the article or main
    doubt: bool = False
    header: bool = False  # in a header of the article, outside its headings


class Block(NamedTuple):
    """A text that no element drops."""

    text: str
    state: State


class Blocks(HTMLParser):
    """Collects the Block of each text that is not dropped by element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, State]] = []
        self.words: list[str] = []
        self.n_marked = 0

    def state(self) -> State:
        return self.open[-1][1] if self.open else State()

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        state = self.state()
        if text and not state.dropped and not state.header:
            self.blocks.append(Block(text, state))
        self.words.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        elif tag in ("br", "td", "th"):
            self.words.append(" ")
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "dt", "dd") and self.open and self.open[-1][0] == tag:
            self.open.pop()
        around, said = self.state(), dict(attrs)
        inside = around.article or around.main
        holds = tag in ("article", "main") or said.get("role") == "main"
        hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in (said.get("style") or "").replace(" ", "")
        marked, doubt = around.marked, around.doubt and not (holds and not inside)  # doubt about what holds the article is none about it
        if tag not in ("html", "body") and not (holds and not inside):
            says = verdict([t for a in ("class", "id", "role") for t in (said.get(a) or "").split()])
            doubt |= says == "doubt"
            if says == "boilerplate":
                self.n_marked += 1
                marked = (*marked, self.n_marked)
        state = State(
            dropped=around.dropped or tag in DROPPED or hidden or tag == "header" and not inside,
            article=around.article or tag == "article",
            main=around.main or tag == "main" or said.get("role") == "main",
            marked=marked,
            holders=marked if holds and not inside else around.holders,
            doubt=doubt,
            header=(around.header or tag == "header") and tag not in HEADINGS,
        )
        self.open.append((tag, state))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.words.append(data)


def parse(html: str) -> tuple[bool, list[str], list[int]]:
    """Whether markup marks an article, the lines that are not dropped, and what markup says of each (OUT, OPEN, SURE)."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = _kept(parser.blocks)
    lines = [b.text for b in blocks]
    for of_text in ([b.state.article for b in blocks], [b.state.main for b in blocks]):
        if any(of_text):
            return True, lines, [(OPEN if b.state.doubt else SURE) if m else OUT for b, m in zip(blocks, of_text, strict=True)]
    return False, lines, [OPEN] * len(lines)


def _kept(blocks: list[Block]) -> list[Block]:
    """blocks without those in an element of a boilerplate class, unless that element holds the article or most of the text.

    If nothing is left by that, all are kept, and differencing settles."""
    plain = any((b.state.article or b.state.main) and not b.state.marked for b in blocks)
    held, sizes = set(), Counter()
    for b in blocks:
        if not plain:
            held.update(b.state.holders)
        for k in b.state.marked:
            sizes[k] += len(b.text)
    if not plain and not held:
        whole = sum(len(b.text) for b in blocks)
        held = {k for k, n in sizes.items() if 2 * n > whole}
    return [b for b in blocks if held.issuperset(b.state.marked)] or blocks


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    in_a, in_b = set(a[start : len(a) - stop]), set(b[start : len(b) - stop])
    places = [i for i in range(start, len(a) - stop) if a[i] in in_b]
    found = _aligned([a[i] for i in places], [x for x in b[start : len(b) - stop] if x in in_a])
    return [*range(start), *(places[i] for i in found), *range(len(a) - stop, len(a))]


def _vectors(a: list, b: list):
    """For each start of a, in turn, a bit vector: bit j is 0 where taking b[j] makes the common subsequence longer."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    whole = v = (1 << len(b)) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & whole
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a with every start of b."""
    v = (1 << len(b)) - 1
    for v in _vectors(a, b):  # noqa: B007  the last one
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > ALIGN_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows = list(_vectors(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                j -= 1
                out.append(i)
    return out[::-1]


class Page(NamedTuple):
    """What is compared of a page: hashes of its lines, of each line the least hashes of its words, and which are open."""

    number: int
    host: str
    path: str
    codes: list[int]
    words: list[list[int]]
    open: list[bool]


def copies(page: Page, other: Page) -> bool:
    """Whether pages are near copies: most lines are shared, and most of the others are alike."""
    most = max(len(page.codes), len(other.codes))
    if not most or 10 * sum((Counter(page.codes) & Counter(other.codes)).values()) < 9 * most:
        return not most
    shared = common_lines(page.codes, other.codes)
    if 10 * len(shared) < 9 * most:
        return False
    few, alike, at, j = min(len(page.codes), len(other.codes)) - len(shared), 0, -1, 0
    for i in [*shared, len(page.codes)]:
        k = j
        while k < len(other.codes) and (i == len(page.codes) or other.codes[k] != page.codes[i]):
            k += 1
        alike += sum(map(_alike, page.words[at + 1 : i], other.words[j:k]))  # line by line between two shared ones
        at, j = i, k + 1
    return 2 * alike >= few


def _alike(a: list[int], b: list[int]) -> bool:
    """Whether about half of the words of two lines are the same, by their least hashes."""
    both = sorted({*a, *b})[:LEAST_WORDS]
    return 2 * sum(x in a and x in b for x in both) >= len(both)


def template(page: Page, other: Page | None) -> list[int] | None:
    """Places of the open lines of a page that the page to ask has too; None if that is none or a copy."""
    if other is None or other.host != page.host or not any(page.open) or copies(page, other):
        return None
    return [i for i in common_lines(page.codes, other.codes) if page.open[i]]


def _shared_start(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _pages(batches) -> tuple:
    """(part, rank, starts, page) of rows of these and the fields of a Page."""
    for batch in sliced(batches):
        for part, rank, starts, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield part, rank, starts, Page(*values)


def _found(rows: list, schema: pa.Schema, least: int = BATCH_ROWS):
    if len(rows) >= max(1, least):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()


def _dealt(pages: DataFrame, sent: DataFrame, forward: bool = True) -> DataFrame:
    """Rows (part, rank, starts and a Page) by part and in order, or against it; what is sent to a part comes first there."""
    columns = ["part", "rank", "starts", *Page._fields]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(*columns).unionAll(sent.select(*columns))
    return rows.repartition(n, "part").sortWithinPartitions("part", F.col("rank") if forward else F.col("rank").desc())


def _run_starts(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(rank, prior) of the pages that start a run: the rank of the page before, -1 if that is of another host or none."""
    before = ranges.select("part", F.lag("high").over(Window.orderBy("part")).alias("rank"))  # a row for each range
    sent = pages.drop("part").join(before.where("rank is not null"), "rank")
    schema = arrow_schema("rank bigint, prior bigint")

    def run(batches):
        found, at, last = [], None, None
        for part, rank, _, page in _pages(batches):
            if part != at:
                at, last = part, None
            if rank >> 33 == part:
                alike = last and last[1].host == page.host
                if not alike or not copies(page, last[1]):
                    found.append((rank, last[0] if alike else -1))
            last = rank, page
            yield from _found(found, schema)
        yield from _found(found, schema, 0) if found else ()

    return _dealt(pages, sent).mapInArrow(run, "rank bigint, prior bigint")


def _asked(pages: DataFrame, asked: DataFrame, forward: bool) -> DataFrame:
    """(number, start, forward, gone) by the page before the run of each page, or else the one after it.

    asked has, by part, the rank of the page that the first page of the part, or else the last one, is to be compared with."""
    sent = pages.drop("part").join(asked.where("rank >= 0"), "rank")
    schema = arrow_schema("number bigint, start int, forward boolean, gone array<int>")

    def run(batches):
        found, at, last, other = [], None, None, None
        for part, rank, starts, page in _pages(batches):
            if part != at:
                at, last, other = part, None, None
            if rank >> 33 != part:
                other = page
                continue
            # going forward a run's start makes the page before it the one to ask; going back, the start that was passed is
            if last and (starts if forward else last[0]):
                other = last[1]
            last = starts, page
            gone = template(page, other)
            if gone is not None:
                found.append((page.number, _shared_start(page.path, other.path), forward, gone))
            yield from _found(found, schema)
        yield from _found(found, schema, 0) if found else ()

    return _dealt(pages, sent, forward).mapInArrow(run, "number bigint, start int, forward boolean, gone array<int>")


def _templates(pages: DataFrame) -> DataFrame:
    """(number, gone): places of template lines, of pages that are compared with one; pages has the fields of a Page."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "key", "number"]  # the key brings equal pages of one URL together
    ordered = pages.withColumn("key", F.xxhash64("codes")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.select(*Page._fields, F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("rank")))
    ranges = materialise(ordered.groupBy("part").agg(F.min("rank").alias("low"), F.max("rank").alias("high")))
    starts = materialise(_run_starts(ordered.withColumn("starts", F.lit(False)), ranges))

    by_part = starts.groupBy(F.shiftright("rank", 33).alias("part")).agg(
        F.min("rank").alias("first_start"), F.min_by("prior", "rank").alias("first_prior"), F.max_by("prior", "rank").alias("last_prior")
    )
    whole = Window.orderBy("part")  # over a row of numbers for each range
    earlier, later = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    asked = ranges.join(by_part, "part", "left").select(
        "part",
        F.when(F.col("first_start") == F.col("low"), F.col("first_prior")).otherwise(F.last("last_prior", True).over(earlier)).alias("before"),
        F.first("first_start", True).over(later).alias("after"),
    )
    flagged = ordered.join(starts.select("rank", F.lit(True).alias("starts")), "rank", "left").withColumn("starts", F.coalesce("starts", F.lit(False)))
    both = [_asked(flagged, asked.select("part", F.col(c).alias("rank")), c == "before") for c in ("before", "after")]
    return both[0].unionAll(both[1]).groupBy("number").agg(F.max_by("gone", F.struct("start", "forward")).alias("gone"))


def _words(line: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.hash(w)))), 1, LEAST_WORDS)


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns `keep`) with a column `extracted`: the main text, blocks joined by a newline."""
    keep = [c for c in (pages.columns if keep is None else keep) if c != "extracted"]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    held = pages.select(row, F.col(url).alias("url"), F.col(html).alias("html"))

    def values(texts: list[bytes], _) -> list[dict]:
        return [dict(zip(("decided", "lines", "states"), parse(t.decode()), strict=True)) for t in texts]

    parsed = with_column_from_text(held, "parsed", PARSED, values, text="html", keep=["row", "url"])
    parsed = materialise(parsed.select("row", "url", "parsed.*", F.monotonically_increasing_id().alias("number")))
    rest = F.substring_index("url", "://", -1)
    compared = parsed.select(
        "number",
        F.lower(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("codes"),
        F.transform("lines", _words).alias("words"),
        F.transform("states", lambda x: x == OPEN).alias("open"),
    )
    gone = materialise(_templates(compared.where("host <> ''")))  # of known size: where it is small, the texts are not shuffled
    both = parsed.join(gone, "number", "left")
    places = F.coalesce("gone", F.array().cast("array<int>"))
    text = F.filter("lines", lambda x, i: (F.get("states", i) != OUT) & ~F.array_contains(places, i))
    return both.select(*(F.col("row")[c].alias(c) for c in keep), F.array_join(text, "\n").alias("extracted"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.select("page_id", "url", F.col("extracted").alias("text"), F.length("extracted").cast("long").alias("n_chars"))
