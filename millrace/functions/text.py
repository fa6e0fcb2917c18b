"""Column functions on text, URLs and names. All run in the JVM."""

from __future__ import annotations

import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters() -> tuple[str, str]:
    """Characters that decompose to one ASCII character and marks, and that character."""
    pairs = []
    for code in range(0x80, 0x10000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            pairs.append((chr(code), plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _letters()


def ascii_folded(c: Column) -> Column:
    """Accented letters as their base letter; what has none stays."""
    return F.translate(c, _FROM, _TO)


def slugify(c: Column, size: int = 200) -> Column:
    """A url slug: ASCII letters, digits and underscores in lower case, runs of white space and dashes as one dash."""
    kept = F.regexp_replace(F.lower(ascii_folded(c)), r"[^a-z0-9_\s-]", "")
    dashed = F.regexp_replace(F.trim(kept), r"[-\s]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^[-_]+|[-_]+$", ""), 1, size)


def words(c: Column) -> Column:
    """Lower-case words of letters and digits (ASCII)."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """The distinct three-character parts of each word, padded with two spaces before and one after."""
    each = F.transform(
        words(c),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two columns; 0 if neither has one."""
    both = F.size(F.array_intersect(trigrams(a), trigrams(b)))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(trigrams(a), trigrams(b)))), F.lit(0.0))


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """The lower-case host, without user and port."""
    return F.lower(F.regexp_extract(with_scheme(F.trim(url)), r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(with_scheme(F.trim(url)), r"^[^:]+://[^/?#]*([^?#]*)", 1)


def url_identity(url: Column) -> Column:
    """Host and path in lower case, without scheme, query, fragment and closing slash; empty for an empty url."""
    path = F.regexp_replace(F.lower(url_path(url)), "/+$", "")
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", F.lit("")).otherwise(F.concat(domain(url), F.when(path == "", F.lit("/")).otherwise(path)))


def repo_identity(url: Column, code_host: str = "github.com") -> Column:
    """host/owner/repository in lower case, without .git; empty unless the url names a repository of the code host."""
    parts = F.filter(F.split(F.lower(url_path(url)), "/"), lambda p: p != "")
    name = F.regexp_replace(F.element_at(parts, 2), r"\.git$", "")
    fits = (domain(url) == code_host) & (F.size(parts) >= 2)
    return F.when(fits, F.concat_ws("/", F.lit(code_host), F.element_at(parts, 1), name)).otherwise(F.lit(""))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^\s/?#.]+(\.[^\s/?#.]+)+([/?#]\S*)?$"), F.lit(False))


def is_under(url: Column, hosts: dict[str, str]) -> Column:
    """Whether the url lies on one of the hosts, below the path prefix given for it."""
    out = F.lit(False)
    for name, prefix in hosts.items():
        out = out | ((domain(url) == name) & url_path(url).startswith(prefix))
    return out


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Names of character references by the standard's table, without those that need no semicolon; a no-break space reads as a space.
NAMED = {name[:-1]: plain for name, plain in html5.items() if name.endswith(";")} | {"nbsp": " "}
_REFERENCE = r"(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z][a-zA-Z0-9]{1,31};)"


def references(c: Column) -> Column:
    """Numeric and named character references decoded, in one pass; those of no character stay as they are. Only texts that hold
    one are cut up."""
    parts = F.split(F.regexp_replace(c, _REFERENCE, "\u0000$1\u0000"), "\u0000")
    number = lambda x: F.when(
        x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
    ).otherwise(F.regexp_extract(x, "^&#([0-9]+);$", 1)).try_cast("int")
    valid = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    utf32 = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    # the whole table is one constant text, so that the plan holds no thousands of literals
    table = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in NAMED.items())), F.lit("\u0001"), F.lit("\u0002"))
    named = lambda x: F.try_element_at(table, F.regexp_extract(x, "^&([a-zA-Z0-9]+);$", 1))
    plain = lambda x: F.when(valid(number(x)), utf32(number(x))).otherwise(F.coalesce(named(x), x))
    decoded = F.transform(parts, lambda x: F.when(x.rlike(f"^{_REFERENCE}$"), plain(x)).otherwise(x))
    return F.when(c.rlike(_REFERENCE), F.array_join(decoded, "")).otherwise(c)


def stripped_html(c: Column) -> Column:
    """Text without tags, character references decoded, white space collapsed."""
    return collapsed(references(F.regexp_replace(c, "<[^>]+>", " ")))


def context_text(html: Column, at_most: int = 12_000) -> Column:
    """The text of a page for a model's context, which has a limit."""
    return F.substring(stripped_html(html), 1, at_most)


def first_sentence(c: Column) -> Column:
    """Up to the first `.`, `!` or `?` that white space follows."""
    return F.element_at(F.split(F.trim(c), r"(?<=[.!?])\s+", 2), 1)


def first_other_paragraph(text: Column, current: Column, at_least: int, at_most: int = 280) -> Column:
    """The first sentence of the first paragraph that is long enough and not what stands there already."""
    blocks = F.transform(F.split(text, r"\n\s*\n"), collapsed)
    fit = F.filter(blocks, lambda b: (F.length(b) >= at_least) & (b != F.coalesce(current, F.lit(""))))
    return F.substring(first_sentence(F.try_element_at(fit, F.lit(1))), 1, at_most)


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The first hop of a forwarded header, which may be empty; without a header the remote address, empty if unknown."""
    hop = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.length(forwarded) > 0, hop).otherwise(F.coalesce(remote, F.lit("")))


def blank(c: Column) -> Column:
    """Null or white space."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def label_list(c: Column) -> Column:
    """Parts between commas and bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[,|]"), lambda x: F.trim(x)), lambda x: x != "")


def low_information(verdict: Column, phrases: tuple[str, ...], prefixes: tuple[str, ...], at_least: int = 40) -> Column:
    """Whether a verdict says too little: a stock phrase, a draft prefix, or too short."""
    text = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    out = text.isin(*phrases) | (F.length(text) < at_least)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


#: Phrases before the name of a developer, and what may follow the first in a listing.
MAKER, AUTHOR = "Made by", "by"
AFTER_MAKER = ("Play video", "Capabilities", "Category")
#: Characters that end a name, and how many it may have.
NOT_OF_A_NAME, NAME_LENGTH = r"[^\w .,&-]", 81
SCHEMES = ("http://", "https://")


def said_after(c: Column, phrase: str, ends: str, begins: str = "", stops: tuple[str, ...] = (), longest: int | None = None) -> Column:
    """What stands after the first place of a phrase (whole words) that a text beginning with `begins` follows: up to a character
    of the class `ends`, the first of the stops after white space, or the greatest length. Trimmed; empty without any."""
    at = F.regexp_instr(c, F.lit(rf"\b{phrase}\s+{begins}(?!{ends}).(?!{ends})." if begins else rf"\b{phrase}\s+\S"))
    said = F.regexp_replace(F.substr(c, at + len(phrase)), r"^\s+", "")
    said = F.get(F.split(said, ends, 2), F.lit(0))
    for stop in stops:
        said = F.get(F.split(said, rf"\s+{stop}", 2), F.lit(0))
    return F.when(at > 0, F.trim(said if longest is None else F.left(said, F.lit(longest)))).otherwise("")


def author_named(c: Column) -> Column:
    """The name, a capital and some letters more, that follows "by"."""
    return said_after(c, AUTHOR, NOT_OF_A_NAME, "(?=[A-Z])", longest=NAME_LENGTH)


def developer_named(c: Column) -> Column:
    """What follows "Made by" up to the next part of a listing or the end of the line; else the author named."""
    return F.coalesce(F.nullif(said_after(c, MAKER, r"[\r\n]", stops=AFTER_MAKER), F.lit("")), author_named(c))


def first_address(c: Column) -> Column:
    """The first address with a scheme, up to white space or a closing bracket; empty without any."""
    parts = F.split(c, r"[\s)]+")
    at = lambda x: F.least(*(F.nullif(F.instr(x, F.lit(s)), F.lit(0)) for s in SCHEMES))
    cut = lambda x: F.substr(x, at(x))
    has_more = lambda x: F.greatest(*(F.when(cut(x).startswith(s), F.length(cut(x)) > len(s)) for s in SCHEMES))
    found = F.filter(parts, lambda x: at(x).isNotNull() & F.coalesce(has_more(x), F.lit(False)))
    return F.coalesce(F.get(F.transform(found, cut), F.lit(0)), F.lit(""))


def url_quoted(c: Column) -> Column:
    """Percent-encoded for a path; a slash stays, a space is %20."""
    out = F.url_encode(c)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def percent_label(c: Column, digits: int = 1) -> Column:
    """A share as text: 0.256 is 25.6%; null is a dash."""
    return F.coalesce(F.concat(F.format_number(c * 100, digits), F.lit("%")), F.lit("—"))


def day_label(ts: Column) -> Column:
    """A time as 05 Jan 2024."""
    return F.date_format(ts, "dd MMM yyyy")


def iso_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


#: Endings of English words: the pattern of a word with one, and what stays of it.
ENDINGS = (
    ("^(.*[^aeiou])ies$", "$1y"),
    ("^(.*(?:ss|x|z|ch|sh))es$", "$1"),
    ("^(.*[^su])s$", "$1"),
    ("^(.*[aeiouy].*[^aeiou])ing$", "$1"),
    ("^(.*[aeiouy].*[^aeiou])ed$", "$1"),
)


def stemmed(word: Column) -> Column:
    """A lower-case word without plural, -ing and -ed endings; words of three letters and less stay. Index and query use the same."""
    out = word
    for pattern, kept in ENDINGS:
        out = F.regexp_replace(out, pattern, kept)
    return F.when(F.length(word) > 3, out).otherwise(word)
