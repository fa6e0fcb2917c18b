"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The driver turns the benchmark into windows of n consecutive words (a shorter item is one window) and broadcasts their
hashes. Each task rolls a hash over every window of words of its texts, looks it up and verifies each hit against the
words of the benchmark. No shuffle takes place.

The broadcast is bounded: the benchmark streams through the driver once and is cut into blocks of `block_words` words (an
item above that into pieces that share n - 1 words), some 40 bytes a word; the texts pass each block in turn, and what
one block found is written to the shared folder before the next.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no windows; an item
with a null item_id still marks words but is not listed; rows that repeat are judged each on its own; items that
repeat an item_id count as one item; without items nothing is hit. Other columns of documents pass through `contamination`
untouched, whatever their names: its own columns are held in one struct, `hits`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, normal_words, table, with_column_from_text

NGRAM = 13
BLOCK_WORDS = 3_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BETWEEN = b"\n"  # no word; stands between texts, so that no window spans two
#: hit: a bit for each word.
HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,hit:binary,clean:string>"


class Windows(NamedTuple):
    """The windows of n words of a block, sorted by hash; `mask` marks the lowest bits of the hashes."""

    hashes: np.ndarray
    starts: np.ndarray  # number of the first word
    mask: np.ndarray


class Index:
    """A block of the benchmark: its words joined by spaces, the windows by length, and the items."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], n: int):
        words = [w for _, own in rows for w in own]
        self.text = b" ".join(words)
        self.items = [item for item, _ in rows]
        self.firsts = np.cumsum([0, *(len(own) for _, own in rows)])  # number of the first word of each item
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.places = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.uint32)  # of words in the text
        hashes = word_hashes(words)
        sizes = np.diff(self.firsts)
        self.windows: dict[int, Windows] = {}
        for k in sorted(set(np.minimum(sizes, n).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(sizes, n) == k)
            starts = np.concatenate([np.arange(self.firsts[i], self.firsts[i + 1] - k + 1) for i in own])
            found = rolled(hashes, k)[starts]
            order = np.argsort(found, kind="stable")
            mask = np.zeros(1 << max(10, int(8 * len(found)).bit_length()), bool)
            mask[(found & np.uint64(len(mask) - 1)).astype(np.int64)] = True
            self.windows[k] = Windows(found[order], starts[order].astype(np.uint32), mask)

    def holders(self, n: int, found: np.uint64, said: bytes) -> set[str | None]:
        """The items that hold this window of n words; none if it only shares a hash with some."""
        hashes, starts, _ = self.windows[n]
        same = starts[np.searchsorted(hashes, found, "left") : np.searchsorted(hashes, found, "right")].tolist()
        same = [at for at in same if self.text[self.places[at] : self.places[at + n] - 1] == said]
        return {self.items[i] for i in np.searchsorted(self.firsts, same, "right") - 1}


def word_hashes(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    each = np.fromiter(map(xxh64_intdigest, numbers), np.uint64, len(numbers))
    return each[ids] if len(words) else np.zeros(0, np.uint64)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + hashes[k : k + len(out)]
        return (out ^ (out >> np.uint64(29))) * _BASE


def index_blocks(items: Iterable[tuple[str | None, str | None]], n: int = NGRAM, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of the items, of at most block_words words each (2 n at least); without words, one that is empty."""
    step = max(2 * n, block_words)
    held, size, some = [], 0, False
    for item, text in items:
        words = normal_words((text or "").encode())
        for at in range(0, max(1, len(words) - n + 1), step - n + 1):
            piece = words[at : at + step]
            if held and size + len(piece) > step:
                yield Index(held, n)
                held, size, some = [], 0, True
            if piece:
                held.append((item, piece))
                size += len(piece)
    if held or not some:
        yield Index(held, n)


def scan(index: Index, texts: list[bytes]) -> tuple[list[int], np.ndarray, list[set[str]]]:
    """Of each text: the number of words and the items found; of all words in a row, whether they are hit."""
    words, sizes = [], []
    for text in texts:
        own = normal_words(text)
        sizes.append(len(own))
        words += own
        words.append(_BETWEEN)
    hashes = word_hashes(words)
    found: list[set[str]] = [set() for _ in texts]
    change = np.zeros(len(words) + 1, np.int64)
    begins = np.cumsum([0, *(s + 1 for s in sizes)])
    for n, windows in index.windows.items():
        at = rolled(hashes, n)
        may = np.flatnonzero(windows.mask[(at & np.uint64(len(windows.mask) - 1)).astype(np.int64)])
        near = np.searchsorted(windows.hashes, at[may])
        may = may[windows.hashes[np.minimum(near, len(windows.hashes) - 1)] == at[may]]
        known: dict[bytes, set[str | None]] = {}
        for i, text in zip(may.tolist(), (np.searchsorted(begins, may, "right") - 1).tolist(), strict=True):
            said = b" ".join(words[i : i + n])
            if said not in known:
                known[said] = index.holders(n, at[i], said)
            if known[said]:
                found[text] |= known[said]
                change[i] += 1
                change[i + n] -= 1
    found = [items - {None} for items in found]
    return sizes, np.cumsum(change[:-1]) > 0, found


def without_spans(text: bytes, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, last in edges.reshape(-1, 2).tolist():
        out.append(text[end : spans[first][0]])
        end = spans[last - 1][1]
    return b"".join([*out, text[end:]]).decode()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = NGRAM,
    spans: bool = False,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `hits`: n_words, n_hit, items (found, as sorted strings),
    clean (the text without hit spans, if spans is set and there are any). An earlier `hits` column is replaced."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text")).dropDuplicates()
    out, keep = docs.drop("hits"), [c for c in (docs.columns if keep is None else keep) if c != "hits"]
    blocks = index_blocks(map(tuple, items.toLocalIterator()), n, block_words)
    block = next(blocks)
    while block is not None:
        index, block = spark.sparkContext.broadcast(block), next(blocks, None)
        out = with_column_from_text(out, "hits", HITS, _judge(index, spans), keep=keep if block is None else list(dict.fromkeys([*keep, "text"])))
        out = out if block is None else materialise(out)
    return out


def _judge(index, spans: bool):
    def values(texts: list[bytes], batch: pa.RecordBatch) -> list[dict]:
        before = batch.column("hits").to_pylist()  # what earlier blocks found
        sizes, hit, found = scan(index.value, texts)
        rows, start = [], 0
        for raw, size, items, p in zip(texts, sizes, found, before, strict=True):
            mine, start = hit[start : start + size], start + size + 1
            rows.append({"n_words": size, "items": sorted({*items, *(p["items"] if p else ())})})
            if p is not None:
                mine = mine | np.unpackbits(np.frombuffer(p["hit"], np.uint8), count=size).astype(bool)
            some = int(mine.sum())
            rows[-1] |= {"n_hit": some, "hit": np.packbits(mine).tobytes() if some else bytes(-(-size // 8))}
            rows[-1] |= {"clean": without_spans(raw, mine) if spans and some else None}
        return rows

    return values


def is_contaminated(hits: Column | str = "hits") -> Column:
    """Whether a twentieth or more of the words are hit."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """docs without the contaminated ones."""
    return contamination(docs, benchmark, n).where(~is_contaminated()).drop("hits")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """docs with the hit words cut out of their texts."""
    return contamination(docs, benchmark, n, spans=True).withColumn("text", F.coalesce("hits.clean", "text")).drop("hits")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM bench WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, row_number() OVER () AS k,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM wins),
dwin AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens WHERE len(w) >= n)),
hit AS (SELECT k, item_id, i, d.n FROM dwin d JOIN wins USING (win)),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
ids AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN pos USING (k) LEFT JOIN ids USING (k)
"""
