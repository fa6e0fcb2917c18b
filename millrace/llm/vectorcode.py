"""Vector code compression: a small codebook for each part of a vector, nearest entries by vantage-point trees.

A vector of integers is cut into equal parts; each part becomes the index of the nearest entry of the codebook of its
position, and the code of a vector is the string of these indexes, two hex digits each. Nearest entries come from one
vantage-point tree for each position: a node holds an entry (the vantage point) and, for each of two halves of the rest, the
least and largest distance from it. A search goes down all trees for a batch of vectors at once. By the triangle
inequality a half can be left out if its distance interval is farther from the distance to the vantage point than the best
distance so far; distances are rounded outwards before they are compared, halves whose bound equals the best are visited
(an entry of lower index may wait there), and every entry met is compared by its exact squared distance in integers.

Codebooks are 64 entries of one vector's length, so they, their sums and their trees are of a fixed size: they are
what the driver gets and what tasks receive. Each round is one pass over the vectors in which a task adds up its parts by
entry; sums meet in a shuffle of at most 64 times the length of a vector rows a task. No vector is shuffled.

Defined results: rows whose vector is null, or holds a null or non-finite component, are left out; so are rows whose
vector has another length than that of the least vec_id, or one that the parts do not divide. Integers saturate at
2^26 (components at 262144), so that squared distances are exact in 64 bits. A null vec_id is coded and is no first entry; of
rows that repeat a vec_id the one with the least vector (component by component) counts as first entry; with no first entry the result is empty.
With fewer vec_ids than entries the codebooks have fewer. Repeated rows get a row each. Other columns pass through; a
column named `coded` is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_schema, materialise, sliced, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LARGEST = 256, 1 << 26
#: Entries that a leaf of a tree holds at most.
LEAF = 12
#: Vectors that go down the trees at once; steps of a search are shared by them.
AT_ONCE = 20_000
_NO = np.iinfo(np.int64).max


def integers(vectors: pa.Array, parts: int, length: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that are kept, and their vectors as integers floor(SCALE * x); with a length, as one array of that width."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without what null rows hold
    bad = ~np.isfinite(x := pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    ends = np.cumsum(n)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    kept = (n > 0) & (n % parts == 0) & (wrong[ends] == wrong[ends - n])
    if length is not None:
        kept &= n == length
    rows = np.flatnonzero(kept)
    whole = np.zeros(len(x), np.int64)
    whole[~bad] = np.clip(np.floor(x[~bad] * SCALE), -LARGEST, LARGEST).astype(np.int64)
    if length is not None:
        return rows, whole[np.repeat(kept, n)].reshape(len(rows), length)
    return rows, [whole[ends[i] - n[i] : ends[i]] for i in rows]


class Tree:
    """A vantage-point tree over the rows of `entries` (integers)."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, max(2, leaf)  # a node has two halves with entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        centre = self.entries[own].mean(0)
        at = int(np.argmax(((self.entries[own] - centre) ** 2).sum(1)))  # an entry at the edge parts the rest best
        point, rest = own[at], np.delete(own, at)
        d = ((self.entries[rest] - self.entries[point]) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        near, far = np.split(order, [(len(order) + 1) // 2])
        halves = [(self._node(rest[h]), *_outwards(d[h].min(), d[h].max())) for h in (near, far)]
        return point, d[near].max(), halves

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the nearest entry (of several the lowest) and its squared distance."""
        best, index = np.full(len(parts), _NO), np.full(len(parts), -1)
        self._visit(self.root, parts, np.arange(len(parts)), best, index)
        return index, best

    def _meet(self, entry: int, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        d = parts[rows] - self.entries[entry]
        d = (d * d).sum(1)
        won = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[won]], index[rows[won]] = d[won], entry
        return d

    def _visit(self, node, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self._meet(int(entry), parts, rows, best, index)
            return
        point, middle, halves = node
        d = self._meet(int(point), parts, rows, best, index)
        low, high = _outwards(d, d)
        inner = d <= middle
        # each row goes to the half that it lies in first, and to the other one with what it has found by then
        for first in (True, False):
            for (child, least, most), here in zip(halves, (inner, ~inner), strict=True):
                to = np.flatnonzero(here == first)
                bound = np.maximum(np.maximum(low[to] - most, least - high[to]), 0.0)
                self._visit(child, parts, rows[to[_at_most(bound, best[rows[to]])]], best, index)


def _outwards(least, most) -> tuple:
    """Bounds of distances from below and above, given their squares: wider than any rounding makes them."""
    return np.sqrt(least) * (1 - 1e-12), np.sqrt(most) * (1 + 1e-12)


def _at_most(bound: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether a bound is at most the best distance, given its square; in doubt it is."""
    return bound * bound * (1 - 1e-12) <= best.astype(np.float64) * (1 + 1e-12)


class Codebooks:
    """entries[p] holds the entries of part position p, one a row."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # parts, entries, width

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[Tree]:
        return [Tree(x) for x in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assigned(trees: list[Tree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances of all parts of the vectors, a column for each part."""
    found = [t.nearest(x) for t, x in zip(trees, np.split(vectors, len(trees), 1), strict=True)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def first_entries(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, id: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks of the parts of the least ids; None without any. A task sends its least ids only."""
    def least(length: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[int]] = {}
            for batch in sliced(batches, AT_ONCE):
                ids = batch.column(0).to_pylist()
                rows, made = integers(batch.column(1), parts, length)
                for i, x in zip(rows.tolist(), made, strict=True):
                    if ids[i] is not None and (ids[i] not in held or x.tolist() < held[ids[i]]):
                        held[ids[i]] = x.tolist()
                held = {k: held[k] for k in sorted(held)[: entries if length else 1]}
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], schema=schema)

        schema = arrow_schema("id bigint, x array<bigint>")
        source = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("x"))
        out = source.mapInArrow(run, "id bigint, x array<bigint>").groupBy("id").agg(F.min("x").alias("x"))
        return out.orderBy("id").limit(entries if length else 1).collect()  # that many rows of one vector's length

    one = least(None)
    if not one:
        return None
    rows = np.array([r.x for r in least(len(one[0].x))], np.int64)
    return Codebooks(np.stack(np.split(rows, parts, 1)))


def refined(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> Codebooks:
    """Codebooks whose entries are the floored means of the parts that are nearest to them; unused entries stay."""
    held = vectors.sparkSession.sparkContext.broadcast(books)
    schema = "place int, part int, entry int, total bigint, n bigint"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        parts, entries, width = books.entries.shape
        trees, total, n = books.trees(), np.zeros_like(books.entries), np.zeros((parts, entries), np.int64)
        for batch in sliced(batches, AT_ONCE):
            _, x = integers(batch.column(0), parts, books.length)
            codes, _ = assigned(trees, x)
            for p, own in enumerate(np.split(x, parts, 1)):
                np.add.at(total[p], codes[:, p], own)
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry, place = np.nonzero(np.repeat(n[:, :, None], width, 2))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((place, part, entry, total[part, entry, place], n[part, entry]), arrow, strict=True)], schema=arrow)

    sums = vectors.select(F.col(f"`{vector}`")).mapInArrow(run, schema).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.entries.copy()
    for r in sums.collect():  # at most as many rows as the codebooks have components
        out[r.part, r.entry, r.place] = r.total // r.n
    return Codebooks(out)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    books = first_entries(vectors, parts, entries, id, vector)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books, vector)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The rows that have a code (columns `keep`, else all) with a struct `coded` of code and error."""
    held = vectors.sparkSession.sparkContext.broadcast(books)
    keep = [c for c in (vectors.columns if keep is None else keep) if c != "coded"]
    source = vectors.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, vector])))
    coded = T.StructField("coded", T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    out = T.StructType([*(source.schema[c] for c in keep), coded])
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = held.value, held.value.trees()
        for batch in sliced(batches, AT_ONCE):
            rows, x = integers(batch.column(vector), len(trees), books.length)
            codes, errors = assigned(trees, x)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * len(trees)
            made = pa.StructArray.from_arrays(
                [pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(errors.sum(1), pa.int64())], fields=list(target.field("coded").type)
            )
            mine = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(mine.column(c).cast(target.field(c).type) for c in keep), made], schema=target)

    return source.mapInArrow(run, out)


def decoded(code: Column, books: Codebooks) -> Column:
    """The components (as floats) that a code stands for; JVM-side, the codebooks are a constant of the plan."""
    parts, _, width = books.entries.shape
    tables = [F.array(*(F.array(*(F.lit((int(v) + 0.5) / SCALE) for v in entry)) for entry in part)) for part in books.entries]
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.get(t, index(p)) for p, t in enumerate(tables)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """Coded rows and the codebooks that give them a meaning."""
    books = fit(vectors, parts, entries, rounds, id, vector)
    if books is None:
        keep = [c for c in (vectors.columns if keep is None else keep) if c != "coded"]
        none = F.lit(None).cast("struct<code:string,error:bigint>").alias("coded")
        return vectors.select(*(F.col(f"`{c}`") for c in keep), none).limit(0), None
    return encode(vectors, books, vector, keep), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all vectors. Errors are summed by label before they meet the rows; a hot label is a row of that sum."""
    rows, books = compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    rows = materialise(rows.select("vec_id", "label", "coded.*"))
    sums = materialise(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of the assignment with the codebooks book{k}; `best{k}` has the nearest entry of each part."""
    return f"""
best{k} AS (
  SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT part.r, part.p, part.x, b.e,
      list_sum(list_transform(list_zip(part.x, b.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS d
    FROM part JOIN book{k} b ON b.p = part.p)
  GROUP BY r, p, x)"""


def _update(k: int) -> str:
    return f"""
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST(sum(v) // count(*) - CAST(sum(v) % count(*) < 0 AS INT) AS BIGINT) AS m
    FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM best{k}) GROUP BY p, e, i)
  GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)"""


OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: greatest(-{LARGEST}, least({LARGEST}, CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS HUGEINT)))::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0),
same AS (SELECT * FROM kept WHERE len(x) = (SELECT arg_min(len(x), vec_id) FROM kept)),
part AS (
  SELECT r, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x
  FROM same, (SELECT unnest(range({PARTS})) AS p)),
seed AS (
  SELECT x, row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM (SELECT vec_id, min(x) AS x FROM same WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {ENTRIES})),
book0 AS (
  SELECT p, e, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x
  FROM seed, (SELECT unnest(range({PARTS})) AS p)),
{",".join(f"{_round(k)},{_update(k)}" for k in range(ROUNDS))},{_round(ROUNDS)},
code AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM best{ROUNDS} GROUP BY r)
SELECT s.vec_id, c.code, c.error,
  CAST(sum(c.error) OVER (PARTITION BY s.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM same s JOIN code c ON c.r = s.r
"""
