"""N-gram Jaccard join by a token-group matrix.

Texts link when the Jaccard similarity of their sets of distinct five-word shingles is 0.8 or more; the result is the
component of every text. Equal sets are one node, so copies never meet as pairs.

1. Signatures. All shingles of all texts feed a frequency sketch of fixed size. Shingles are ordered by the sketch's
   class, rare first, then by hash. Of a set of n shingles that must share t = ceil(0.8 n) with any partner, the first
   n - t + depth(n) are its signature, depth(n) being a twelfth of n, or four if that is more: two linked sets share as many
   signature shingles as the depth of the smaller, under any order. Only signature shingles of two or more nodes go
   on, and only nodes with enough of them keep their sets. (Sets of three or fewer can only link with equal ones.)
   Of these sets all shingles are counted once: those that no other has cannot be shared, which bounds the size of a
   partner.
2. Groups. Nodes of one min-hash (of five) are compared with the node among them whose signature is the most common,
   then those that it does not hold with the most common of themselves; what links is a group. So a group of many
   near copies costs some comparisons a member and not all pairs.
3. Matrix. Each group stores the union of its members' signatures. Group pairs that share fewer shingles than their
   smallest members need, or whose sizes cannot reach the similarity, stay closed. Only the others are opened: the
   members of the smaller group are compared with those of the larger, whole set with whole set, in blocks of bounded
   size. This step makes the result exact.

Every comparison is exact but for hash collisions: shingles and nodes are 64-bit hashes. Signatures travel as one packed
row for each task and bucket, of which a bucket's task needs linear memory; a hot shingle costs each task one entry for
each distinct text. Two tables are broadcast, both of fixed size whatever the corpus: the sketch's classes and a bitmap
of the nodes that keep their sets.

Defined results: null, empty and wordless texts have n_shingles 0, link with nothing and are their own component; fewer
than five words are one shingle; rows that repeat a text share its component; component_id is the least doc_id that is
not null; other columns pass through, but columns of the names n_shingles, component_id and
component_node are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_schema, materialise, measured, sliced, table, with_column_from_text
from .lm import mixed

WORDS = 5
PERCENT = 80
LEAST_DEPTH, DEPTH_SHARE = 4, 12
HASHES = 5
ROUNDS = 2
#: Groups below FEW members are compared in pairs; larger ones in blocks of about so many members and queries.
FEW, MEMBERS, QUERIES = 8, 256, 2048
#: Places of the sketch and of the bitmap; powers of two.
SKETCH = 1 << 22
BITMAP = 1 << 26
SLICES = 64
#: Postings that a task holds before it sends them on, and that a bucket is meant to get; each takes 16 bytes.
PACK_POSTINGS, BUCKET_POSTINGS = 500_000, 2_000_000
#: In place of the holder of a shingle that several sets of a pack have.
_SEVERAL = -(1 << 63)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.arange(1, HASHES + 1, dtype=np.uint64) * _TIMES)[:, None]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy() - split.offsets[0].as_py()])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    hashes = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    whole = _rolled(h, words)
    ends, out = np.cumsum(counts), []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        begin = end - n
        out.append(np.unique(whole[begin : end - words + 1]) if n >= words else _rolled(h[begin:end], n) if n else h[:0])
    return out


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _TIMES + h[k : k + len(out)]
    return mixed(out)


def node_of(shingles: np.ndarray) -> int | None:
    """The 64-bit hash of a set, as a signed number; none for an empty set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).astype(np.int64)) if len(shingles) else None


def signature(shingles: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    n = len(shingles)
    if 100 * n < percent * (n + 1):  # one shingle more or less is too much: it links with equal sets only
        return shingles[:0]
    least = -(-percent * n // 100)
    size = n - least + min(least, max(LEAST_DEPTH, n // DEPTH_SHARE))
    if size >= n:
        return shingles
    return shingles[np.lexsort((shingles, classes[_place(shingles, SKETCH)]))[:size]]


def _depth(n: Column, percent: int) -> Column:
    """Signature shingles that two linked sets share, n being the size of the smaller (or a bound below it)."""
    return F.least(F.ceil(n * percent / 100.0 - 1e-9), F.greatest(F.lit(LEAST_DEPTH).cast("bigint"), F.floor(n / DEPTH_SHARE)))


def _place(hashes: np.ndarray, places: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - int(places).bit_length())).astype(np.int64)


def _slices(own: np.ndarray) -> list[dict]:
    width = len(own) // SLICES
    parts = ((k, own[k * width : (k + 1) * width]) for k in range(SLICES))
    return [{"slice": k, "data": zlib.compress(p.tobytes(), 1)} for k, p in parts if p.any()]


def joined(df: DataFrame, size: int, dtype: type, join: np.ufunc, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """An array of fixed size out of the (slice, data) that tasks made: each slice is joined, and finished to bytes, in one place."""
    schema = "slice int, data binary"
    target, width = arrow_schema(schema), size // SLICES

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), dtype)
                sums[k] = join(sums[k], part) if k in sums else part
        yield pa.RecordBatch.from_pylist([{"slice": k, "data": zlib.compress(finish(p).tobytes(), 1)} for k, p in sums.items()], schema=target)

    out = np.zeros(size, np.uint8)
    for k, data in df.select("slice", "data").repartitionById(SLICES, F.col("slice")).mapInArrow(merge, schema).collect():
        out[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, n) of each document, and (slice, data) of each task's frequency sketch, in one pass over the texts."""
    rows = StructType([docs.schema["doc_id"], *StructType.fromDDL("node bigint, n bigint, slice int, data binary").fields])
    target = to_arrow_schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), words)
            if any(len(s) for s in sets):
                own = np.zeros(SKETCH, np.uint32) if own is None else own
                np.add.at(own, _place(np.concatenate(sets), SKETCH), np.uint32(1))
            none = [None] * len(sets)
            columns = [batch.column("doc_id"), [node_of(s) for s in sets], [len(s) for s in sets], none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)
        if own is not None:
            yield pa.RecordBatch.from_pylist([{**r, "doc_id": None, "node": None, "n": None} for r in _slices(own)], schema=target)

    return docs.select("doc_id", "text").mapInArrow(run, rows)


def _met(source: DataFrame, postings: Callable, buckets: int, give: Callable, schema: str) -> DataFrame:
    """Brings the postings (shingle, node) of all rows together by ranges of the shingles' hashes.

    postings(batch) gives the shingles and the node of each row, if it has some; give(shingles, nodes, m) turns the postings
    of a range, in order and without repeats, into columns of schema, m being how many nodes have the shingle. A task
    sends each range one packed row for PACK_POSTINGS postings."""
    packs = "bucket int, shingles binary, nodes binary"
    packs_schema, out_schema = arrow_schema(packs), arrow_schema(schema)

    def full(shingles: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        s = np.concatenate(shingles)
        n = np.repeat(np.array(nodes, np.int64), [len(x) for x in shingles])
        order = np.argsort(s)
        s, n = s[order], n[order]
        edges = _edges(s, buckets)
        rows = [{"bucket": k, "shingles": s[a:b].tobytes(), "nodes": n[a:b].tobytes()} for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return pa.RecordBatch.from_pylist(rows, schema=packs_schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, nodes, held, seen = [], [], 0, set()
        for batch in sliced(batches):
            for own, node in postings(batch):
                if len(own) and node not in seen:  # copies in one pack count once
                    seen.add(node)
                    shingles.append(own)
                    nodes.append(node)
                    held += len(own)
                if held >= PACK_POSTINGS:
                    yield full(shingles, nodes)
                    shingles, nodes, held, seen = [], [], 0, set()
        if held:
            yield full(shingles, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = [], []
        for batch in batches:
            s += [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            n += [np.frombuffer(x, np.int64) for x in batch.column("nodes").to_pylist()]
        if s:
            s, n = np.concatenate(s), np.concatenate(n)
            order = np.lexsort((n, s))
            s, n = s[order], n[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])
            s, n = s[new], n[new]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            m = np.diff(np.append(starts, len(s)))
            columns = give(s, n, np.repeat(m, m))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    # a range for each task: ranges are not hashed again
    return source.mapInArrow(ask, packs).repartitionById(buckets, F.col("bucket")).mapInArrow(meet, schema)


def _buckets(df: DataFrame, postings: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-postings // BUCKET_POSTINGS))


def shared_postings(texts: DataFrame, classes, buckets: int, words: int, percent: int) -> DataFrame:
    """(shingle, node, m) of the signature shingles that two or more nodes have, m being their number."""

    def postings(batch):
        return ((signature(s, classes.value, percent), node_of(s)) for s in shingle_sets(batch.column("text"), words))

    def give(s, n, m):
        return s[m > 1].view(np.int64), n[m > 1], m[m > 1]

    return _met(texts, postings, buckets, give, "shingle bigint, node bigint, m bigint")


def shared_sizes(sets: DataFrame, buckets: int) -> DataFrame:
    """(node, e) of the sets (node, shingles), one for each node: how many of all its shingles a set shares with any other.

    A shingle that two sets of one pack have is shared, which the pack counts by itself; only of the others does it send the
    holder. So each range of shingles gets one entry for a shingle and pack, however many sets hold it. What packs and
    ranges count for each node goes on as packed rows for each range of nodes."""
    packs, sums = "bucket int, shingles binary, nodes binary, own binary, counts binary", "node bigint, e bigint"
    packs_schema, target = arrow_schema(packs), arrow_schema(sums)
    parts = "bucket int, nodes binary, counts binary"
    parts_schema = arrow_schema(parts)

    def full(lists: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        s, n = np.concatenate(lists), np.repeat(np.array(nodes, np.int64), [len(x) for x in lists])
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        several = np.diff(np.append(starts, len(s))) > 1
        first = n[starts]
        first[several] = _SEVERAL
        own, counts = np.unique(n[np.repeat(several, np.diff(np.append(starts, len(s))))].view(np.uint64), return_counts=True)
        edges, held = _edges(s[starts], buckets), _edges(own, buckets)
        rows = zip(range(buckets), zip(edges, edges[1:]), zip(held, held[1:]), strict=False)
        kept = [(k, s[starts][a:b].tobytes(), first[a:b].tobytes(), own[c:d].tobytes(), counts[c:d].tobytes()) for k, (a, b), (c, d) in rows if b > a or d > c]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), packs_schema, strict=True)], schema=packs_schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, nodes, held = [], [], 0
        for batch in sliced(batches):
            for s, node in zip(batch.column("shingles"), batch.column("node").to_pylist(), strict=True):
                lists.append(s.values.to_numpy().view(np.uint64))
                nodes.append(node)
                held += len(lists[-1])
                if held >= PACK_POSTINGS:
                    yield full(lists, nodes)
                    lists, nodes, held = [], [], 0
        if held:
            yield full(lists, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {c: [] for c in ("shingles", "nodes", "own", "counts")}
        for batch in batches:
            for c, kind in (("shingles", np.uint64), ("nodes", np.int64), ("own", np.uint64), ("counts", np.int64)):
                found[c] += [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]
        if not found["shingles"]:
            return
        s, n, own, counts = (np.concatenate(x) for x in found.values())
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        m = np.diff(np.append(starts, len(s)))
        shared = np.repeat(m > 1, m) & (n != _SEVERAL)  # a set is in one pack, so entries of two packs are of two sets
        nodes, place = np.unique(np.concatenate([own, n[shared].view(np.uint64)]), return_inverse=True)
        total = np.bincount(place, np.concatenate([counts, np.ones(int(shared.sum()), np.int64)]), len(nodes)).astype(np.int64)
        edges = _edges(nodes, buckets)
        rows = [(k, nodes[a:b].tobytes(), total[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), parts_schema, strict=True)], schema=parts_schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, counts = [], []
        for batch in batches:
            nodes += [np.frombuffer(x, np.int64) for x in batch.column("nodes").to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist()]
        if nodes:
            each, place = np.unique(np.concatenate(nodes), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(total)], schema=target)

    sent = sets.select("node", "shingles").mapInArrow(ask, packs)
    counted = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, parts)
    return counted.repartitionById(buckets, F.col("bucket")).mapInArrow(add, sums)


def _edges(hashes: np.ndarray, buckets: int) -> list[int]:
    """Where each of the equal ranges of hashes starts in sorted hashes, and where the last one ends."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64)).tolist()


def sets_of(texts: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(node, n, shingles, least) of the chosen nodes; least: the least shingle under each of HASHES orders."""
    schema = "node bigint, n bigint, shingles array<bigint>, least array<bigint>"
    target = arrow_schema(schema)

    parts = arrow_schema("slice int, data binary")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BITMAP // 8, np.uint8)
        for batch in batches:
            at = _place(mixed(batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), BITMAP)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pylist(_slices(own), schema=parts)

    bits = joined(chosen.select("node").mapInArrow(mark, "slice int, data binary"), BITMAP // 8, np.uint8, np.bitwise_or)
    bits = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            rows = []
            if len(seen) > 1_000_000:
                seen.clear()
            for s in shingle_sets(batch.column("text"), words):
                node = node_of(s)
                if node is None or node in seen:
                    continue
                at = int(_place(mixed(np.array([node]).view(np.uint64)), BITMAP)[0])
                if bits.value[at >> 3] >> (at & 7) & 1:
                    seen.add(node)
                    rows.append((node, len(s), s.view(np.int64), mixed(s[None, :] ^ _SEEDS).min(axis=1).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    found = texts.mapInArrow(run, schema).join(chosen.select("node"), "node", "left_semi")
    return found.dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose sets have the similarity: the exact check."""
    own = sets.select("node", "n", "shingles")
    left = pairs.join(own, F.col("a") == F.col("node")).select("a", "b", F.col("n").alias("na"), F.col("shingles").alias("sa"))
    both = left.join(own, (F.col("b") == F.col("node")) & _near_sizes(F.col("na"), F.col("n"), percent))
    common = F.size(F.array_intersect("sa", "shingles")).cast("long")
    return both.where(100 * common >= percent * (F.col("na") + F.col("n") - common)).select("a", "b")


def _near_sizes(a, b, percent: int):
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def star_pairs(members: DataFrame, percent: int, others_only: bool = False) -> DataFrame:
    """Pairs of members (node, n, cap, root, heat, least) with the hottest member that has their min-hash, if it is of
    another group; for each of the min-hashes. With others_only, of the members that are not of the hottest one's
    group, the hottest takes its place."""
    each = members.select("node", "n", "cap", "root", "heat", F.posexplode("least").alias("which", "hash"))
    for again in (True, False) if others_only else (False,):
        top = F.max_by(F.struct("node", "root", "n", "cap"), F.struct("heat", "node")).alias("top")
        ends = each.groupBy("which", "hash").agg(top, F.min("root").alias("lo"), F.max("root").alias("hi"))
        apart = each.join(ends.where("lo < hi").select("which", "hash", "top"), ["which", "hash"]).where("root <> top.root")
        if again:
            each = apart.drop("top")
    apart = apart.where(_near_sizes(F.col("n"), F.col("top.n"), percent) & (F.col("n") <= F.col("top.cap")) & (F.col("top.n") <= F.col("cap")))
    return apart.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge; root is the least node of the component. Alternating stars: every
    round hangs larger neighbours on the least one, in a number of rounds that grows with the logarithm of the size."""
    kept = lambda e: measured(e, n=F.count("*"), seen=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    edges, mark = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, seen = kept(small.union(low.select("a", "m")).distinct())
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", F.col("b").alias("root")).distinct())


def links_between(postings: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups, out of those that the matrix cannot rule out: enough to connect what links.

    postings: (shingle, node, n, cap). The bounds on sizes hold for the members of a group that have the shingle, so
    they are part of the join."""
    held = postings.join(groups, "node", "left").withColumn("g", F.coalesce("root", "node")).drop("root")
    several = held.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("shingle")
    held = materialise(held.join(several, "shingle", "left_semi"))
    rest = F.ceil(F.col("n") * percent / 100.0 - 1e-9) - _depth(F.col("n"), percent)  # shingles outside the signature
    matrix = held.groupBy("shingle", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("cap").alias("cap"), F.max(rest).alias("rest"))
    one, two = (matrix.select(*(F.col(c).alias(c + k) for c in matrix.columns)) for k in "12")
    may = (100 * F.col("hi1") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo1"))
    may = may & (F.col("lo1") <= F.col("cap2")) & (F.col("lo2") <= F.col("cap1"))
    shared = one.join(two, (F.col("shingle1") == F.col("shingle2")) & (F.col("g1") < F.col("g2")) & may)
    lows = [F.min(c).alias(c) for c in ("lo1", "lo2")]
    shared = shared.groupBy("g1", "g2").agg(F.count("*").alias("c"), F.max(F.greatest("rest1", "rest2")).alias("rest"), *lows)
    # of the signature that ends first, what both have lies in both signatures
    most = F.col("c") + F.col("rest")
    bound = (F.col("c") >= _depth(F.least("lo1", "lo2"), percent)) & (100 * most >= percent * (F.col("lo1") + F.col("lo2") - most))
    members = held.select("node", "g", "n", "cap").distinct()
    return opened_groups(shared.where(bound).select("g1", "g2"), members, sets, percent)


def opened_groups(opened: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members of the smaller group of each pair with the larger group.

    Groups below FEW members are compared pair by pair. Larger ones come in blocks of members and of queries, each a
    task's unit of bounded size; a query needs one link with a block, as a group is connected already."""
    size = members.groupBy("g").agg(F.count("*").alias("size"))
    sized = opened.join(size.select(F.col("g").alias("g1"), F.col("size").alias("s1")), "g1").join(size.select(F.col("g").alias("g2"), F.col("size").alias("s2")), "g2")
    first = F.col("s1") <= F.col("s2")
    sides = sized.select(F.when(first, F.col("g1")).otherwise(F.col("g2")).alias("g"), F.when(first, F.col("g2")).otherwise(F.col("g1")).alias("to"), F.greatest("s1", "s2").alias("size"))
    asked = materialise(sides.join(members, "g").select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("cap").alias("capx"), "to", "size").distinct())
    own = members.withColumnRenamed("g", "to")
    near = _near_sizes(F.col("nx"), F.col("n"), percent) & (F.col("nx") <= F.col("cap")) & (F.col("n") <= F.col("capx"))
    pairs = asked.where(F.col("size") < FEW).join(own, "to").where(near).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))

    many = asked.where(F.col("size") >= FEW)
    counts = many.groupBy("to").agg(F.count("*").alias("asking"), F.max("size").alias("size"))
    blocks = counts.select("to", F.ceil(F.col("size") / MEMBERS).alias("mb"), F.ceil(F.col("asking") / QUERIES).alias("qb"))
    block = lambda node, n: F.pmod(F.xxhash64(node), n)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    left = many.select("to", F.col("x").alias("node")).join(blocks, "to").select("to", "node", block("node", F.col("qb")).alias("q"), all_of(F.col("mb")).alias("m"))
    right = own.select("to", "node").join(blocks, "to").select("to", "node", block("node", F.col("mb")).alias("m"), all_of(F.col("qb")).alias("q"))
    left, right = (d.join(sets.select("node", "shingles"), "node").select("to", "m", "q", "node", "shingles") for d in (left, right))
    left = left.toDF("to_x", "m_x", "q_x", "x", "asked")  # both sides come from the same sets
    schema = "a bigint, b bigint"
    target = arrow_schema(schema)

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        found = _first_links(queries, held, percent) if queries.num_rows and held.num_rows else []
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in found], schema=target)

    met = left.groupBy("to_x", "m_x", "q_x").cogroup(right.groupBy("to", "m", "q")).applyInArrow(run, schema)
    return linked(pairs.distinct(), sets, percent).union(met)


def _first_links(queries: pa.Table, held: pa.Table, percent: int) -> list[tuple[int, int]]:
    """(query, member) with the similarity, one for each query that has any."""
    lists = held.column("shingles").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    tokens, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    nodes, out = held.column("node").to_pylist(), []
    for node, own in zip(queries.column("x").to_pylist(), queries.column("asked"), strict=True):
        q = own.values.to_numpy()
        low, high = np.searchsorted(tokens, q, "left"), np.searchsorted(tokens, q, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sizes))
        hit = np.flatnonzero(100 * common >= percent * (len(q) + sizes - common))
        if len(hit):
            out.append((node, nodes[hit[0]]))
    return out


def eligible(postings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, heat) of the nodes that may link; heat: how common the signature is."""
    n, c = F.col("n"), F.col("c")
    size = F.least(n, n - F.ceil(n * percent / 100.0 - 1e-9) + _depth(n, percent))
    met = postings.groupBy("node").agg(F.count("*").alias("c"), F.sum(F.log2("m")).alias("heat")).join(nodes.select("node", "n"), "node")
    return met.where(c >= _depth(F.floor(n * percent / 100), percent)).select("node", "n", (F.col("heat") / size).alias("heat"))


def bounded(chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """chosen with cap, the largest size that a partner can have, where a partner can have any size.

    All nodes that link are chosen, so what a node shares with a partner is among the e shingles that it shares with
    any other chosen node: a partner of size s needs 100 e >= percent (n + s - e)."""
    total = chosen.agg(F.sum("n")).first()[0] or 0
    cap = F.floor(F.coalesce("e", F.lit(0)) * (100 + percent) / percent + 1e-9) - F.col("n")
    both = chosen.join(shared_sizes(sets, _buckets(sets, total)), "node", "left").withColumn("cap", cap)
    return both.where(100 * F.col("cap") >= percent * F.col("n")).select("node", "n", "cap", "heat")


def components(docs: DataFrame, nodes: DataFrame, classes: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all nodes that link with another. nodes: (node, n)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    most = nodes.agg(F.sum(F.least("n", F.col("n") * (100 - percent) / 100 + _depth(F.col("n"), percent)))).first()[0] or 0
    postings = materialise(shared_postings(texts, spark.sparkContext.broadcast(classes), _buckets(docs, int(most)), words, percent))
    chosen = materialise(eligible(postings, nodes, percent))
    sets = materialise(sets_of(texts, chosen, words))
    chosen = materialise(bounded(chosen, sets, percent))
    members = sets.select("node", "least").join(chosen, "node")
    edges, groups = None, None
    for k in range(ROUNDS):
        rooted = members.withColumn("root", F.col("node")) if groups is None else members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        stars = materialise(linked(star_pairs(rooted, percent, k > 0), sets, percent))
        edges = stars if edges is None else edges.union(stars)
        groups = materialise(connected(edges))
    rest = links_between(postings.drop("m").join(chosen.drop("heat"), "node"), groups, sets, percent)
    return connected(edges.union(materialise(rest)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_shingles, component_id and component_node (the component's node, null without words)."""
    made = ("n_shingles", "component_id", "component_node")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]

    def values(_, batch: pa.RecordBatch) -> list[dict]:
        return [{"n": len(s), "node": node_of(s)} for s in shingle_sets(batch.column("text"), words)]

    once = materialise(signed(docs, words))
    classes = joined(once.where("slice is not null"), SKETCH, np.uint32, np.add, lambda x: np.log2(np.maximum(x, 1)).astype(np.uint8))
    small = once.where("slice is null").select("doc_id", "node", "n")
    nodes = materialise(small.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("n").alias("n")))
    rooted = nodes.select("node", "low").join(components(docs, nodes, classes, words, percent), "node", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "node")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    if set(keep) <= {"doc_id"}:
        marked = small.select(_row(keep), "doc_id", "node", "n")
    else:  # columns of docs travel in one struct, out of the way of the names used here
        held = docs.select(_row(keep), "doc_id", "text")
        marked = with_column_from_text(held, "near", "struct<n:bigint,node:bigint>", values, keep=["row", "doc_id"]).select("row", "doc_id", "near.*")
    out = marked.join(rooted.join(lowest, "root").select("node", "root", "lowest"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return out.select(*(F.col("row")[c].alias(c) for c in keep), F.col("n").alias(made[0]), component.alias(made[1]), F.col("root").alias(made[2]))


def _row(columns: list[str]) -> Column:
    """The columns as one struct; a struct needs a field, so that none is a null."""
    return (F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None).cast("struct<none:int>")).alias("row")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the least doc_id (null only if all are); rows that share it are told
    apart by a hash of their columns. Documents without words stay."""
    found = near_duplicates(docs.select(_row(docs.columns), "doc_id", "text"), words, percent, keep=["row", "doc_id"])
    found = found.where(F.col("component_node").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    place = Window.partitionBy("component_node").orderBy(F.xxhash64(F.to_json("row")))
    kept = found.where("component_node is not null").withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
    return kept.union(found.where("component_node is null")).select("row.*")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, keep=["doc_id"]).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT k, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS h
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT k, count(*) AS n, hash(list(h ORDER BY h)) AS node FROM s GROUP BY k),
r AS MATERIALIZED (SELECT node, min(k) AS k, any_value(n) AS n FROM n GROUP BY node),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.k < b.k
      WHERE a.k IN (SELECT k FROM r) AND b.k IN (SELECT k FROM r) GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN r x ON x.k = a JOIN r y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT k AS a, k AS b FROM r UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
root AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY a),
whole AS (SELECT n.k, root.root FROM n JOIN r USING (node) JOIN root ON root.k = r.k),
least_id AS (SELECT root, min(doc_id) AS component_id FROM whole JOIN d USING (k) GROUP BY root)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  CASE WHEN n.k IS NULL THEN d.doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN whole USING (k) LEFT JOIN least_id USING (root)
"""
