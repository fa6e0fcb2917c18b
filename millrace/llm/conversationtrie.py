"""Prefix trie of conversations, built as a Patricia trie.

A turn is a key of 40 characters: a digest of role and text, and the length of the text in code points. A conversation is
the string of its turns' keys; equal conversations are one path with a number of members. Paths are sorted once (a range
shuffle). Of two neighbours in that order the length of the common prefix is where the trie branches, so one pass over each
range with a stack makes the points of the trie and nothing else: branch points, ends and leaves; whatever lies between two
points is an edge without nodes. Points whose members lie in several ranges are on the path of the first or of the last row of
a range: there a range adds its share for every depth that it has in common with its neighbour, and shares of a
point are added up by its id, a digest of the prefix. Each range gets the last row of the range before and the first of
the one after by a shuffle. Texts are never sorted or collected; a conversation is one row of 40 bytes a turn (50 million turns
at most, the size of a string).

Subtree sums need no walk of the trie: a point belongs to the first path below it, and the points below it are those
of the paths from its first to its last one, a difference of two running sums over the order (within ranges, plus the sum
of the ranges before), less what the first path has above it. Unary nodes are made last, as places of an edge: their members are
those of the point below, and their sums are that point's plus a suffix sum along the edge.

A node's conversations may be a third of all (a common first turn, or copies): no step groups by node without adding up in
the tasks first, and lists of the conversations that end at a node are hashed as a stream in order, in blocks that
ranges of (node, conversation) have packed.

Defined results: rows without a conv_id are left out; a null role or text is empty; turns come in the order of their number
(null first), equal numbers in the order of the turn's key; rows that repeat a turn are turns of their own; an empty
table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, sliced, table

#: Characters of a turn's key: 32 of the digest and 8 of the length.
WIDTH = 40
#: A task's block of a list of ids, in characters.
BLOCK = 1 << 16
OUT_ROWS = 4096


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys): the keys of each conversation's turns in their order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    key = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), key.alias("key"))
    turns = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(place)).alias("turns"))
    return turns.select("conv_id", F.col("turns.key").alias("keys"))


def rebuilt(sequences: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, keys) of conversations that begin with the first h turns of the one that leads their block of ids and go on
    with their own after the first h; h is crc32(conv_id as text) mod `most`. A leader meets its block only."""
    heads = sequences.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.slice("keys", 1, most - 1).alias("first"))
    own = sequences.withColumns({"head": F.col("conv_id") - F.col("conv_id") % block, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    none = F.array().cast("array<string>")
    keys = F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("keys", F.col("h") + 1, F.size("keys")))
    return own.join(heads, "head", "left").select("conv_id", keys.alias("keys"))


def node_id(path: str) -> str:
    return hashlib.md5(path.encode()).hexdigest()


def ids_along(path: str, depth: int) -> list[str]:
    """The ids of the prefixes of depth 0 to `depth`, in one pass."""
    digest = hashlib.md5()
    out = [digest.hexdigest()]
    for d in range(depth):
        digest.update(path[WIDTH * d : WIDTH * (d + 1)].encode())
        out.append(digest.copy().hexdigest())
    return out


def common_depth(a: str, b: str) -> int:
    return len(commonprefix((a, b))) // WIDTH


class Point:
    """A point on the path of the row at hand, or a depth that a neighbouring range may know as one."""

    __slots__ = ("depth", "id", "first", "n", "least", "leaves", "real", "up", "up_id", "ends")

    def __init__(self, depth, id, first, real, n=0, least=None, up=None, up_id=None, ends=0):
        self.depth, self.id, self.first, self.real, self.n, self.least = depth, id, first, real, n, least
        self.leaves, self.up, self.up_id, self.ends = 0, up, up_id, ends

    def add(self, other: Point) -> None:
        self.first = min(self.first, other.first)
        self.n += other.n
        self.leaves += other.leaves
        if other.least is not None:
            self.least = other.least if self.least is None else min(self.least, other.least)


POINTS = "id string, depth bigint, first bigint, last bigint, n_convs bigint, conv_id bigint, n_leaves bigint, real boolean, up bigint, up_id string, n_ends bigint"


class Range:
    """The points of one range of the sorted paths; emit() gets a tuple of POINTS for each."""

    def __init__(self, emit):
        self.emit, self.stack, self.path, self.last = emit, [], None, None

    def before(self, path: str) -> None:
        self.path = path

    def row(self, path: str, rank: int, n: int, least: int) -> None:
        up = -1 if self.path is None else common_depth(self.path, path)
        if self.last is not None:
            self._close(up, path)
        elif up >= 0:
            self.stack = [Point(d, id, rank, d == 0) for d, id in enumerate(ids_along(path, up))]
        elif path:
            self.stack = [Point(0, node_id(""), rank, True)]
        up_id = node_id(path[: WIDTH * up]) if up >= 0 else None
        self.stack.append(Point(len(path) // WIDTH, node_id(path), rank, True, n, least, up, up_id, n))
        self.path, self.last = path, rank

    def after(self, path: str | None) -> None:
        """Ends the range; path is the first of the next one, None after the last range."""
        if self.last is None:
            return
        to = 0 if path is None else common_depth(self.path, path)
        if path is None and not self.path:
            self.stack[-1].leaves += 1  # nothing but the empty path
        self._close(to, self.path)
        shared, below = ids_along(self.path, to), None
        for d in range(to, -1, -1):
            point = self.stack.pop() if self.stack and self.stack[-1].depth == d else Point(d, shared[d], below.first, d == 0)
            if below:
                point.add(below)
            self._emit(point)
            below = point

    def _close(self, to: int, path: str) -> None:
        """Ends the points below depth `to`, where the row at hand branches off or goes on."""
        if len(self.path) // WIDTH > to:
            self.stack[-1].leaves += 1
        while self.stack[-1].depth > to:
            point = self.stack.pop()
            self._emit(point)
            if not self.stack or self.stack[-1].depth < to:
                self.stack.append(Point(to, node_id(path[: WIDTH * to]), point.first, True))
            self.stack[-1].add(point)
        self.stack[-1].real = True

    def _emit(self, p: Point) -> None:
        self.emit((p.id, p.depth, p.first, self.last, p.n, p.least, p.leaves, p.real, p.up, p.up_id, p.ends))


def _batches(rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in sliced(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def sorted_paths(paths: DataFrame) -> DataFrame:
    """Distinct paths in order: (path, n, least, part, rank); rank rises with the path, part is the range of it."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ordered = distinct.repartitionByRange(n, "path").sortWithinPartitions("path")
    return materialise(ordered.select("path", "n", "least", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rank")))


def points_of(rows: DataFrame) -> DataFrame:
    """Branch, end and leaf points of sorted paths, a row each, as POINTS says (first and last: ranks of the paths below)."""
    edges = rows.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))  # a row for each range
    order = Window.orderBy("part")
    edges = edges.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("rank", "n", "least")]
    sent = [edges.select("part", F.lit(role).alias("role"), F.col(c).alias("path"), *none).where("path is not null") for role, c in ((0, "before"), (2, "after"))]
    own = rows.select("part", F.lit(1).alias("role"), "path", "rank", "n", "least")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionAll(sent[0]).unionAll(sent[1]).repartition(n, "part").sortWithinPartitions("part", "role", "path")
    schema = arrow_schema(POINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        at, of = None, None
        for part, role, path, rank, n, least in _rows(batches):
            if part != at:
                if of:
                    of.after(None)
                at, of = part, Range(found.append)
            if role == 0:
                of.before(path)
            elif role == 1:
                of.row(path, rank, n, least)
            else:
                of.after(path)
                of = None
            if len(found) >= OUT_ROWS:
                yield from _batches(found, schema)
        if of:
            of.after(None)
        yield from _batches(found, schema)

    shares = dealt.mapInArrow(run, POINTS)
    whole = shares.groupBy("id", "depth").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_leaves").alias("n_leaves"), F.max("real").alias("real"), F.max("up").alias("up"), F.max("up_id").alias("up_id"), F.sum("n_ends").alias("n_ends"),
    )
    return whole.where("real").drop("real")


EDGES = """part bigint, rank bigint, id string, top bigint, last bigint, n_convs bigint, conv_id bigint, n_leaves bigint, n_ends bigint,
    saves array<bigint>, below bigint, row_total bigint, parent_id string, parent_conv_id bigint"""


def edges_of(path: str, rank: int, up: int, up_id: str | None, points: list[dict]) -> list[tuple]:
    """The edges of the points that a path brings in, those from depth up + 1 on: tuples of EDGES.

    saves has, for each node of the edge from its top, what the nodes from it down to the point save; below is what the
    deeper edges of this path save, row_total (once a path) what all of them do."""
    out, below = [], 0
    for k in range(len(points) - 1, -1, -1):
        p = points[k]
        above = points[k - 1] if k else {"depth": up, "id": up_id, "conv_id": None}
        saves, total = [], 0
        for d in range(p["depth"], above["depth"], -1):
            total += (p["n_convs"] - 1) * int(path[WIDTH * d - 8 : WIDTH * d], 16) if d else 0
            saves.append(total)
        out.append([rank >> 33, rank, p["id"], above["depth"] + 1, p["last"], p["n_convs"], p["conv_id"], p["n_leaves"], p["n_ends"], saves[::-1], below, 0, above["id"], above["conv_id"]])
        below += total
    out[0][11] = below
    return out


def compressed_edges(rows: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each point with the edge above it. A path brings in at most as many points as it has turns."""
    of_path = points.groupBy("first").agg(
        F.sort_array(F.collect_list(F.struct("depth", "id", "last", "n_convs", "conv_id", "n_leaves", "n_ends"))).alias("points"), F.max("up").alias("up"), F.max("up_id").alias("up_id")
    )
    joined = rows.join(of_path, F.col("rank") == F.col("first")).select("path", "rank", "up", "up_id", "points")
    schema = arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        for row in _rows(batches):
            found += edges_of(*row)
            if len(found) >= OUT_ROWS:
                yield from _batches(found, schema)
        yield from _batches(found, schema)

    return joined.mapInArrow(run, EDGES)


def ends_by_node(paths: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes at which conversations end: of their ids in order, comma-joined."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paths.select(F.md5("path").alias("id"), "conv_id").repartitionByRange(n, "id", "conv_id").sortWithinPartitions("id", "conv_id")
    packed = "id string, start bigint, block string, sha string"
    schema = arrow_schema(packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest of each list that lies within the task, blocks of those on its edges and of long ones."""
        found: list[tuple] = []
        at, ids, size, whole = None, [], 0, False
        for id, conv in _rows(batches):
            if id != at or size > BLOCK:
                if ids:
                    text = ",".join(map(str, ids))
                    whole = whole and id != at
                    found.append((at, None, None, hashlib.sha256(text.encode()).hexdigest()) if whole else (at, ids[0], text, None))
                whole, at, ids, size = at is not None and id != at, id, [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
            if len(found) >= OUT_ROWS:
                yield from _batches(found, schema)
        if ids:
            found.append((at, ids[0], ",".join(map(str, ids)), None))
        yield from _batches(found, schema)

    blocks = materialise(dealt.mapInArrow(pack, packed))
    out = arrow_schema("id string, ends_sha256 string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        at, digest = None, None
        for id, block in _rows(batches):
            if id != at:
                if digest:
                    found.append((at, digest.hexdigest()))
                at, digest = id, hashlib.sha256(block.encode())
            else:
                digest.update(b",")
                digest.update(block.encode())
            if len(found) >= OUT_ROWS:
                yield from _batches(found, out)
        if digest:
            found.append((at, digest.hexdigest()))
        yield from _batches(found, out)

    parted = blocks.where("sha is null").repartition("id").sortWithinPartitions("id", "start").select("id", "block")
    return blocks.where("sha is not null").select("id", F.col("sha").alias("ends_sha256")).unionAll(parted.mapInArrow(stream, "id string, ends_sha256 string"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, keys), one row each, with subtree sums."""
    paths = materialise(sequences.select("conv_id", F.array_join("keys", "").alias("path")))
    rows = sorted_paths(paths)
    points = materialise(points_of(rows))
    edges = materialise(compressed_edges(rows, points))

    # running sums over the order of paths: within ranges, plus the ranges before (a row for each range)
    ranges = edges.groupBy("part").agg(F.sum("row_total").alias("in_part"))
    offset = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", offset.alias("offset"))
    within = F.sum("row_total").over(Window.partitionBy("part").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0))
    summed = materialise(edges.withColumn("within", within).join(ranges, "part").withColumn("upto", F.col("within") + F.col("offset")).drop("within", "offset", "part"))
    at_last = summed.groupBy(F.col("rank").alias("last")).agg(F.max("upto").alias("upto_last"))

    children = edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children")).where("id is not null")
    above = points.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("above"))
    # a common parent (the root, a frequent first turn) makes parent_id a hot key: adaptive execution splits this join
    whole = summed.join(above, "parent_id", "left").join(at_last, "last").join(children, "id", "left").join(ends_by_node(paths), "id", "left")
    nodes = whole.select("*", (F.col("upto_last") - F.col("upto") + F.col("below")).alias("under"), F.posexplode("saves").alias("pos", "saved"))
    point, top = F.col("pos") == F.size("saves") - 1, F.col("pos") == 0
    return nodes.select(
        "conv_id",
        (F.col("top") + F.col("pos")).alias("depth"),
        F.when(top, F.coalesce("parent_conv_id", "above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(point, F.coalesce("n_children", F.lit(0))).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        "n_leaves",
        (F.col("under") + F.col("saved")).alias("saved_tokens"),
        F.coalesce(F.when(point, F.col("ends_sha256")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, k, cp, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS cp
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS head,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (
  SELECT c.conv_id, t.pos AS d, k, cp FROM c JOIN t ON t.conv_id = c.head AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), k, cp
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.head),
p AS (
  SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, cp FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
  FROM (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) JOIN p USING (conv_id, d) GROUP BY path),
kids AS (
  SELECT left(path, CAST(length(path) - 32 AS BIGINT)) AS path, count(DISTINCT path) AS n_children FROM p WHERE d > 0 GROUP BY 1),
node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(n_children), 0) AS n_children, any_value(cp) AS cp
  FROM p LEFT JOIN kids USING (path) GROUP BY path, d),
sub AS (
  SELECT p.path, sum((y.n_convs - 1) * y.cp) AS saved, sum(CAST(y.n_children = 0 AS INT)) AS n_leaves
  FROM node y JOIN p ON p.conv_id = y.conv_id AND p.d <= y.d GROUP BY p.path)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs,
  CAST(x.n_children AS BIGINT) AS n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ends, '')) AS ends_sha256
FROM node x JOIN sub ON sub.path = x.path LEFT JOIN e ON e.path = x.path
LEFT JOIN node up ON x.d > 0 AND up.path = left(x.path, CAST(length(x.path) - 32 AS BIGINT))
"""
