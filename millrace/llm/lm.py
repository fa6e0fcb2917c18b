"""LM scoring by deleted interpolation.

The probability of a word after its context mixes maximum-likelihood estimates of order 2 and 1 and a uniform share.
Mixture weights depend on the bucket (power of two) of the context's frequency and are learnt by expectation
maximisation on held-out counts: a seventh of the training documents is set apart, its tokens are scored with the
counts of the others, and the weights maximise their likelihood. The final counts are those of all training documents.

    p(w | h) = l2[b] c(h, w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1),   b = bucket of c(h)

How it runs. Each task packs its documents into batches of about BATCH_BYTES of text, which are written compressed to
the shared folder. A batch turns its distinct n-grams into 64-bit hashes, splits them by hash into buckets, and sends
each bucket one packed row with its counts: a map-side pre-aggregation, so a frequent n-gram costs a bucket one entry
for each batch, never one for each token. A bucket sums the counts and answers every batch in the order asked; there are
as many buckets as keep one at about 25 MB whatever the size of the corpus. The answers are written to the shared folder too, and batches meet their answers to give the events for EM and the scores.

Both batches and buckets grow with the corpus, and so would a row for each pair of them. Beyond WIDE buckets requests therefore
go by two levels: a batch sends a row to each of about sqrt(buckets) ranges of buckets; of each range the rows of about as many
batches meet in a cell, which adds up their counts and sends each bucket of the range one row; the buckets answer cells, and cells their
batches. So n batches make about n ** 1.5 rows instead of n ** 2, each cell holds about what a bucket does, and results are the same.
Counts grow with the corpus and are never cut, capped or sampled, nor are they collected: only the weights (a few
numbers for each bucket), N and V reach the driver.

Defined results: a null text is empty and holds the end token alone; a null doc_id counts as empty text for the fold
and stays null; repeated rows are scored each and count each; an empty table gives an empty one; other columns, whatever
their names, are not carried.

The order is 2: packed trigrams would more than double what is sent and answered (see the README).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, crc_fold, materialise, sliced, table

BATCH_BYTES = 10 << 20
#: Text for each bucket at most: its n-grams and their counts take about twice as much.
BUCKET_BYTES = 12 << 20
FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: Buckets beyond which requests go by two levels.
WIDE = 4096
ITERATIONS, TOLERANCE = 25, 1e-4
END = b"\n"  # no word: words hold no white space
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
PACKS = "batch long, tuning boolean, doc_id array<bigint>, fold array<int>, size array<int>, text binary"
REQUESTS = "bucket int, batch long, hashes binary, retained binary, tuning binary"
ANSWERS = "bucket int, batch long, retained binary, tuning binary, types long, tokens long, retained_types long, retained_tokens long"
EVENTS = "context long, pair long, word long, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Batch:
    """Tokens of some texts: word hashes, bigram hashes and, distinct and sorted, the hashes to ask for."""

    def __init__(self, texts: list[bytes]):
        from xxhash import xxh64_intdigest

        numbers: dict[bytes, int] = {}
        each = []
        for text in texts:
            words = text.lower().split()
            words.append(END)
            each.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        self.sizes = np.array([len(e) for e in each], np.int64)
        ids = np.concatenate(each)
        first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        end = numbers[END]
        before = np.concatenate([[end], ids[:-1]])
        before[first] = end  # a text starts after an end
        words = np.fromiter((xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        pairs, self.pair = np.unique(before * len(numbers) + ids, return_inverse=True)
        with np.errstate(over="ignore"):
            pair_hashes = mixed(words[pairs // len(numbers)] * _PAIR + words[pairs % len(numbers)])
        self.word, self.before = ids, before
        self.texts = np.repeat(np.arange(len(texts)), self.sizes)
        # words are marked by the lowest bit, so that types and tokens can be told from pairs
        self.asked = np.concatenate([words | np.uint64(1), pair_hashes & ~np.uint64(1)])
        self.n_words = len(words)

    def dealt(self, spread: Spread) -> tuple[np.ndarray, np.ndarray]:
        """An order of `asked` by range of buckets and hash, and where each range starts."""
        place = spread.bucket(self.asked) // spread.width
        order = np.lexsort((self.asked, place))
        return order, np.searchsorted(place[order], np.arange(spread.ranges + 1))


class Spread(NamedTuple):
    """Buckets of hashes, in ranges of `width` buckets each."""

    ranges: int
    width: int = 1

    @staticmethod
    def of(buckets: int) -> Spread:
        """Ranges of one bucket, or about sqrt(buckets) ranges of as many where there are over WIDE."""
        ranges = buckets if buckets <= WIDE else math.isqrt(buckets - 1) + 1
        return Spread(ranges, -(-buckets // ranges))

    @property
    def buckets(self) -> int:
        return self.ranges * self.width

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)


def packed(docs: DataFrame) -> DataFrame:
    """Batches of documents; those of the tuning fold have batches of their own. Written to the shared folder, so that
    what a batch holds stays the same whenever a task is run again."""
    target = arrow_schema(PACKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, squeeze = TaskContext.get().partitionId() << 24, zstandard.ZstdCompressor(3)  # a batch is twice its number, plus one for tuning
        held: dict[bool, list[tuple]] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def full(tuning: bool) -> pa.RecordBatch:
            nonlocal number
            ids, folds, texts = zip(*held[tuning], strict=True)
            row = [2 * number + tuning, tuning, ids, folds, [len(t) for t in texts], squeeze.compress(b"".join(texts))]
            number += 1
            held[tuning], sizes[tuning] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, target, strict=True)], schema=target)

        for batch in sliced(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), texts, strict=True):
                tuning, text = row[1] == TUNING, row[2] or b""
                held[tuning].append((row[0], row[1], text))
                sizes[tuning] += len(text) + 8
                if sizes[tuning] >= BATCH_BYTES:
                    yield full(tuning)
        for tuning in held:
            if held[tuning]:
                yield full(tuning)

    fold = crc_fold(F.col("doc_id"), FOLDS).cast("int").alias("fold")
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold, "text").mapInArrow(run, PACKS))


def unpacked(pack: pa.RecordBatch | pa.Table, row: int) -> tuple[list, np.ndarray, list[bytes]]:
    """doc_ids, folds and texts of a pack."""
    import zstandard

    ids, folds, sizes, blob = (pack.column(c)[row].as_py() for c in ("doc_id", "fold", "size", "text"))
    whole, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(sizes).tolist()
    return ids, np.array(folds), [whole[b - n : b] for n, b in zip(sizes, ends, strict=True)]


def _whole(groups: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows that follow each other with one value of `column`, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in groups:
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield last, pa.Table.from_batches(held)


def _ask(packs: DataFrame, spread: Spread) -> DataFrame:
    """A packed row for each batch and range of buckets. Documents that are held out ask, but do not count. A batch counts for the
    retained documents or for the tuning ones; what it does not count for is left empty."""
    target = arrow_schema(REQUESTS)

    def run(batches):
        for packs in batches:
            for k in range(packs.num_rows):
                _, folds, texts = unpacked(packs, k)
                made = Batch(texts)
                learnt = np.repeat(folds != HELD_OUT, made.sizes)
                counts = [np.bincount(x[learnt], minlength=n) for x, n in ((made.word, made.n_words), (made.pair, len(made.asked) - made.n_words))]
                counts = np.concatenate(counts).astype(np.uint32)
                order, starts = made.dealt(spread)
                parts = [order[a:b] for a, b in zip(starts, starts[1:])]
                sides = [[counts[p].tobytes() for p in parts], [b""] * spread.ranges]
                if packs.column("tuning")[k].as_py():
                    sides.reverse()
                columns = [list(range(spread.ranges)), [packs.column("batch")[k].as_py()] * spread.ranges, [made.asked[p].tobytes() for p in parts], *sides]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return packs.mapInArrow(run, REQUESTS)


def _summed(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The sorted distinct hashes of requests, the places of each row's hashes among them, and the sums of both kinds of counts."""
    hashes = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    sizes = [len(h) for h in hashes]
    keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = []
    for side in ("retained", "tuning"):
        given = [np.frombuffer(x, f"<u{len(x) // n}") if x else np.zeros(n, np.uint8) for x, n in zip(rows.column(side).to_pylist(), sizes, strict=True)]
        # whole numbers below 2 ** 53 are exact in these sums
        sums.append(np.bincount(place, np.concatenate(given).astype(np.float64), len(keys)).astype(np.uint64))
    return keys, np.split(place, np.cumsum(sizes)[:-1]), sums


def _cells(asked: DataFrame, batches_in_task: int, spread: Spread) -> DataFrame:
    """asked with `cell`: a range and a group of about as many batches as there are ranges, those of tasks that follow each other."""
    tasks = max(1, spread.ranges // max(1, batches_in_task))
    group = F.floor(F.shiftright("batch", 25) / F.lit(tasks)).cast("long")
    return asked.withColumn("cell", group * spread.ranges + F.col("bucket"))


def _merged(asked: DataFrame, spread: Spread) -> DataFrame:
    """Requests of cells: a packed row for each cell and bucket of its range, with the sums of the cell's batches."""
    target = arrow_schema(REQUESTS)

    def run(groups):
        for cell, rows in _whole(groups, "cell"):
            keys, _, sums = _summed(rows)
            bucket = spread.bucket(keys)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = [p for p in np.split(order, edges) if len(p)]
            columns = [[int(bucket[p[0]]) for p in parts], [cell] * len(parts), [keys[p].tobytes() for p in parts], *([s[p].tobytes() for p in parts] for s in sums)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return asked.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, REQUESTS)


def _returned(asked: DataFrame, answers: DataFrame, spread: Spread) -> DataFrame:
    """The answers to cells as answers to their batches, a row for each batch and range."""
    target = arrow_schema(ANSWERS)

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        keys, places, _ = _summed(mine)
        bucket = spread.bucket(keys)
        order = np.argsort(bucket, kind="stable")
        found = np.zeros((2, len(keys)), np.uint64)
        for b, *packed in zip(*(told.column(c).to_pylist() for c in ("bucket", "retained", "tuning")), strict=True):
            at = order[np.searchsorted(bucket[order], b) : np.searchsorted(bucket[order], b, "right")]
            for side, p in enumerate(packed):
                found[side, at] = large(p)
        rows = zip(mine.column("bucket").to_pylist(), mine.column("batch").to_pylist(), places, strict=True)
        columns = zip(*([b, n, *(small(f[at]) for f in found), 0, 0, 0, 0] for b, n, at in rows), strict=True)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    told = answers.withColumnRenamed("batch", "cell")
    return asked.groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(run, ANSWERS)


def _answer(asked: DataFrame, buckets: int) -> DataFrame:
    """The summed counts of each packed row's n-grams, retained and tuning apart; types and tokens of each bucket, once."""
    target = arrow_schema(ANSWERS)

    def run(groups):
        for bucket, rows in _whole(groups, "bucket"):
            keys, places, sums = _summed(rows)
            words = (keys & np.uint64(1)) == 1
            told = [int(f(x)) for x in ((sums[0] + sums[1])[words], sums[0][words]) for f in (np.count_nonzero, np.sum)]
            for batch, mine in zip(rows.column("batch").to_pylist(), places, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], f.type) for x, f in zip([bucket, batch, *(small(s[mine]) for s in sums), *told], target, strict=True)],
                    schema=target,
                )
                told = [0] * len(told)

    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(run, ANSWERS)  # a bucket for each task


def small(counts: np.ndarray) -> bytes:
    """Counts packed in the least of 1, 2, 4 or 8 bytes each, which the first byte names, and deflated."""
    import zlib

    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(counts) or int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def large(packed: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64)


def _met(packs: DataFrame, answers: DataFrame, spread: Spread, schema: str, give) -> DataFrame:
    """Each batch with its answers: give(doc_ids, folds, batch, retained, tuning) returns the columns of schema."""
    target = arrow_schema(schema)

    def run(pack: pa.Table, told: pa.Table) -> pa.Table:
        ids, folds, texts = unpacked(pack, 0)
        made = Batch(texts)
        order, starts = made.dealt(spread)
        found = np.zeros((2, len(made.asked)), np.int64)
        for bucket, *packed in zip(*(told.column(c).to_pylist() for c in ("bucket", "retained", "tuning")), strict=True):
            for side, p in enumerate(packed):
                found[side, order[starts[bucket] : starts[bucket + 1]]] = large(p)
        columns = give(ids, folds, made, *found)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole log2 of its count."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def _events(ids, folds, made, retained, tuning):
    """Tokens of the tuning fold as (context count, pair count, word count) among the retained documents."""
    word, pair = retained[: made.n_words], retained[made.n_words :]
    found = np.stack([word[made.before], pair[made.pair], word[made.word]])
    unseen = (found[1] == 0) & (found[0] > 0)  # only the bucket of the context matters for these
    found[0, unseen] = 1 << (context_bucket(found[0, unseen]) - 1)
    events, n = np.unique(found, axis=1, return_counts=True)
    return *events, n


def learn_weights(events: DataFrame, types: int, tokens: int, iterations: int = ITERATIONS) -> dict[int, tuple[float, float, float]]:
    """EM: the weights (pair, word, uniform) of each context bucket. One row for each bucket reaches the driver."""
    spark = events.sparkSession
    bucket = F.when(F.col("context") > 0, F.floor(F.log2("context")) + 1).otherwise(0)
    p2 = F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
    held = events.select(bucket.cast("int").alias("b"), p2.alias("p2"), (F.col("word") / F.lit(float(max(1, tokens)))).alias("p1"), "n").persist()
    buckets = [r.b for r in held.select("b").distinct().collect()]
    weights = {b: ((0.6, 0.3, 0.1) if b else (0.0, 0.9, 0.1)) for b in buckets}
    p0 = F.lit(1.0 / (types + 1.0))
    for _ in range(iterations):
        if not weights:
            break
        now = F.broadcast(spark.createDataFrame([(b, *w) for b, w in weights.items()], "b int, w2 double, w1 double, w0 double"))
        parts = [F.col("w2") * F.col("p2"), F.col("w1") * F.col("p1"), F.col("w0") * p0]
        whole = parts[0] + parts[1] + parts[2]
        sums = held.join(now, "b").groupBy("b").agg(*(F.sum(F.col("n") * x / whole).alias(f"s{k}") for k, x in enumerate(parts)), F.sum("n").alias("n"))
        new = {r.b: (r.s0 / r.n, r.s1 / r.n, r.s2 / r.n) for r in sums.collect()}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if moved < TOLERANCE:
            break
    held.unpersist()
    return weights


def _scorer(weights: dict[int, tuple[float, float, float]], tokens: int, types: int):
    top = max([64, *weights])
    shares = np.zeros((top + 1, 3))
    last = (0.0, 0.9, 0.1)
    for b in range(top + 1):  # a bucket without held-out events takes the weights of the one below
        last = shares[b] = weights.get(b, last if b != 1 else (0.6, 0.3, 0.1))

    def give(ids, folds, made, retained, tuning):
        counts = retained + tuning
        word, pair = counts[: made.n_words], counts[made.n_words :]
        c, c2, h = word[made.word], pair[made.pair], word[made.before]
        w2, w1, w0 = shares[context_bucket(h)].T
        p = w2 * c2 / np.maximum(h, 1) + w1 * c / max(1, tokens) + w0 / (types + 1.0)
        summed = lambda x: np.bincount(made.texts, x, len(made.sizes))
        base = summed(np.log10((c + 1.0) / (tokens + types + 1.0)))
        return ids, folds == HELD_OUT, made.sizes, summed(c > 0).astype(np.int64), base, summed(np.log10(p))

    return give


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens) of all documents."""
    packs = packed(docs)
    told = packs.agg(F.sum(F.aggregate("size", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.count("*"), F.count_distinct(F.shiftright("batch", 25))).first()
    size, n, tasks = (x or 0 for x in told)
    spread = Spread.of(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    asked = _ask(packs, spread)
    if spread.width > 1:
        asked = materialise(_cells(asked, n // max(1, tasks), spread))
        first = materialise(_answer(_merged(asked, spread), spread.buckets))
        answers = materialise(_returned(asked, first, spread))
    else:
        first = answers = materialise(_answer(asked, spread.buckets))
    sums = first.agg(*(F.sum(c) for c in ("types", "tokens", "retained_types", "retained_tokens"))).first()
    types, tokens, *retained = (x or 0 for x in sums)
    events = materialise(_met(packs.where("tuning"), answers.where("batch % 2 = 1"), spread, EVENTS, _events))
    weights = learn_weights(events, *retained)
    scored = _met(packs, answers, spread, SCORES, _scorer(weights, tokens, types))
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base on held-out and on training documents."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(ten("score").alias("model"), ten("base_score").alias("base"))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
