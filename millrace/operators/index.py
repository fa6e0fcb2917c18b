"""A stored inverted index that follows changes.

Postings (term, key, weight) lie in buckets of their term's checksum, the slots of a snapshot table, so a search reads the
buckets of its terms and, by the filter on the term, few row groups of them. A batch of changed documents adds its own slots (the new
postings of these documents, by bucket) and one small slot that lists the documents; nothing that is there is read or
written again. A posting counts unless a later batch lists its document. compact() folds the batches into the buckets. One
commit publishes all of a batch, and slots carry the number of the batch, so a batch that runs again changes nothing."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..sinks.snapshots import Snapshots
from . import search

BUCKETS = 64


class StoredIndex:
    """terms(docs) gives (key, lexeme, weight) of documents, a row for each term; key is the name of the key column."""

    def __init__(self, store: Snapshots, key: str, terms: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, name: str = "postings"):
        self.store, self.key, self.terms, self.buckets, self.name = store, key, terms, buckets, name

    def _slotted(self, docs: DataFrame, batch: int) -> DataFrame:
        bucket = F.crc32(F.col("lexeme").cast("binary")) % self.buckets
        return self.terms(docs).withColumns({"batch": F.lit(batch).cast("bigint"), "slot": F.concat_ws(".", bucket.cast("string"), F.lit(str(batch)))})

    def build(self, docs: DataFrame) -> None:
        """Indexes all documents anew; batches that are added later carry numbers from 1 on."""
        stale = {n: self.store.slots(n) for n in (self.name, self._changed)}
        self.store.commit(slotted={self.name: (self._slotted(docs, 0), "slot")}, emptied=stale)

    @property
    def _changed(self) -> str:
        return f"{self.name}_changed"

    def apply(self, docs: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Takes in a batch (number 1 or more, rising) of changed documents, one row a key, and the keys that are gone."""
        keys = docs.select(self.key) if gone is None else docs.select(self.key).unionByName(gone.select(self.key))
        listed = keys.distinct().withColumns({"batch": F.lit(batch).cast("bigint"), "slot": F.lit(str(batch))})
        again = {self.name: [s for s in self.store.slots(self.name) if s.endswith(f".{batch}")], self._changed: [str(batch)]}
        self.store.commit(slotted={self.name: (self._slotted(docs, batch), "slot"), self._changed: (listed, "slot")}, emptied=again)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(key, lexeme, weight) of these terms (of all without them) as of now."""
        slots = self.store.slots(self.name)
        if terms is not None:
            wanted = {str(zlib.crc32(t.encode()) % self.buckets) for t in terms}
            slots = [s for s in slots if s.split(".")[0] in wanted]
        rows = self.store.read(self.name, slots)
        rows = rows if terms is None else rows.where(F.col("lexeme").isin(*terms))
        if self.store.slots(self._changed):
            later = self.store.read(self._changed).groupBy(self.key).agg(F.max("batch").alias("_batch"))
            rows = rows.join(later, self.key, "left").where(F.col("_batch").isNull() | (F.col("batch") >= F.col("_batch")))
        return rows.select(self.key, "lexeme", "weight")

    def compact(self) -> None:
        """Folds all batches into the buckets."""
        bucket = F.crc32(F.col("lexeme").cast("binary")) % self.buckets
        rows = self.postings().withColumns({"batch": F.lit(0).cast("bigint"), "slot": F.concat(bucket.cast("string"), F.lit(".0"))})
        stale = {n: self.store.slots(n) for n in (self.name, self._changed)}
        self.store.commit(slotted={self.name: (rows, "slot")}, emptied=stale)

    def follow(self, stream: DataFrame, checkpoint: str, order: str | None = None):
        """A query that takes in each micro-batch of changed documents; of several rows of a key the last by `order` counts."""

        def run(batch: DataFrame, number: int) -> None:
            last = batch
            if order:
                rest = [c for c in batch.columns if c != self.key]
                last = batch.groupBy(self.key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(self.key, "_row.*")
            self.apply(last, number + 1)

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def search_terms(key: str, fields: dict[str, list[str]], stems: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Terms of full-text search: the weighted postings of search.postings."""
    return lambda docs: search.postings(docs, key, fields, stems)


def match(index: StoredIndex, query: str, stems: bool = False) -> DataFrame:
    """(key, rank) of documents that hold every lexeme of the query, from the buckets of these lexemes."""
    return search.match(index.postings(search.lexemes(query, stems)), index.key, query, stems)


def gram_terms(key: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """Terms of similarity search: the trigrams of a text, with their number as weight."""
    return lambda docs: docs.select(key, trigrams(F.col(text)).alias("g")).select(key, F.explode("g").alias("lexeme"), F.size("g").cast("double").alias("weight"))


def similar(index: StoredIndex, query: str, above: float = search.SIMILARITY) -> DataFrame:
    """(key, similarity) of texts whose trigram similarity with the query is above the threshold, as search.similar gives it
    from a scan of all texts: only the grams of the query are read, and a text has its number of grams with each."""
    asked = sorted(index.store.spark.range(1).select(trigrams(F.lit(query)).alias("g")).first().g)  # of one query
    if not asked:
        return index.postings([]).select(index.key, F.lit(0.0).alias("similarity"))
    shared = index.postings(asked).groupBy(index.key).agg(F.count("*").alias("c"), F.max("weight").alias("n"))
    near = shared.where((F.col("n") > len(asked) * above) & (F.col("c") > F.greatest(F.col("n"), F.lit(float(len(asked)))) * above))
    score = F.col("c") / (F.col("n") + F.lit(len(asked)) - F.col("c"))
    return near.where(score > above).select(index.key, F.round(score, 6).alias("similarity"))
