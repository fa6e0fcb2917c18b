"""Helpers shared by the llm operators: tables, batches, word splitting."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import materialise, measured  # noqa: F401

#: Rows and bytes that are worked on at once. Spark bounds what Arrow hands to Python (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words after lower-casing A-Z; all others become a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most `rows` rows and about BATCH_BYTES bytes, one row at least; nothing is copied."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


_uses = 0


@contextmanager
def without_gc():
    """Caches of a task hold no cycles; walking them again and again costs more than the work. Workers are used again, so
    collection is on again afterwards. After the 1st, 2nd, 4th, 8th use and so on what lives then, mostly the caches, is left out
    of later collections; it is freed as ever once nothing refers to it."""
    global _uses
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        _uses += 1
        if on:
            if not _uses & (_uses - 1):
                gc.freeze()
            gc.enable()


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 texts of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def normal_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.translate(_NORMAL).split()


def with_column_from_text(
    df: DataFrame,
    name: str,
    kind: str,
    values: Callable[[list[bytes], pa.RecordBatch], Iterable | pa.Array],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """df (or its columns `keep`) with a column `name` of type `kind`; values(texts, batch) gives it for each Arrow batch.

    A column of that name is replaced; values() sees it if it is of that type. A null text is empty. Texts do not travel back to the JVM unless kept."""
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    empty = F.lit(None).cast(kind).alias(name)
    same = name in df.columns and df.schema[name].dataType == df.select(empty).schema[name].dataType
    source = df if same else df.withColumn(name, empty)
    source = source.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text, name])))
    out = T.StructType([*(source.schema[c] for c in keep), T.StructField(name, source.schema[name].dataType)])
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = values([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()], batch)
            made = made if isinstance(made, pa.Array) else pa.array(made, target.field(name).type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(target.field(c).type) for c in keep), made], schema=target)

    return source.mapInArrow(run, out)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
