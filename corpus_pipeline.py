"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first four return the columns
of documents; where a stage changes a text, n_chars follows. A stage's result is written as Parquet in the shared
folder and read again, so that a lost executor costs a read and not the stages before.

Defined results: a null or empty text is not toxic unless such texts score so, keeps its text, has no near duplicates, is
clean and has no tokens; a null doc_id is carried through (where documents are alike, it is kept only if all of them have
none). Of equal texts the least doc_id keeps its lines and stays; rows that repeat an id and a text are one document to line
dedup, and one of them stays. Further columns, whatever their names, pass through the first four stages. Empty tables give
an empty result; without labels of both classes the share of toxic labels decides for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import digests
from millrace.llm.common import materialise, table
from millrace.llm.decontaminate import remove_documents
from millrace.llm.linededup import dedup_lines
from millrace.llm.ngramjoin import one_of_each
from millrace.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled ones among docs."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of lines."""
    out = dedup_lines(docs)
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract's rule allows."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens and the digests of ids and decoded text."""
    return digests(docs, keep=["doc_id"]).select("doc_id", "bpe.*")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The first stage learns a model and the last follows a tokenizer file, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
