"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics of a text are shares (of words without a letter or digit, of words equal to the one before, of words that end
in a symbol, of shouted words, capitals, symbols, digits, different words, repeated lines) and sizes (words, letters a word,
letters a line). A share has a few imaginary plain words added, so that one odd word of a short text says little, and is
taken as log-odds; sizes are taken as logarithms. Only the text is an input.

Learning adds up, by class, the number of rows, the statistics and their products over all labelled rows whose
crc32(doc_id as text) mod 5 is not 0: one aggregation to two rows, whatever the number of labels. From these come means and
covariances of each class. A covariance is shrunk towards the pooled one (SHRINK) and then towards a multiple of the identity
(RIDGE), so it can be inverted however few rows a class has; its Cholesky factor is computed once and travels to the
tasks. The log-density of a class is a Mahalanobis distance under that factor, and the score is the logistic function of
the difference of the log posteriors, divided by the number of statistics: these depend on one another, so the
sum of their evidence would claim too much.

The features of all texts are computed in one pass; only (doc_id, statistics) is shuffled to meet the labels.

Defined results: a null text is empty; an empty text has the statistics of no words and the score of such a text; without
labelled rows of both classes every score is the share of label 1 (0 without rows); labels of one doc_id that differ
count as 1 if one is; each of repeated labelled documents counts; repeated documents get a row each; an empty table
gives an empty one; other columns pass through, but columns `statistics` and `quality_score` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_fold, materialise, sliced, table, with_column_from_text

THRESHOLD = 0.3
SHRINK, RIDGE = 0.02, 0.02
#: Plain words added to a text before shares are taken, and what keeps the log-odds of shares 0 and 1 finite.
PRIOR_WORDS, SMOOTH = 12, 0.02
STATISTICS = (
    "bare_words", "repeated_words", "symbol_ends", "shouted", "junk_words", "capitals", "symbols", "digits",
    "different_words", "repeated_lines", "log_words", "log_word_length", "log_line_length",
)
_BARE = b"|-*#=_~.:;,/\\+<>"
_SYMBOLS = b"#*$%&|<>"
_ENDS = (b"#", b"*", b"$", b"%", b"&", b"|", b"=", b"~", b"_", b"\\", b"^")
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_LETTER = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0))
_NOT_DIGIT = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)
_NOT_COUNTED = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])  # UTF-8 continuation bytes and white space


def _odds(count: float, of: float) -> float:
    share = min(1.0, count / of)
    return math.log((share + SMOOTH) / (1 - share + SMOOTH))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n, n_lines = len(words), len(lines)
    of = n + PRIOR_WORDS
    size = len(text.translate(None, _NOT_COUNTED))
    letters = len(text.translate(None, _NOT_LETTER))
    bare = sum(not w.translate(None, _BARE) for w in words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(w.endswith(_ENDS) for w in words) - sum(w in (b"|", b"*", b"#") for w in words)
    shouted = text.count(b"!!")
    return [
        _odds(bare, of), _odds(repeated, of), _odds(ends, of), _odds(shouted, of), _odds(bare + repeated + ends + shouted, of),
        _odds(len(text.translate(None, _NOT_UPPER)), letters + 5 * PRIOR_WORDS),
        _odds(len(text) - len(text.translate(None, _SYMBOLS)), of),
        _odds(len(text.translate(None, _NOT_DIGIT)), size + 5 * PRIOR_WORDS),
        _odds(len(set(words)) + PRIOR_WORDS, of), _odds(n_lines - len(set(lines)), n_lines + 3),
        math.log1p(n), math.log((size + 5 * PRIOR_WORDS) / of), math.log((size + 60) / (n_lines + 1)),
    ]


def with_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (columns `keep`, else all) with an array `statistics`."""
    return with_column_from_text(docs, "statistics", "array<double>", lambda texts, _: [statistics(t) for t in texts], keep=keep)


class Model:
    """Two shrunk normal distributions, or a constant share if there was one class only."""

    def __init__(self, featured: DataFrame, labels: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE):
        """featured has doc_id and statistics; labels has doc_id and quality."""
        own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), 5) != 0))
        own = own.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        x, d = [F.col("statistics")[i] for i in range(len(STATISTICS))], len(STATISTICS)
        pairs = [(i, j) for i in range(d) for j in range(i + 1)]
        sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
        rows = featured.select("doc_id", "statistics").join(own, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *sums)
        found = {r.quality: r for r in rows.where("quality in (0, 1)").collect()}  # one row for each class
        total = sum(r.n for r in found.values())
        self.share = found[1].n / total if 1 in found else 0.0
        self.classes = None
        if len(found) < 2:
            return
        n, mean, products = [], [], []
        for k in (0, 1):
            r, product = found[k], np.zeros((d, d))
            for i, j in pairs:
                product[i, j] = product[j, i] = r[f"p{i}_{j}"]
            n.append(r.n)
            mean.append(np.array([r[f"s{i}"] for i in range(d)]) / r.n)
            products.append(product / r.n)
        centre = sum(c * m for c, m in zip(n, mean, strict=True)) / total
        spread = np.sqrt(np.maximum(np.diag(sum(c * p for c, p in zip(n, products, strict=True)) / total) - centre**2, 0))
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        # in units of the overall spread, so that the multiple of the identity means the same for all statistics
        own_covariance = [(p - np.outer(m, m)) / np.outer(self.scale, self.scale) for p, m in zip(products, mean, strict=True)]
        pooled = sum(c * s for c, s in zip(n, own_covariance, strict=True)) / total
        self.classes = []
        for k in (0, 1):
            covariance = (1 - shrink) * own_covariance[k] + shrink * pooled
            covariance = (1 - ridge) * covariance + ridge * max(np.trace(covariance) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(covariance)
            constant = math.log(n[k] / total) - np.log(np.diag(factor)).sum()
            self.classes.append((mean[k] / self.scale, np.linalg.inv(factor), constant))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Differences of the log posteriors of rows of statistics, divided by the number of statistics."""
        z = x / self.scale
        zero, one = (c - 0.5 * (((z - m) @ inverse.T) ** 2).sum(1) for m, inverse, c in self.classes)
        return (one - zero) / x.shape[1]

    def score(self, featured: DataFrame) -> DataFrame:
        """featured with `quality_score` in place of `statistics`."""
        keep = [c for c in featured.columns if c not in ("statistics", "quality_score")]
        if self.classes is None:
            return featured.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(self.share)).alias("quality_score"))
        held = featured.sparkSession.sparkContext.broadcast(self)
        out = T.StructType([*(featured.schema[c] for c in keep), T.StructField("quality_score", T.DoubleType())])
        target = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                made = pa.array(1 / (1 + np.exp(-np.clip(held.value.log_odds(x), -700, 700))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(target.field(c).type) for c in keep), made], schema=target)

        return featured.select(*(F.col(f"`{c}`") for c in keep), "statistics").mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score the threshold or more. Texts are read twice, and no text is written or shuffled."""
    model = Model(with_statistics(docs.select("doc_id", "text"), ["doc_id"]), labels)
    return model.score(with_statistics(docs)).where(F.col("quality_score") >= threshold).drop("quality_score")


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = materialise(with_statistics(docs, ["doc_id"]))
    return Model(featured, table(spark, sf_dir, "labels")).score(featured).select(
        "doc_id",
        (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
