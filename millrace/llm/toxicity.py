"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: counts and densities of the words of a learnt lexicon and of a learnt lexicon of stems (words of over
four letters without a common ending), how many hits stand near a second-person word, density of such words, capitals,
shouted words, punctuation, and obfuscation (letters with digits or symbols between them, and how many of those are in a
lexicon once read as letters). Only the text is an input.

Learning uses labelled rows whose crc32(doc_id as text) mod 4 is not 2, at most about MAX_LABELLED of them, chosen by
a hash of doc_id (the documented bound, and the only one: what is learnt from the sample depends on nothing else of the
corpus). Lexicons are learnt in two halves, and the training features of one half come from the lexicon of the other, so that
trees do not trust words that only this row made a lexicon entry. A tenth part of texts goes by the text, so copies stay
together; the last two calibrate. Scoring runs where texts are read; only the sample is ever shuffled, and the calibration
runs in few tasks as the sample is small. A lexicon above MAX_LEXICON_BYTES stops the job; no entry is dropped.

Defined results: a null text is empty; an empty text has all features 0 and gets the score of such a text; without
labelled rows of both classes every score is the share of label 1 (0 without rows); labels of one doc_id that differ
count as 1 if one is; repeated documents get a row each; an empty table gives an empty one; other columns pass through, but
a column `toxic_score` is replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialise, table, with_column_from_text, without_gc

MAX_LABELLED = 20_000
MAX_LEXICON_BYTES = 32 << 20
MIN_DOCS = 3
MIN_LOG_ODDS = math.log(20)
#: A stem: four letters or more before one of the common endings of the corpus languages, as few as there can be.
STEM = r"^([\s\S]{4,}?)(?:ings?|ed|ly|ern?|en|es|est|as|os|[aenost])?$"
KNOWN = 400_000
THRESHOLD = 0.3
NEAR = 6
FEATURES = (
    "word_hits", "word_density", "stem_hits", "stem_density", "hits_near_you", "you_density", "capitals",
    "shouted", "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_hits", "log_words",
)
#: Second-person words of the corpus languages.
YOU = frozenset(
    "you your yours yourself u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes vosotros tus vuestro".split()
)
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
_STEM = re.compile(STEM)
#: Letters with digits or symbols between them; it starts where a run of letters does and never gives letters back, so a text is
#: read once however long its words are.
_MIXED = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Za-z\x80-\xff]++(?:[0-9@$*!|.\-]++[A-Za-z\x80-\xff]++)+")
#: Letters that digits and symbols stand for.
_READ = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None})
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_LETTER = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0))
_NOT_MARK = bytes(b for b in range(256) if not (0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E))


def stem_of(word: str) -> str:
    """The stem of a word of over four letters, else nothing."""
    return _STEM.match(word)[1] if len(word) > 4 else ""


class Kinds(dict):
    """What a token is: 1 for a word of the lexicon, 2 for one with a stem of it, 4 for a second-person word, summed."""

    def __init__(self, words: frozenset, stems: frozenset):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGE)
        kind = (word in self.words) + 2 * (stem_of(word) in self.stems) + 4 * (word in YOU)
        if len(self) < KNOWN:
            self[token] = kind
        return kind


def features(text: bytes, kinds: Kinds) -> list[float]:
    """The dense features of a text, in the order of FEATURES."""
    found = bytes(map(kinds.__getitem__, text.decode().lower().split()))
    n, size = max(1, len(found)), max(1, len(text))
    each = [found.count(k) for k in range(8)]
    in_words, in_stems, you = each[1] + each[3] + each[5] + each[7], each[2] + each[3] + each[6] + each[7], sum(each[4:])
    near = 0
    if you and in_words + in_stems:
        yours = [i for i, k in enumerate(found) if k & 4]
        at = 0
        for i in (i for i, k in enumerate(found) if k & 3):
            while at < len(yours) and yours[at] < i - NEAR:
                at += 1
            near += at < len(yours) and yours[at] <= i + NEAR
    letters = max(1, len(text.translate(None, _NOT_LETTER)))
    mixed = [m.decode("utf-8", "replace").lower().translate(_READ) for m in _MIXED.findall(text)]
    read = sum(kinds[w] & 3 > 0 for w in mixed)
    return [
        float(in_words), in_words / n, float(in_stems), in_stems / n,
        near / n, you / n, len(text.translate(None, _NOT_UPPER)) / letters, text.count(b"!!") / n,
        text.count(b"!") / size, text.count(b"?") / size, len(text.translate(None, _NOT_MARK)) / size,
        len(mixed) / n, float(read), math.log1p(len(found)),
    ]


def lexicons(sample: DataFrame) -> list[tuple[frozenset, frozenset]]:
    """Words and stems that stand in far more texts of label 1 (at least MIN_DOCS texts and MIN_LOG_ODDS), learnt from
    the rows (text, toxic, part) of even parts, of odd parts and of all. Texts with the same words count once."""
    tokens = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(_EDGE))))
    texts = sample.select("toxic", tokens.alias("w"), (F.col("part") % 2).alias("half")).groupBy("toxic", "w").agg(F.min("half").alias("half"))
    stems = F.array_distinct(F.transform(F.filter("w", lambda w: F.length(w) > 4), lambda w: F.regexp_extract(w, STEM, 1)))
    entry = lambda whole: lambda w: F.struct(F.lit(whole).alias("whole"), w.alias("entry"))
    entries = F.concat(F.transform("w", entry(True)), F.transform(stems, entry(False)))
    side = [((k, c), (F.col("half") == k) & (F.col("toxic") == c)) for k in (0, 1) for c in (0, 1)]
    n = [F.count_if(x).alias(f"n{k}{c}") for (k, c), x in side]
    total = texts.agg(*n).first()
    counted = texts.select("toxic", "half", F.inline(entries)).where("length(entry) >= 3").groupBy("whole", "entry").agg(*n)
    keep = []
    for halves in ((0,), (1,), (0, 1)):
        here, all_of = ([sum(x(f"n{k}{c}") for k in halves) for c in (0, 1)] for x in (F.col, lambda name: total[name] or 0))
        odds = F.log((here[1] + 0.5) / (all_of[1] + 1.0)) - F.log((here[0] + 0.5) / (all_of[0] + 1.0))
        keep.append((here[1] >= MIN_DOCS) & (odds >= MIN_LOG_ODDS))
    chosen = materialise(counted.select("whole", "entry", F.array(*keep).alias("of")).where(F.exists("of", lambda x: x)))
    size = chosen.agg(F.sum(F.octet_length("entry"))).first()[0] or 0
    if size > MAX_LEXICON_BYTES:
        raise ValueError(f"the lexicon has {size} bytes; lower max_labelled or raise MAX_LEXICON_BYTES")
    rows = chosen.collect()
    return [tuple(frozenset(r.entry for r in rows if r.of[k] and r.whole == whole) for whole in (True, False)) for k in range(3)]


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, toxic, part) of the rows to learn from; part is 0 to 9."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = max_labelled / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_labelled rows of two numbers: a proven bound for the broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    return materialise(rows.withColumn("part", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(10)).cast("int")))


def _featured(docs: DataFrame, lexicons: list[tuple[frozenset, frozenset]], keep: list[str]) -> DataFrame:
    """docs (columns `keep`) with `x`; a column `part`, if there is one, picks the lexicon of the other half."""
    held = docs.sparkSession.sparkContext.broadcast(lexicons)
    halves = "part" in docs.columns

    made: list[Kinds] = []

    def values(texts: list[bytes], batch) -> list[list[float]]:
        made or made.extend(Kinds(*x) for x in held.value)
        which = [1 - p % 2 for p in batch.column("part").to_pylist()] if halves else [0] * len(texts)
        with without_gc():
            return [features(t, made[k]) for t, k in zip(texts, which, strict=True)]

    return with_column_from_text(docs, "x", "array<double>", values, keep=keep)


class Model:
    """Lexicons, trees and calibration; or a constant share if there was one class only."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED):
        rows = training_rows(docs, labels, max_labelled)
        n = rows.agg(F.count("*"), F.sum("toxic")).first()
        self.share = (n[1] or 0) / max(1, n[0])
        self.trees = None
        if not 0 < self.share < 1:
            return
        *halves, self.lexicon = lexicons(rows)
        x = materialise(_featured(rows, halves, ["doc_id", "toxic", "part"])).orderBy("part", "doc_id")  # trees follow the order of rows
        x = x.withColumn("features", array_to_vector("x")).withColumn("label", F.col("toxic").cast("double"))
        fit, check = x.where("part < 8").coalesce(4), x.where("part >= 8")
        if fit.select("label").distinct().count() < 2:
            return
        trees = GBTClassifier(maxIter=20, maxDepth=4, minInstancesPerNode=2, stepSize=0.2, seed=7)
        self.trees = trees.fit(fit)
        scored = self.trees.transform(check).select("label", vector_to_array("probability")[1].alias("p"))
        assembled = VectorAssembler(inputCols=["p"], outputCol="v").transform(scored)
        self.calibration = None
        if assembled.select("label").distinct().count() == 2:
            self.calibration = IsotonicRegression(featuresCol="v", labelCol="label", predictionCol="score").fit(assembled)

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """docs (columns `keep`) with a column `toxic_score`."""
        keep = [c for c in keep if c != "toxic_score"]
        if self.trees is None:
            return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(self.share)).alias("toxic_score"))
        # columns of docs travel in one struct, out of the way of the names that the models add
        held = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
        x = _featured(held, [self.lexicon], ["row"]).select("row", array_to_vector("x").alias("features"))
        p = self.trees.transform(x).select("row", vector_to_array("probability")[1].alias("p"))
        if self.calibration is None:
            score = p.withColumnRenamed("p", "score")
        else:
            score = self.calibration.transform(VectorAssembler(inputCols=["p"], outputCol="v").transform(p))
        bounded = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return score.select(*(F.col("row")[c].alias(c) for c in keep), bounded.alias("toxic_score"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score the threshold or more."""
    return Model(docs, labels).score(docs, docs.columns).where(F.col("toxic_score") < threshold).drop("toxic_score")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = Model(docs, table(spark, sf_dir, "labels")).score(docs, ["doc_id"])
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
