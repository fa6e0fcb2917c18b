"""Line dedup by a suffix array over line-id sequences, built by distributed prefix doubling, two doublings a round. DataFrame
operations only.

Each text is a sequence of line ids (md5 of a line; lines without a word are passed over). Suffix i of the corpus
starts at line i. Round k orders all suffixes by their first 4^k lines: the ranks of their four quarters are sorted by
range, and the place of each distinct four in that order is its new rank, so equal
ranks are exactly the intervals of the suffix array whose longest common prefix is 4^k lines or more. A suffix alone
in its interval repeats nothing and leaves the work; most lines go before the first round.

A run of lines is a copy if it has `min_words` words or more and occurred before. Its least windows (the shortest
from each line forwards and from each line backwards that reach min_words) cover every such run, so rounds stop once
4^k passes the longest window: every line has a word, hence after log4(min_words) rounds however long texts are. A
window of m lines falls in the interval of up to four overlapping ranks of 4^k < m lines. The first place of each interval
stays, and all later windows are deleted; overlapping windows join to the maximal runs.

Scale: a line costs some 60 bytes in two shuffles; texts are shuffled once, to meet the numbers of their deleted
lines. Counts of a line are pre-aggregated, no group is collected, and hot lines only meet as the large side of joins
with one row for each line, which adaptive execution splits. Ranks are written to the shared folder, as their
numbering must not change when a lost task is run again.

Order of places: doc_id (null last), then md5 of doc_id and text, then line. Defined results: rows of equal doc_id and
text are one document and share its result; null or empty texts stay as they are; other columns pass through,
but columns of the names n_lines and n_deleted are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def _key(df: DataFrame) -> DataFrame:
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))
    return df.withColumn("_key", F.unhex(F.md5(own)))


def lines(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, at, number, line_id, words) of every line with a word: at counts those from 0, number all lines."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("number"), x.alias("line")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(_WORD))
    each = _key(docs.select("doc_id", "text")).select("_key", "doc_id", F.posexplode(kept).alias("at", "x"))
    words = F.regexp_count("x.line", F.lit(_WORD))
    return each.select("_key", "doc_id", "at", "x.number", F.unhex(F.md5("x.line")).alias("line_id"), words.alias("words"))


def _ranked(suffixes: DataFrame, *by: str) -> DataFrame:
    """suffixes whose `by` others share, with its rank among all in sorted order and the first place of each."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_key", "at")
    shared = suffixes.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    ranks = materialise(shared.orderBy(*by).select(*by, "first", F.monotonically_increasing_id().alias("rank")))
    return suffixes.join(ranks, list(by))


def _ahead(k: int) -> dict[str, Column]:
    """The ranks k, 2 k and 3 k lines on, null where no other suffix has that rank or the block ends."""
    onward = Window.partitionBy("_key", "block").orderBy("at")
    return {f"rank{j}": F.first("rank").over(onward.rangeBetween(j * k, j * k)) for j in (1, 2, 3)}


def copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, number) of each line to delete."""
    start = _ranked(lines(docs), "line_id").select("_key", "doc_id", "at", "number", "words", "rank", "first")
    run = Window.partitionBy("_key").orderBy("at")
    block = Window.partitionBy("_key", "block")
    start = start.repartition("_key").dropDuplicates(["_key", "at"]).withColumn("block", F.col("at") - F.row_number().over(run))
    start = start.withColumn("till", F.sum("words").over(block.orderBy("at")))
    onward = block.orderBy(F.col("till") - F.col("words")).rangeBetween(0, min_words - 1)
    back = block.orderBy("till").rangeBetween(1 - min_words, 0)
    start = materialise(
        start.select(
            "_key", "doc_id", "at", "number", "block", "rank", "first",
            F.when(F.sum("words").over(onward) >= min_words, F.count("*").over(onward)).alias("onward"),
            F.when(F.sum("words").over(back) >= min_words, F.count("*").over(back)).alias("back"),
            *(c.alias(name) for name, c in _ahead(1).items()),
        )
    )
    windows = start.where("onward is not null").select("_key", "doc_id", "block", "at", F.col("onward").alias("n"))
    windows = windows.union(start.where("back is not null").select("_key", "doc_id", "block", F.expr("at - back + 1"), "back")).distinct()
    later = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_key", "at") > F.col("first")
    found = windows.where("n = 1").join(start.select("_key", "at", "first"), ["_key", "at"]).where(later).select("_key", "at", "n")

    longest = windows.agg(F.max("n")).first()[0] or 0
    level, k = start.select("_key", "doc_id", "block", "at", "rank", "rank1", "rank2", "rank3"), 1  # ranks of k lines
    while k < longest:
        mine = windows.where((F.col("n") > k) & (F.col("n") <= 4 * k))
        tail = level.select("_key", "block", F.col("at").alias("to"), F.col("rank").alias("tail"))
        pairs = mine.join(level.select("_key", "at", "rank", "rank1", "rank2"), ["_key", "at"])
        # runs of k lines at 0, k and 2 k, as far as they end before the window does, and at its end cover it
        inner = {f"rank{j}": F.when(F.col("n") > (j + 1) * k, F.col(f"rank{j}")).otherwise(-1) for j in (1, 2)}
        pairs = pairs.withColumns(inner).where("rank1 is not null and rank2 is not null")
        pairs = pairs.withColumn("to", F.col("at") + F.col("n") - k).join(tail, ["_key", "block", "to"])
        hits = _firsts(pairs, "n", "rank", "rank1", "rank2", "tail").where(later)
        found = found.union(materialise(hits.select("_key", "at", "n")))
        if 4 * k < longest:
            grown = _ranked(level.where("rank3 is not null").withColumnRenamed("rank", "rank0"), "rank0", "rank1", "rank2", "rank3")
            level = materialise(grown.select("_key", "doc_id", "block", "at", "rank").withColumns(_ahead(4 * k)))
        k *= 4
    gone = found.select("_key", F.explode(F.sequence("at", F.expr("at + cast(n as int) - 1"))).alias("at")).distinct()
    return gone.join(start.select("_key", "at", "number"), ["_key", "at"]).select("_key", "number")


def _firsts(windows: DataFrame, *by: str) -> DataFrame:
    """windows that others share, with the first place of each. The places are pre-aggregated and written, so that a hot
    run meets one row in a join that adaptive execution broadcasts or splits."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_key", "at")
    shared = windows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    return windows.join(materialise(shared.drop("last")), list(by))


def _without(lines: Column, runs: Column) -> Column:
    """lines without the runs (head, tail), which are in order: what is between them, end to end."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["tail"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["head"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of line runs cut from `text`, and columns n_lines (with a word) and n_deleted."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    near = Window.partitionBy("_key").orderBy("number")
    runs = copies(docs, min_words).withColumn("run", F.col("number") - F.row_number().over(near)).groupBy("_key", "run")
    runs = runs.agg(F.min("number").alias("head"), F.max("number").alias("tail"))
    gone = runs.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("head", "tail"))).alias("_gone"))
    # columns of docs travel in one struct, out of the way of the names used here
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "doc_id", "text")
    both = _key(held).drop("doc_id", "text").join(gone, "_key", "left").withColumn("text", F.col("row.text"))
    rest = F.array_join(F.element_at(F.transform(F.array(F.split("text", "\n")), lambda x: _without(x, F.col("_gone"))), 1), "\n")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(_WORD)))
    n_deleted = F.aggregate("_gone", F.lit(0), lambda n, r: n + r["tail"] - r["head"] + 1)
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest)
    return both.select(
        *(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_deleted, F.lit(0)).cast("long").alias("n_deleted"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, text, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS k FROM documents),
l AS (
  SELECT doc_id, k, number, line, row_number() OVER (PARTITION BY k ORDER BY number) AS p,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT DISTINCT doc_id, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number
        FROM d WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (SELECT *, sum(words) OVER (PARTITION BY k ORDER BY p) AS till FROM l),
w AS (
  SELECT *, count(*) OVER f AS nf, sum(words) OVER f AS wf, count(*) OVER b AS nb, sum(words) OVER b AS wb FROM t
  WINDOW f AS (PARTITION BY k ORDER BY till - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         b AS (PARTITION BY k ORDER BY till RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
whole AS (SELECT k, list(md5(line) ORDER BY p) AS ids FROM l GROUP BY k),
runs AS (
  SELECT DISTINCT doc_id, k, p, n FROM (
    SELECT doc_id, k, p, nf AS n FROM w WHERE wf >= 50 UNION ALL SELECT doc_id, k, p - nb + 1, nb FROM w WHERE wb >= 50)),
named AS (SELECT r.*, array_to_string(ids[p:p + n - 1], ',') AS run FROM runs r JOIN whole USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, k, p) AS r FROM named),
gone AS (SELECT DISTINCT k, unnest(range(p, p + n)) AS p FROM ranked WHERE r > 1),
kept AS (
  SELECT d.k, string_agg(x.line, chr(10) ORDER BY x.number) AS text, count(g.k) AS dropped
  FROM (SELECT DISTINCT k, text FROM d WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS number) x
  LEFT JOIN l ON l.k = d.k AND l.number = x.number LEFT JOIN gone g ON g.k = l.k AND g.p = l.p
  WHERE g.k IS NULL GROUP BY d.k),
n AS (SELECT k, count(*) AS n_lines FROM l GROUP BY k), m AS (SELECT k, count(*) AS n_deleted FROM gone GROUP BY k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM d LEFT JOIN kept USING (k) LEFT JOIN n USING (k) LEFT JOIN m USING (k)
"""
