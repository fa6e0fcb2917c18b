"""Quality rules as a bitmask ledger.

One Arrow pass measures every text; rules are plain Spark expressions over the measurements, and each sets one bit
of `failure_bits`. Measurements and bits are the ledger: policies are versioned bit masks, so a new policy or an
ablation is a bitwise expression over the ledger and never reads a text again. Nothing is shuffled but the few
rows of an ablation report.

Defined results: a null text has no words (and fails the base rules); measures of an empty text are 0 and no ratio
rule fires on it; repeated rows get a row each; other columns pass through, and a column that has the name of a
ledger column is replaced by it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, with_column_from_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts")
_NOT_COUNTED = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])  # UTF-8 continuation bytes and white space
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_NOT_LETTERS = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)


def _c(name: str) -> Column:
    return F.col(f"ledger.{name}")


def rules() -> list[tuple[str, Column]]:
    """Names and failure conditions, in the order of their bits."""
    return [
        ("too_few_words", _c("n_words") < 50),
        ("repeated_windows", 100 * _c("n_repeat_words") > 50 * _c("n_words")),
        ("symbols_to_words", 4 * _c("n_symbols") > _c("n_words")),
        ("mean_word_short", _c("word_chars") < 2 * _c("n_words")),
        ("mean_word_long", _c("word_chars") > 20 * _c("n_words")),
        ("duplicate_lines", (_c("n_lines") >= 4) & (100 * _c("n_dup_lines") > 50 * _c("n_lines"))),
        ("capitals", (_c("n_letters") >= 100) & (100 * _c("n_upper") > 60 * _c("n_letters"))),
        ("shouting", (_c("n_words") >= 20) & (100 * _c("n_shouts") > 30 * _c("n_words"))),
    ]


#: Policy versions: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_to_words", "mean_word_short", "mean_word_long", "duplicate_lines", "capitals", "shouting"),
}


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        twice = np.fromiter((count[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text.translate(None, _NOT_UPPER)),
        len(text.translate(None, _NOT_LETTERS)),
        text.count(b"!!"),
    )


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `ledger` of the measurements."""
    kind = f"struct<{','.join(f'{m}:bigint' for m in MEASURES)}>"

    def values(texts: list[bytes], _) -> pa.Array:
        columns = zip(*map(measure, texts), strict=True)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return with_column_from_text(docs, "ledger", kind, values, keep=keep)


def failure_bits() -> Column:
    """Bit k is set if rule k fails."""
    out = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(rules()):
        out = out.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with `ledger` (the measurements) and `failure_bits`."""
    return measured(docs, keep).withColumn("failure_bits", failure_bits())


def mask(policy: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def rejected(policy: str, bits: Column | str = "failure_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(ledgered: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    One aggregation to a row for each pattern of bits (at most 2^rules), then bitwise sums over the patterns."""
    names = [name for name, _ in rules()]
    whole = mask(policy)
    patterns = ledgered.groupBy(F.col("failure_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).count()
    each_rule = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]))
    each = patterns.select("bits", "count", F.inline(each_rule))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))
    return each.groupBy("rule").agg(
        total(fails).alias("n_failed"), total(fails & (rest == 0)).alias("n_failed_alone"), total(rest == 0).alias("n_kept_without")
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return docs.select(
        "doc_id",
        *(f"ledger.{m}" for m in MEASURES[:5]),
        rejected("base").alias("base_failed"),
        (~rejected("v1")).alias("kept"),
        "failure_bits",
        F.lit("v1").alias("policy"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY k),
l AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(regexp_extract_all(text, '!!')) AS n_shouts
  FROM w LEFT JOIN l USING (k) LEFT JOIN rep USING (k)),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
    + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT
    + 32 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT
    + 64 * (n_letters >= 100 AND 100 * n_upper > 60 * n_letters)::INT
    + 128 * (n_words >= 20 AND 100 * n_shouts > 30 * n_words)::INT AS BIGINT) AS failure_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failure_bits = 0 AS kept, failure_bits, 'v1' AS policy
FROM b
"""
