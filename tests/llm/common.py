"""Rows that try every operator: nulls, empty and long texts, ties, repeats, clashing names."""

CLASHING = "hits ledger failure_bits bpe counts near row node root rank key _key _gone component_node at number n_lines n_deleted x features label part place lowest fold size".split()

TEXTS = [
    (1, "One line of words.\n" * 3 + "and the end"),
    (2, None),
    (3, ""),
    (4, " \n\t\n "),
    (None, "a text without an id " * 20),
    (5, "same text same text again " * 12),
    (6, "same text same text again " * 12),
    (6, "same text same text again " * 12),
    (7, "Ünïcödé wörds — 日本語 😀 #tags & <b>x</b> " * 30),
    (8, "long " * 40_000),
    (9, "x" * 60_000),
    (10, "\n".join(f"line number {i} of a long text with some words" for i in range(300))),
    (11, "\n".join(f"line number {i} of a long text with some words" for i in range(300))),
]


def messy(spark, texts=TEXTS):
    """documents with further columns whose names operators use themselves."""
    rows = [(d, t, "en", "s", None if t is None else len(t), *["own"] * len(CLASHING)) for d, t in texts]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
