"""Vector codes against plain Python: trees, rounds, errors, nulls, ties and lengths."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import vectorcode  # noqa: E402

KIND = "vec_id bigint, embedding array<double>, label int, coded string, place string, n string"


def nearest(entries, part):
    found = [(sum((a - b) ** 2 for a, b in zip(e, part, strict=True)), k) for k, e in enumerate(entries)]
    return min(found)


@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 3), min_size=1, max_size=40), st.lists(st.tuples(*[st.integers(-8, 8)] * 3), min_size=1, max_size=30))
@settings(max_examples=300, deadline=None)
def test_trees_find_the_nearest_of_many_ties(entries, parts):
    for leaf in (1, 4, 12):
        index, d = vectorcode.Tree(np.array(entries, np.int64), leaf).nearest(np.array(parts, np.int64))
        assert [*zip(d.tolist(), index.tolist(), strict=True)] == [nearest(entries, p) for p in parts]


def test_trees_of_large_integers():
    rng = np.random.default_rng(3)
    entries = rng.integers(-(1 << 26), 1 << 26, (64, 4))
    entries[40:] = entries[:24] + rng.integers(-1, 2, (24, 4))  # near ties of large distances
    parts = np.concatenate([rng.integers(-(1 << 26), 1 << 26, (200, 4)), (entries[:24] + entries[40:]) // 2])
    index, d = vectorcode.Tree(entries, 2).nearest(parts)
    assert [*zip(d.tolist(), index.tolist(), strict=True)] == [nearest(entries.tolist(), p) for p in parts.tolist()]


def brute(rows, parts, entries, rounds):
    """code and error of each kept row, in the order of rows (None if left out), and the entries."""
    whole = lambda x: x is not None and len(x) > 0 and len(x) % parts == 0 and all(v is not None and math.isfinite(v) for v in x)
    ints = lambda x: [max(-(1 << 26), min(1 << 26, math.floor(256 * v))) for v in x]
    by_id = {}
    for i, x, *_ in rows:
        if i is not None and whole(x):
            by_id[i] = min(by_id.get(i, ints(x)), ints(x))
    length = len(by_id[min(by_id)])
    seeds = [by_id[i] for i in sorted(i for i in by_id if len(by_id[i]) == length)[:entries]]
    w = length // parts
    cut = lambda x: [x[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(s)[p] for s in seeds] for p in range(parts)]
    held = [cut(ints(x)) if whole(x) and len(x) == length else None for _, x, *_ in rows]
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in held:
                if x:
                    own.setdefault(nearest(books[p], x[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = []
    for x in held:
        found = x and [nearest(books[p], x[p]) for p in range(parts)]
        out.append(found and ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def messy(rng, n=300):
    rows = [(i, [round(v, 3) for v in rng.normal(0, 0.2, 8).tolist()], int(rng.integers(3)) or None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.1] * 7 + [None], 1), (n + 3, [0.1] * 7 + [math.nan], 1), (n + 4, [math.inf] * 8, 1)]
    rows += [(n + 5, [0.5] * 4, 1), (n + 6, [0.5] * 7, 1), (n + 7, [1e300, -1e300] * 4, 2), (None, [0.25] * 8, 2), (3, [-0.9] * 8, 1), (7, rows[7][1], 2), (7, rows[7][1], 2)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 2), (2, 256, 1), (8, 5, 3)])
def test_codes_by_brute_force(spark, parts, entries, rounds):
    rows = messy(np.random.default_rng(parts))
    df = spark.createDataFrame([(*r, "own", "own", "own") for r in rows], KIND).repartition(5)
    want, books = brute(rows, parts, entries, rounds)
    out, made = vectorcode.compress(df, parts, entries, rounds)
    assert made.entries.tolist() == books
    assert made.sha256() == hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()
    got = sorted(((r.vec_id, r.coded.code, r.coded.error) for r in out.collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True) if w), key=str)
    assert {(r.place, r.n) for r in out.select("place", "n").collect()} == {("own", "own")}
    back = out.select("coded.code", vectorcode.decoded(F.col("coded.code"), made).alias("x")).first()
    at = [int(back.code[i : i + 2], 16) for i in range(0, len(back.code), 2)]
    assert back.x == [(v + 0.5) / 256 for p, k in enumerate(at) for v in books[p][k]]


def test_query_on_messy_rows(spark, tmp_path):
    """Labels with nulls, floats, further columns; against the SQL."""
    from tests.parity import connect, difference

    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(0, 0.2, 32).tolist(), int(i % 4) or None, "x") for i in range(200)]
    rows += [(200, None, 1, "x"), (201, [0.0] * 31 + [None], 1, "x"), (202, [math.nan] * 32, None, "x"), (None, [0.5] * 32, None, "x"), (5, [0.1] * 32, 2, "x"), (203, [0.1] * 16, 2, "x")]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, error string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert difference(vectorcode.op11_vector_codes(spark, str(tmp_path)), connect(str(tmp_path)).sql(vectorcode.OP11_SQL)) is None


def test_empty_and_useless_tables(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1), (2, [math.nan] * 16, 1), (None, [0.5] * 16, 1)], "vec_id bigint, embedding array<float>, label int")
    out, books = vectorcode.compress(none)
    assert books is None and out.count() == 0
    none.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vectorcode.op11_vector_codes(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
