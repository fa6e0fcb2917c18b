"""The discriminant against numpy on dense matrices, on held-out labels, and on odd texts."""

import zlib

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import discriminant  # noqa: E402
from tests.llm.common import CLASHING, TEXTS, messy  # noqa: E402


def plain_log_odds(x, y, at, shrink, ridge):
    """Log posterior differences by determinants and inverses of whole covariances, divided by the number of statistics."""
    scale = x.std(0)
    scale[scale <= 1e-9] = 1
    x, at = x / scale, at / scale
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    share = [np.mean(y == k) for k in (0, 1)]
    pooled = share[0] * own[0] + share[1] * own[1]
    logs = []
    for k in (0, 1):
        s = (1 - shrink) * own[k] + shrink * pooled
        s = (1 - ridge) * s + ridge * np.trace(s) / len(s) * np.eye(len(s))
        d = at - x[y == k].mean(0)
        logs.append(np.log(share[k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    return (logs[1] - logs[0]) / x.shape[1]


def test_scores_by_dense_matrices(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in discriminant.op12_quality_classifier(spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    own = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    x, y = np.array([discriminant.statistics(texts[d]) for d in own]), np.array([*own.values()])
    want = plain_log_odds(x, y, np.array([discriminant.statistics(t) for t in texts.values()]), discriminant.SHRINK, discriminant.RIDGE)
    assert len(got) == len(texts)
    for d, w in zip(texts, want, strict=True):
        r = got[d]
        assert abs(r.score - 1 / (1 + np.exp(-w))) < 1e-6 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_statistics_by_hand():
    names = dict(zip(discriminant.STATISTICS, discriminant.statistics(b"AB AB | c### d!!\nx 12\nx 12"), strict=True))
    odds = lambda share: np.log((share + 0.02) / (1 - share + 0.02))
    n = 9 + 12
    assert names["bare_words"] == pytest.approx(odds(1 / n)) and names["repeated_words"] == pytest.approx(odds(1 / n))
    assert names["symbol_ends"] == pytest.approx(odds(1 / n)) and names["shouted"] == pytest.approx(odds(1 / n)) and names["junk_words"] == pytest.approx(odds(4 / n))
    assert names["capitals"] == pytest.approx(odds(4 / (8 + 60))) and names["symbols"] == pytest.approx(odds(4 / n)) and names["digits"] == pytest.approx(odds(4 / (18 + 60)))
    assert names["different_words"] == pytest.approx(odds((6 + 12) / n)) and names["repeated_lines"] == pytest.approx(odds(1 / 6)) and names["log_words"] == pytest.approx(np.log(10))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = discriminant.op12_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 80
    assert sum(r.predicted for r in good) >= 0.99 * len(good) and sum(r.predicted for r in bad) <= 0.05 * len(bad)
    below = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad)
    assert below >= 0.99 * len(good) * len(bad)


def test_edges(spark):
    labels = spark.createDataFrame([(d, d % 2) for d in (1, 3, 5, 7, 8, 9, 10, 11)] + [(None, 1), (5, None), (7, 0)], "doc_id bigint, quality int")
    docs = messy(spark)
    for own in (labels, labels.limit(0), labels.where("quality = 1")):
        out = discriminant.Model(discriminant.with_statistics(docs, ["doc_id"]), own).score(discriminant.with_statistics(docs)).cache()
        assert out.count() == len(TEXTS) and out.where("quality_score between 0 and 1").count() == len(TEXTS)
        for c in CLASHING:
            assert {r[0] for r in out.select(f"`{c}`").collect()} == {"own"}, c
        one = {r.doc_id: r.quality_score for r in out.collect()}
        assert one[2] == one[3] == one[4]
    assert discriminant.keep_good(docs.limit(0), labels).count() == 0
    kept = discriminant.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(TEXTS)


def test_long_texts_take_linear_time():
    import time

    for text in (b"x" * 4_000_000, b"| " * 1_000_000, b"\n" * 4_000_000, b"!" * 4_000_000):
        start = time.process_time()
        assert all(map(np.isfinite, discriminant.statistics(text)))
        assert time.process_time() - start < 5
