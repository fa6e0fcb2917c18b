"""Operators against plain Python versions that take the contracts by their words."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

pytest.importorskip("millrace.llm")

from hypothesis import given, settings, strategies as st  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import bpe, linededup, lm, ngramjoin, tokencount, toxicity  # noqa: E402
from tests.llm.common import TEXTS, documents  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(spark, n=10_000):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


def brute_components(rows):
    """Component (least id) and number of shingles of each row."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in holders[x] if j < i)
        for j, c in met.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [(d, len(s), d if not s else low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_jaccard_components(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for k in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 30, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            base = edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04]))  # chains of edits
            rows.append((len(rows), " ".join(base)))
        rows.append((len(rows), " ".join(passage + rng.choices(vocabulary, k=rng.choice([2, 10, 15, 100])))))
    rows += [(i + 1000, t) for i, (_, t) in enumerate(rows[:20])] + [(None, rows[3][1]), (7, rows[8][1])]
    got = ngramjoin.near_duplicates(documents(spark, rows), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows))


def true_links(rows):
    """All pairs of row numbers with different sets that link."""
    sets = [w and frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (WORD.findall((t or "").translate(LOWER)) for _, t in rows)]
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and a != b and 100 * len(a & b) >= 80 * len(a | b)}


def overlapping(rng):
    """Texts out of a few passages and own words, so that shingles are shared in and outside of signatures."""
    passages = [[f"p{k}x{i}" for i in range(rng.choice([20, 40, 80]))] for k in range(4)]
    texts = []
    for k in range(40):
        parts = [rng.choice(passages) for _ in range(rng.choice([1, 1, 2]))]
        own = [f"o{k}x{i}" for i in range(rng.choice([0, 1, 2, 5, 9]))]
        texts.append(" ".join(sum(parts, []) + own if k % 2 else own + sum(parts, [])))
    return texts


@pytest.mark.parametrize("seed", [5])
def test_jaccard_loses_no_link_of_overlapping_texts(spark, seed):
    rows = list(enumerate(overlapping(random.Random(seed))))
    got = {r.doc_id: r.component_id for r in ngramjoin.near_duplicates(documents(spark, rows), keep=["doc_id"]).collect()}
    links = true_links(rows)
    assert links and all(got[i] == got[j] for i, j in links)
    assert sorted(got.items()) == [(d, c) for d, _, c in brute_components(rows)]


@given(st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_linked_sets_meet_in_their_signatures(rng):
    """Two linked sets share as many signature shingles as the depth of the smaller, under any order."""
    import numpy as np

    classes = np.array([rng.randrange(3) for _ in range(64)], np.uint8).repeat(ngramjoin.SKETCH // 64)
    whole = np.array(sorted({rng.randrange(1 << 64) for _ in range(rng.choice([4, 9, 30, 150]))}), np.uint64)
    pick = lambda: whole[np.array([rng.random() > 0.08 for _ in whole])]
    a, b = pick(), pick()
    common = len(np.intersect1d(a, b))
    if len(a) and len(b) and not np.array_equal(a, b) and 100 * common >= 80 * (len(a) + len(b) - common):
        few = min(len(a), len(b))
        depth = min(-(-80 * few // 100), max(ngramjoin.LEAST_DEPTH, few // ngramjoin.DEPTH_SHARE))
        assert len(np.intersect1d(*(ngramjoin.signature(s, classes, 80) for s in (a, b)))) >= depth


@pytest.mark.parametrize("n", [40, 120])
def test_jaccard_of_one_large_group(spark, n):
    rng = random.Random(n)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.015))) for i in range(n)]
    got = ngramjoin.near_duplicates(documents(spark, rows), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows))


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, 500 + i) for i in range(1, 30)]
    up = {v: v for e in edges for v in e}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in ngramjoin.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: root(v) for e in edges for v in e if e[0] != e[1]}


def brute_lm(rows):
    """Base and model score of each row, with weights learnt as the operator says."""
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7
    counts = {side: (Counter(), Counter()) for side in ("kept", "tuning")}
    for d, t in rows:
        if fold(d) != 2:
            w = tokens(t)
            one, two = counts["tuning" if fold(d) == 3 else "kept"]
            one.update(w)
            two.update(zip(["\n", *w], w))
    bucket = lambda c: int(math.log2(c)) + 1 if c else 0
    one, two = counts["kept"]
    n, v, events = sum(one.values()), len(one), Counter()
    for d, t in rows:
        if fold(d) == 3:
            w = tokens(t)
            for h, x in zip(["\n", *w], w):
                events[bucket(one[h]), (two[h, x] / one[h] if one[h] else 0.0), one[x] / max(1, n)] += 1
    weights = {b: ((0.6, 0.3, 0.1) if b else (0.0, 0.9, 0.1)) for b, _, _ in events}
    for _ in range(25):
        sums = defaultdict(lambda: [0.0, 0.0, 0.0, 0])
        for (b, p2, p1), k in events.items():
            parts = [x * p for x, p in zip(weights[b], (p2, p1, 1 / (v + 1)))]
            for i, p in enumerate(parts):
                sums[b][i] += k * p / sum(parts)
            sums[b][3] += k
        new = {b: tuple(s[i] / s[3] for i in range(3)) for b, s in sums.items()}
        moved = max((abs(x - y) for b in new for x, y in zip(new[b], weights[b])), default=0)
        weights = new
        if moved < 1e-4:
            break
    one, two = (counts["kept"][k] + counts["tuning"][k] for k in (0, 1))
    n, v = sum(one.values()), len(one)
    shares, last = {}, (0.0, 0.9, 0.1)
    for b in range(70):
        last = shares[b] = weights.get(b, last if b != 1 else (0.6, 0.3, 0.1))
    out = []
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(sum(a * p for a, p in zip(shares[bucket(one[h])], (two[h, x] / max(1, one[h]), one[x] / max(1, n), 1 / (v + 1))))) for h, x in zip(["\n", *w], w))
        out.append((d, fold(d) == 2, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def test_lm_scores(spark):
    rows = texts_of(spark)
    want = {r[0]: r for r in brute_lm(rows)}
    for r in lm.score(documents(spark, rows)).collect():
        d, held, n, known, train, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)


def test_lm_scores_by_two_levels(spark, monkeypatch):
    """Small batches and buckets, so that there are many of both: two levels give what one does, with far fewer rows."""
    rows = texts_of(spark)
    monkeypatch.setattr(lm, "BATCH_BYTES", 6_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 8_000)
    got, sent = [], []
    for wide in (10**6, 4):
        monkeypatch.setattr(lm, "WIDE", wide)
        got.append({tuple(r) for r in lm.score(documents(spark, rows)).collect()})
        packs = lm.packed(documents(spark, rows))
        spread = lm.Spread.of(150)
        asked = lm._cells(lm._ask(packs, spread), packs.count() // 2, spread)
        sent.append(asked.count() + (lm._merged(asked, spread).count() if spread.width > 1 else 0))
    rounded = [{(*r[:4], round(r[4], 6), round(r[5], 6), r[6]) for r in g} for g in got]
    assert rounded[0] == rounded[1] and len(got[0]) == len(rows)
    assert sent[1] < sent[0] / 3, sent


def test_lm_beats_its_base_on_held_out_text(spark):
    p = {r.held_out: r for r in lm.perplexity(lm.score(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    assert p[True].model < p[True].base and p[False].model < p[True].model


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_follows_the_library(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts_of(spark) + TEXTS)]
    rows += [(9000 + i, t) for i, t in enumerate(["<|endoftext|>x<|startoftext|>", "İSTANBUL ΣΑΣ ﬁ", "e\u0301te\u0301", "don't it'll 1st 22nd", "\u00a0\u3000\u200b", "\x00\x07"])]
    t = library()
    for r in bpe.digests(documents(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r.bpe.n_tokens == len(ids), text[:60]
        assert r.bpe.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.bpe.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=40))
def test_bpe_of_any_text(text):
    import public_tokenizers

    if not hasattr(test_bpe_of_any_text, "pair"):
        test_bpe_of_any_text.pair = bpe.Encoder(bpe.load(public_tokenizers.path("word_bpe_49k.json"))), library()
    own, lib = test_bpe_of_any_text.pair
    assert [i for w in own.text(text.encode("utf-8", "replace")) for i in w[0]] == lib.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def test_bpe_of_every_code_point():
    import public_tokenizers

    own, lib = bpe.Encoder(bpe.load(public_tokenizers.path("word_bpe_49k.json"))), library()
    texts = [f"a{c}{c}1{c}." for c in map(chr, range(0x110000)) if not c.encode("utf-8", "ignore") == b""]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        for text, found in zip(part, lib.encode_batch(part, add_special_tokens=False), strict=True):
            assert [i for w in own.text(text.encode()) for i in w[0]] == found.ids, hex(ord(text[1]))
        own.chunks.clear()
        own.cached.clear()


@given(st.lists(st.integers(0, 3), min_size=1, max_size=90))
@settings(max_examples=300, deadline=None)
def test_heap_merges_as_scans_do(parts):
    merged = list(range(4, 12))
    ranks = {(a, b): k for k, (a, b) in enumerate([(0, 1), (4, 0), (1, 1), (2, 3), (5, 6), (4, 4), (3, 3), (7, 10)])}
    assert bpe.merge_short(list(parts), ranks, merged) == bpe.merge_long(list(parts), ranks, merged)


def test_token_counts(spark):
    scores = tokencount.load()
    unknown = min(scores.values()) - 10

    def best(word):
        found = [(0.0, 0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(found[a][0] + scores[word[a:end]], found[a][1] - 1, found[a][2]) for a in range(end) if word[a:end] in scores]
            if word[end - 1] not in scores:
                options.append((found[end - 1][0] + unknown, found[end - 1][1] - size, found[end - 1][2] + size))
            found[end] = max(options, key=lambda o: o[:2])
        return -found[-1][1], found[-1][2]

    rows = [(i, t[:3000]) for i, (_, t) in enumerate(texts_of(spark, 60))] + [(900, "日本 😀 zzzzqqq " + "ab" * 60)]
    cache = {}
    for r in tokencount.token_counts(documents(spark, rows)).collect():
        words = WORD.findall(dict(rows)[r.doc_id])
        each = [cache.setdefault(w, best("▁" + w)) for w in words]
        assert (r.counts.n_words, r.counts.n_tokens, r.counts.n_bytes_fallback) == (len(words), sum(e[0] for e in each), sum(e[1] for e in each))


EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
YOURS = "you your yours yourself u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes vosotros tus vuestro".split()
READ = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": ""}


def plain_stem(word):
    if len(word) < 5:
        return ""
    ends = [e for e in "ings ing ed ly ern er en es est as os a e n o s t".split() if word.endswith(e) and len(word) - len(e) >= 4]
    return word[: -max(map(len, ends))] if ends else word


def plain_features(text, words, stems):
    tokens = [w.strip(EDGE) for w in text.lower().split()]
    n, raw = max(1, len(tokens)), text.encode()
    letters = max(1, len([b for b in raw if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0]))
    a, b = [i for i, w in enumerate(tokens) if w in words], [i for i, w in enumerate(tokens) if plain_stem(w) in stems]
    you = [i for i, w in enumerate(tokens) if w in YOURS]
    near = sum(any(abs(i - j) <= 6 for j in you) for i in {*a, *b})
    mixed = [m.decode("utf-8", "replace").lower() for m in re.findall(rb"[A-Za-z\x80-\xff]+(?:[0-9@$*!|.\-]+[A-Za-z\x80-\xff]+)+", raw)]
    mixed = ["".join(READ.get(c, c) for c in m).strip(EDGE) for m in mixed]
    read = sum(m in words or plain_stem(m) in stems for m in mixed)
    marks = sum(chr(b) in EDGE + "+=@\\^`~" for b in raw)
    return [len(a), len(a) / n, len(b), len(b) / n, near / n, len(you) / n, sum(0x41 <= b <= 0x5A for b in raw) / letters, text.count("!!") / n,
            text.count("!") / max(1, len(raw)), text.count("?") / max(1, len(raw)), marks / max(1, len(raw)), len(mixed) / n, read, math.log1p(len(tokens))]


def plain_lexicon(rows):
    """Words and stems of (text, toxic)."""
    texts = {(y, tuple(dict.fromkeys(w.strip(EDGE) for w in re.split("[ \t\n\x0b\f\r]+", t.lower())))) for t, y in rows}
    total = Counter(y for y, _ in texts)
    out = []
    for of in (lambda w: w, plain_stem):
        counts = {y: Counter(e for k, ws in texts if k == y for e in {of(w) for w in ws} if len(e) >= 3) for y in (0, 1)}
        odds = lambda e: math.log((counts[1][e] + 0.5) / (total[1] + 1)) - math.log((counts[0][e] + 0.5) / (total[0] + 1))
        out.append({e for e, n in counts[1].items() if n >= 3 and odds(e) >= math.log(20)})
    return out


def tree_of(lines):
    """A tree out of the lines of its printed form, as a function of the features."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return lambda x, v=float(line.split()[1]): v
    at, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = tree_of(lines)
    lines.pop(0)
    no = tree_of(lines)
    return lambda x: (yes if x[int(at)] <= float(bound) else no)(x)


def test_toxicity_by_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.Model(docs, labels)
    learnt = toxicity.training_rows(docs, labels).collect()
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    assert {r.doc_id for r in learnt} == {d for d in marks if zlib.crc32(str(d).encode()) % 4 != 2} and all(marks[r.doc_id] == r.toxic for r in learnt)
    words, stems = plain_lexicon([(r.text, r.toxic) for r in learnt])
    assert (model.lexicon[0], model.lexicon[1]) == (words, stems) and words
    trees = []
    for tree in model.trees.trees:
        trees.append(tree_of(tree.toDebugString.split("\n")[1:]))
    bounds, levels = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    import numpy as np

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in model.score(docs, ["doc_id"]).collect():
        x = plain_features(texts[r.doc_id], words, stems)
        margin = sum(w * t(x) for w, t in zip(model.trees.treeWeights, trees, strict=True))
        p = 1 / (1 + math.exp(-2 * margin))
        assert r.toxic_score == pytest.approx(min(1, max(0, np.interp(p, bounds, levels))), abs=1e-9), r.doc_id


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in toxicity.op7_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert area > 0.95, area


def contaminated(texts, items):
    """Ids of the texts of which a twentieth or more is hit."""
    windows = set()
    for t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    out = set()
    for d, t in texts:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit = set()
        for n in {len(x) for x in windows}:
            hit |= {j for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.toxic_score for r in toxicity.Model(docs, labels).score(docs, ["doc_id"]).collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        was, now = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        if name != "bpe":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "toxicity":
            assert set(now) == {d for d, s in scores.items() if s < 0.3}
        elif name == "line_dedup":
            assert set(now) == set(was) and all(r.n_chars == len(r.text) for r in now.values() if r.text != was[r.doc_id])
            db = duckdb.connect()
            db.register("documents", before.select("doc_id", "text").toPandas())
            want = {r[0]: r[1] for r in db.sql(linededup.OP3_SQL).project("doc_id, text").fetchall()}
            assert {d: r.text for d, r in now.items()} == want and want != was
        elif name == "ngram_jaccard_join":
            assert set(now) == {d for d, n, c in brute_components(list(was.items())) if n == 0 or d == c}
        elif name == "decontamination":
            assert set(now) == set(was) - contaminated(was.items(), items)
        else:
            t = library()
            assert {d: r.n_tokens for d, r in now.items()} == {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in was.items()}
        before = after


@given(st.text("aé1@.- x", max_size=40))
@settings(max_examples=500, deadline=None)
def test_mixed_words_are_the_longest_ones(text):
    """The pattern that reads a text once finds what the plain one does."""
    plain = re.compile(rb"[A-Za-z\x80-\xff]+(?:[0-9@$*!|.\-]+[A-Za-z\x80-\xff]+)+")
    assert toxicity._MIXED.findall(text.encode()) == plain.findall(text.encode())


@pytest.mark.parametrize("word", ["x" * 1_000_000, "x1" * 500_000, "1" * 1_000_000, "x" * 500_000 + "." * 500_000, "é!" * 300_000, "a b " * 250_000])
def test_toxic_features_of_a_word_of_a_megabyte(word):
    start = time.process_time()
    assert len(toxicity.features(word.encode(), toxicity.Kinds(frozenset(["x"]), frozenset()))) == len(toxicity.FEATURES)
    assert time.process_time() - start < 2


def test_shared_sizes_of_a_shingle_that_all_sets_hold(spark, monkeypatch):
    """Against plain counts, with packs of a few sets; a hot shingle is sent once a pack."""
    monkeypatch.setattr(ngramjoin, "PACK_POSTINGS", 60)
    rng = random.Random(6)
    sets = {k * 7919 - 50_000: sorted({5, *(rng.randrange(1 << 40) if rng.random() < 0.6 else (rng.randrange(40) << 58) - (1 << 63) for _ in range(rng.randint(0, 30)))}) for k in range(200)}
    df = spark.createDataFrame([(n, s) for n, s in sets.items()], "node bigint, shingles array<bigint>").repartition(4)
    holders = Counter(x for s in sets.values() for x in s)
    want = {n: e for n, s in sets.items() if (e := sum(holders[x] > 1 for x in s))}
    assert {r.node: r.e for r in ngramjoin.shared_sizes(df, 13).collect()} == want


def test_line_dedup_of_windows_of_all_lengths(spark, monkeypatch):
    """Runs of 1 to 50 lines that reach 50 words, whole and with a line changed, against the SQL; two doublings a round."""
    rng, docs = random.Random(5), []
    for m in range(1, 51):
        run = [" ".join(f"w{m}x{j}" for _ in range(-(-50 // m))) for j in range(m)]
        changed = [*run]
        changed[rng.randrange(m)] = "another line"
        docs += ["\n".join([f"before {m}", *run, "after"]), "\n".join([*run, f"end {m}"]), "\n".join(["x", *changed, "y"])]
    docs += ["\n".join(rng.choice(["a", "b b", "c c c c c c c", "d " * 20]) for _ in range(rng.randrange(90))) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    written, real = [], linededup.materialise
    monkeypatch.setattr(linededup, "materialise", lambda df: written.append(1) or real(df))
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == {r[0]: tuple(r[1:]) for r in db.sql(linededup.OP3_SQL).fetchall()}
    assert sum(n for _, _, n in got.values()) > 1000 and len(written) <= 12  # 24 with a round for each doubling


def test_connected_of_a_star_takes_one_round(spark, monkeypatch):
    written, real = [], ngramjoin.measured
    monkeypatch.setattr(ngramjoin, "measured", lambda df, **values: written.append(1) or real(df, **values))
    found = {r.node: r.root for r in ngramjoin.connected(spark.createDataFrame([(1, k) for k in range(1, 9)], "a long, b long")).collect()}
    assert found == dict.fromkeys(range(1, 9), 1) and len(written) == 2
    assert ngramjoin.connected(spark.createDataFrame([], "a long, b long")).count() == 0 and len(written) == 4
