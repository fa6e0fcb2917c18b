"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import conversationtrie as trie  # noqa: E402

KIND = "conv_id bigint, turn bigint, role string, text string, path string, rank string"


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + f"{len(text):08X}"


def brute_sequences(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, key(role, text), (role or "", text or "")))
    return {c: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in by.items()}


def brute_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = head[:h] + turns[h:]
    return out


def brute_nodes(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def sums(p):
        leaves, saved = 0, (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for q in children.get(p, []):
            a, b = sums(q)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(sequences[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if sequences:
        sums(())
    return sorted(out, key=str)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(rng, n_convs, texts, longest):
    rows = []
    for c in rng.sample(range(-40, 5 * n_convs), n_convs):
        rows += [(c, t, rng.choice("ua"), rng.choice(texts)) for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize(("seed", "n_convs", "texts", "longest"), [(1, 60, ["a", "bb", ""], 7), (2, 200, ["x"], 9), (3, 120, [str(i) for i in range(50)], 4), (4, 1, ["a"], 3), (5, 40, ["p", "qq"], 60)])
def test_trie_by_brute_force(spark, seed, n_convs, texts, longest):
    """Few and many ranges: points that lie in several ranges, whole ranges below one point."""
    rng = random.Random(seed)
    rows = made(rng, n_convs, texts, longest)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], KIND).repartition(4)
    own = brute_sequences(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert found(trie.prefix_trie(trie.rebuilt(trie.turn_sequences(df)))) == brute_nodes(brute_rebuilt(own))
            if n == "8":
                assert found(trie.prefix_trie(trie.turn_sequences(df))) == brute_nodes(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", range(60))
def test_ranges_by_brute_force(seed):
    """The stack passes alone, in one process: paths cut into ranges at random places, with empty paths and prefixes of paths."""
    rng = random.Random(seed)
    digits = [f"{i:040d}" for i in range(rng.randint(1, 4))]
    paths = sorted({"".join(rng.choice(digits) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 40))})
    cuts = sorted(rng.sample(range(len(paths) + 1), min(len(paths) + 1, rng.randint(0, 9))))
    ranges = [x for a, b in zip([0, *cuts], [*cuts, len(paths)], strict=True) if (x := paths[a:b])]
    shares = []
    for k, own in enumerate(ranges):
        of = trie.Range(shares.append)
        if k:
            of.before(ranges[k - 1][-1])
        for path in own:
            of.row(path, paths.index(path), 1, paths.index(path))
        of.after(ranges[k + 1][0] if k + 1 < len(ranges) else None)
    got = {}
    for id, depth, first, last, n, least, leaves, real, *_ in shares:
        a = got.get((id, depth), (10**9, -1, 0, 10**9, 0, False))
        got[id, depth] = (min(a[0], first), max(a[1], last), a[2] + n, min(a[3], least), a[4] + leaves, a[5] or real)
    prefixes = {p[: 40 * d] for p in paths for d in range(len(p) // 40 + 1)}
    want = {}
    for p in prefixes:
        under = [i for i, q in enumerate(paths) if q.startswith(p)]
        children = {q[: len(p) + 40] for q in paths if q.startswith(p) and q != p}
        leaf = sum(not any(q != r and r.startswith(q) for r in paths) for q in (paths[i] for i in under))
        if not p or p in paths or len(children) > 1:
            want[trie.node_id(p), len(p) // 40] = (under[0], under[-1], len(under), under[0], leaf, True)
    assert {k: v for k, v in got.items() if v[5]} == want


def test_edges(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "a", "x"), (2, 5, "u", None), (None, 1, "u", "lost"), (100, 0, "", "😀 two"), (163, 0, "u", "hi"), (-5, 1, "u", "x")]
    rows += [(c, t, "u", "same") for c in range(500, 900) for t in range(3)]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], KIND)
    assert found(trie.prefix_trie(trie.rebuilt(trie.turn_sequences(df)))) == brute_nodes(brute_rebuilt(brute_sequences(rows)))
    assert found(trie.prefix_trie(trie.turn_sequences(df.limit(0)))) == []
    df.limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op13_conversation_trie(spark, str(tmp_path)).count() == 0


def test_long_lists_of_ends(spark, monkeypatch):
    """A list of ends over many blocks and ranges is hashed in order."""
    monkeypatch.setattr(trie, "BLOCK", 50)
    paths = spark.range(3000).selectExpr("id as conv_id", "if(id % 3 = 0, 'a', concat('b', id % 7)) as path").repartition(6)
    got = {r.id: r.ends_sha256 for r in trie.ends_by_node(paths).collect()}
    lists = {}
    for c in range(3000):
        lists.setdefault("a" if c % 3 == 0 else f"b{c % 7}", []).append(str(c))
    assert got == {trie.node_id(p): hashlib.sha256(",".join(x).encode()).hexdigest() for p, x in lists.items()}
