"""BPE encoding and decoding with a contiguous rank array.

A short word is a list of parts and a parallel list with the rank of each adjacent pair. The least rank is sought by a
scan from the left, its boundary is deleted, and the ranks of the two neighbouring pairs are refreshed, until no pair
has a rank. Words above SHORT bytes keep the same order of merges with a heap, as scans would be quadratic there.
Words repeat, so each task keeps the tokens of the chunks that it has seen, up to CACHE.

The vocabulary is a public tokenizer file of fixed size, checked before it is broadcast. Texts are encoded where they
are read; nothing is shuffled.

Letters, numbers and capitals are those of the tokenizers library, whose tables differ from Python's and from those of the
pattern library: the differences are listed below.

Defined results: a null text is empty and has no tokens; bytes that the vocabulary lacks are left out, as the file has
no unknown token; special tokens are found in the raw text and keep their id; repeated rows get a row each; an empty table
gives an empty one; other columns pass through, but a column `bpe` is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_column_from_text, without_gc

SHORT = 64
CACHE = 400_000
MAX_VOCABULARY_BYTES = 64 << 20
#: Letters and numbers of the pattern library that Unicode 16 does not have.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
#: Small letters of capitals that Unicode added after version 15.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
ENCODED = "struct<ids:array<int>,decoded:string>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


_NEW = regex.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """What encoding needs of a tokenizers file: ids, ranks of merges, special tokens, pattern, suffix of word ends."""
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes; it is no vocabulary to broadcast")
    spec = json.loads(raw)
    model, (split, *_) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    return {
        "ids": model["vocab"],
        "ranks": {tuple(pair): rank for rank, pair in enumerate(model["merges"])},
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "pattern": _with_known_letters(split["pattern"]["Regex"]),
        "suffix": model["end_of_word_suffix"] or "",
    }


def _with_known_letters(pattern: str) -> str:
    """The pattern with letters and numbers as the library has them, which knows Unicode 16."""
    ends = [(x.partition("-")[0], x.rpartition("-")[2]) for x in LATER.split()]
    later = "".join(f"\\U{a:>08}-\\U{b:>08}" for a, b in ends)
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{later}]]")
    return pattern


def merge_short(parts: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merges by scans over the array of adjacent ranks; merged[rank] is the part that a merge gives."""
    none, get, size = len(merged), ranks.get, len(parts) - 1
    near = [get(pair, none) for pair in zip(parts, parts[1:])]
    while size and (least := min(near)) != none:
        at = near.index(least)
        parts[at] = part = merged[least]
        del parts[at + 1], near[at]
        size -= 1
        if at:
            near[at - 1] = get((parts[at - 1], part), none)
        if at < size:
            near[at] = get((part, parts[at + 1]), none)
    return parts


def merge_long(parts: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """The same merges in the same order: a heap of (rank, place) over linked parts."""
    gone, end = -1, len(parts)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= end or parts[j] != right:
            continue
        parts[i], parts[j] = merged[rank], gone
        after[i] = after[j]
        if after[j] < end:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < end and (pair := (parts[a], parts[b])) in ranks:
                heapq.heappush(heap, (ranks[pair], a, pair))
    return [p for p in parts if p != gone]


def normalised(text: str) -> str:
    """NFC and the lower case of each character by itself. White space may stay as it is: no pre-token holds any."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # else a final sigma depends on its neighbours
    return text.translate(NEW_CAPITALS) if _NEW.search(text) else text


class Encoder:
    """Encodes texts in one task."""

    def __init__(self, spec: dict):
        ids, self.special, suffix = spec["ids"], spec["special"], spec["suffix"]
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        self.numbers = {i: str(i) for i in self.tokens}
        self.ranks = {(ids[a], ids[b]): rank for (a, b), rank in spec["ranks"].items()}
        self.merged = [ids[a + b] for a, b in spec["ranks"]]
        alphabet = byte_alphabet()
        self.inner, self.last = [ids.get(c) for c in alphabet], [ids.get(c + suffix) for c in alphabet]
        self.words = regex.compile(spec["pattern"], regex.V1)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cached: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[bytes, tuple[tuple[int, ...], str, str]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token."""
        raw, inner = word.encode(), self.inner
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if None in parts:
            parts = [p for p in parts if p is not None]
        found = tuple((merge_short if len(parts) <= SHORT else merge_long)(parts, self.ranks, self.merged))
        if len(word) <= SHORT:
            self.cached[word] = found
        return found

    def chunk(self, chunk: bytes) -> tuple[tuple[int, ...], str, str]:
        """Ids of what stands between two ASCII white spaces, and their numbers and tokens joined by spaces."""
        found = self.chunks.get(chunk)
        if found is None:
            ids: list[int] = []
            text = chunk.decode()
            for k, piece in enumerate(self.specials.split(text) if any(s in text for s in self.special) else [text]):
                if k % 2:
                    ids.append(self.special[piece])
                else:
                    piece = normalised(piece)
                    for word in [piece] if piece.isalpha() else self.words.findall(piece):
                        ids += self.cached.get(word) or self.word(word)
            found = tuple(ids), " ".join([self.numbers[i] for i in ids]), " ".join([self.tokens[i] for i in ids])
            if len(chunk) <= SHORT:
                if len(self.chunks) >= CACHE:  # the frequent ones soon return
                    self.chunks.clear()
                    self.cached.clear()
                self.chunks[chunk] = found
        return found

    def text(self, text: bytes) -> list[tuple[tuple[int, ...], str, str]]:
        """Each chunk of a text, as chunk() gives it; those without a token are left out.

        No pre-token or special token holds white space, and none takes part in NFC, so chunks encode by themselves."""
        get, chunk = self.chunks.get, self.chunk
        return [x for x in [get(c) or chunk(c) for c in text.split()] if x[0]]


def _broadcast(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `bpe`: ids, and decoded (the text that they decode to)."""
    spec = _broadcast(docs.sparkSession, path)
    held: list[Encoder] = []

    def values(texts: list[bytes], _) -> list[dict]:
        held or held.append(Encoder(spec.value))
        with without_gc():
            words = [held[0].text(t) for t in texts]
            return [{"ids": [i for w in found for i in w[0]], "decoded": " ".join(w[2] for w in found)} for found in words]

    return with_column_from_text(docs, "bpe", ENCODED, values, keep=keep)


def digests(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `bpe`: n_tokens and the SHA-256 of ids and of decoded text.

    The same encoder as encode(); the ids themselves need not leave the task."""
    spec = _broadcast(docs.sparkSession, path)
    held: list[Encoder] = []
    sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()

    def values(texts: list[bytes], _) -> list[dict]:
        held or held.append(Encoder(spec.value))
        out = []
        with without_gc():
            for t in texts:
                found = held[0].text(t)
                out.append({"n_tokens": sum(len(w[0]) for w in found), "ids_sha256": sha([w[1] for w in found]), "decoded_sha256": sha([w[2] for w in found])})
        return out

    return with_column_from_text(docs, "bpe", DIGEST, values, keep=keep)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`: the tokens of an id array, joined by one space, as the file names no decoder."""
    spec = load(path) if path else _broadcast(encoded.sparkSession, None).value
    names = {i: t for t, i in {**spec["ids"], **spec["special"]}.items()}
    tokens = encoded.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def joined(column):
        return column.map(lambda row: None if row is None else " ".join(tokens.value[i] for i in row if i in tokens.value))

    return encoded.withColumn("decoded", joined(F.col(ids)))


def op5_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "bpe.*")
