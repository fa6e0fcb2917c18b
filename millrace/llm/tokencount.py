"""Token counts of a unigram vocabulary by dynamic programming over a trie.

The distinct pre-tokens of a task go into a trie. Each node holds the best score of the text from its root (the
forward score of the unigram model) and the least number of tokens that reach it, computed once from the nodes
above it that a piece can start at, however many pre-tokens pass through; the count at the last node of a pre-token is its
token count. A text's count is the sum over its pre-tokens. Texts are counted where they are read; nothing is
shuffled. The vocabulary is a public file of fixed size, checked before it is broadcast.

A pre-token is a word `[^\\x20\\x09-\\x0D]+` after the mark U+2581. A character that no piece covers scores ten less
than the worst piece and counts as its UTF-8 bytes. Of equal scores the fewer tokens win. Scores are those of the
file; those of the file at hand, a BPE model, are the negative ranks of its merges. Pre-tokens above LONG characters are
worked out by themselves, so that the trie stays small; trie and cache start anew when they are full, which changes no
count.

Defined results: a null or wordless text has no words and 0 tokens; repeated rows get a row each; an empty table gives an
empty one; other columns pass through, but a column `counts` is replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, with_column_from_text, without_gc

MARK = "▁"
LONG = 48
NODES = 1_000_000
WORDS = 400_000
MAX_VOCABULARY_BYTES = 64 << 20
COUNTS = "struct<n_words:bigint,n_tokens:bigint,n_bytes_fallback:bigint>"


def load(path: str | None = None) -> dict:
    """Pieces and scores of a sentencepiece model; control, unknown and byte pieces are not for text."""
    import os

    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes; it is no vocabulary to broadcast")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in usable}


class Trie:
    """Nodes are numbers: child maps node and character to a node, and parallel lists hold what is known of each."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10.0
        #: Ends of pieces: a piece that ends at a place grows leftwards only while what it covers is one.
        self.ends = {piece[k:] for piece in scores for k in range(len(piece))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.states: list[tuple[float, int, int]] = [(0.0, 0, 0)]

    def step(self, word: str, end: int, path: list[tuple[float, int, int]]) -> tuple[float, int, int]:
        """Forward score, tokens (negative, so that more is better) and fallback bytes of word[:end], from the shorter prefixes."""
        scores, ends, start = self.scores, self.ends, end - 1
        best, tokens, lost = path[start]
        score = scores.get(word[start])
        if score is None:
            size = len(word[start].encode())
            found = (best + self.unknown, tokens - size, lost + size)
        else:
            found = (best + score, tokens - 1, lost)
        while start and (piece := word[start - 1 : end]) in ends:
            start -= 1
            score = scores.get(piece)
            if score is not None:
                best, tokens, lost = path[start]
                best += score
                if best > found[0] or best == found[0] and tokens - 1 > found[1]:
                    found = (best, tokens - 1, lost)
        return found

    def count(self, word: str) -> tuple[int, int]:
        """Tokens and fallback bytes of a pre-token."""
        path, shared, node, child, states = [(0.0, 0, 0)], len(word) <= LONG, 0, self.child, self.states
        for end, c in enumerate(map(ord, word), 1):
            if shared:
                edge = node << 21 | c
                node = child.get(edge)
                if node is None:
                    node = child[edge] = len(states)
                    states.append(self.step(word, end, path))
                path.append(states[node])
            else:
                path.append(self.step(word, end, path))
        if len(states) > NODES:
            self.clear()
        return -path[-1][1], path[-1][2]


def token_counts(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `counts`: n_words, n_tokens, n_bytes_fallback."""
    scores = docs.sparkSession.sparkContext.broadcast(load(path))
    held: list[Trie] = []
    known: dict[bytes, tuple[int, int]] = {}

    def values(texts: list[bytes], _) -> pa.Array:
        held or held.append(Trie(scores.value))
        if len(known) > WORDS:
            known.clear()
        rows = []
        with without_gc():
            for text in texts:
                words = text.split()
                tokens = lost = 0
                for w, n in Counter(words).items():
                    if (found := known.get(w)) is None:
                        found = held[0].count(MARK + w.decode())
                        if len(w) <= LONG:
                            known[w] = found
                    tokens += n * found[0]
                    lost += n * found[1]
                rows.append((len(words), tokens, lost))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["n_words", "n_tokens", "n_bytes_fallback"])

    return with_column_from_text(docs, "counts", COUNTS, values, keep=keep)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "counts.*")
