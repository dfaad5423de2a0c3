"""Token counts of a unigram model by dynamic programming on a trie of pre-tokens.

A pre-token is a word with one blank before it. The best segmentation of a
prefix into vocabulary pieces (highest sum of piece scores, then fewest pieces)
depends on nothing behind it, so it belongs to a node of the trie of all
distinct pre-tokens and is computed once for all words that share the prefix.
Words in sorted order are the trie's depth-first walk: the stack holds the path
to the current node, and a new word goes on from where it leaves the last one.
The piece count at a word's end, its terminal, is stored and summed over the
words of each text.

The vocabulary is that of a public tokenizer file, in order of rank; nothing is
trained. A piece's score is the logarithm of a Zipf share, -ln(rank + 1). All
256 single bytes are pieces, so every text can be segmented.

One pass without a shuffle. Terminals are kept over batches in a cache of
bounded size. A null or empty text has no tokens. Rows that repeat an id are
counted one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from softgrove.llm.common import small_batches

CACHE_WORDS = 500_000


class Vocabulary:
    """Pieces with scores, and all ends of pieces, which say how far to look back."""

    def __init__(self, pieces: dict[bytes, float]):
        self.scores = pieces
        self.ends = {p[k:] for p in pieces for k in range(len(p))}

    @classmethod
    def ranked(cls, path: str) -> Vocabulary:
        """From lines of base64 piece and rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(piece): -math.log(int(rank) + 1) for piece, rank in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.ranked(path)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n) if n > 64 else [
        x != y for x, y in zip(a, b)]
    return int(np.argmax(differ)) if n > 64 else differ.index(True)


def terminals(words: list[bytes], vocab: Vocabulary) -> dict[bytes, int]:
    """Pieces in the best segmentation of each distinct word."""
    scores, ends = vocab.scores, vocab.ends
    out: dict[bytes, int] = {}
    path, best, pieces = b"", [0.0], [0]
    for word in sorted(set(words)):
        keep = _shared(path, word)
        del best[keep + 1:], pieces[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            top, fewest = -math.inf, 0
            start = end - 1
            while start >= 0 and (piece := word[start:end]) in ends:
                if piece in scores:
                    score = best[start] + scores[piece]
                    if score > top or score == top and pieces[start] + 1 < fewest:
                        top, fewest = score, pieces[start] + 1
                start -= 1
            best.append(top)
            pieces.append(fewest)
        path = word
        out[word] = pieces[-1]
    return out


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pre_tokens, n_tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_pre_tokens", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        known: dict[bytes, int] = {}
        for batch in batches:
            if len(known) > CACHE_WORDS:
                known = {}
            words = [[b" " + w for w in (t or "").encode("utf-8", "surrogatepass").split()]
                     for t in batch.column(1).to_pylist()]
            known |= terminals([w for text in words for w in text if w not in known], vocab)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(text) for text in words], pa.int64()),
                 pa.array([sum(map(known.__getitem__, text)) for text in words], pa.int64())],
                names=["id", "n_pre_tokens", "n_tokens"])

    return rows.mapInArrow(run, schema)
