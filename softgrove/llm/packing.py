"""Packing by powers of two: no sequence crosses documents and none is padded.

A document's tokens with the end mark are cut into pieces whose lengths are the
binary parts of their number (whole multiples of the longest first). Each piece
is one sequence, and its bucket, the power of two, says with which others it
can be stacked; a table written by ``write_buckets`` keeps equal lengths
together. The work is one pass without a shuffle; ids follow the row's place in
the input, so a task that is run again gives the same ids.

Token ids come from the named tokenizer file. A text whose white space is
single blanks or line ends is tokenized by distinct chunks (the pre-tokenizer
never joins a chunk to the next), other texts as a whole; both give the ids of
the whole text. Null text counts as empty: one piece that holds the end mark.
Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches

LONGEST = 2048
END_ID = 1
CACHE_CHUNKS = 800_000
BATCH_DOCS = 512
#: Texts with a zero byte, or with white space other than one blank or line end between two words.
ODD = (r"\x00|[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\v\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


class ChunkTokenizer:
    """Ids of whole texts, each distinct chunk tokenized once (in a cache of bounded size).

    A chunk is a word with the blank or line end before it. Letters, and a full
    stop or comma after letters, are pre-tokens of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.odd = "|".join([ODD, *[re.escape(t.content) for t in added if t.content]])
        self.model = self.tokenizer.model
        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        # bytes of the visible alphabet, in the order of their values: a fixed rule of byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        self.alphabet = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}
        assert set(self.alphabet.values()) == set(plain.alphabet())
        self.cache: dict[str, bytes] = {}
        self.single = {c: self._pre_token(c) for c in ("", ".", ",", "\n")}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _pre_token(self, text: str) -> bytes:
        shown = text.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes() if text else b""

    def _learn(self, keys: list[str]) -> None:
        """Ids of words as split off: a zero byte marks the first of a text, a line end stands for itself."""
        other: dict[str, str] = {}
        for key in keys:
            chunk = key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key
            last = chunk[-1] if chunk[-1] in ".," else ""
            first = "\n" if chunk[0] == "\n" else ""
            word = chunk[len(first):len(chunk) - len(last)]
            if word.removeprefix(" ").isalpha():
                self.cache[key] = self.single[first] + self._pre_token(word) + self.single[last]
            else:
                other[key] = chunk
        self.cache.update(zip(other, self._whole(list(other.values()))))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Unsigned 32-bit ids of each text, as on the machine (little-endian)."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        empty = pc.equal(pc.utf8_length(texts), 0)
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), empty).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        whole = np.flatnonzero(odd).tolist()
        for k, ids in zip(whole, self._whole(texts.take(pa.array(whole, pa.int64())).to_pylist())):
            out[k] = ids
        common = np.flatnonzero(~odd)
        if not len(common):
            return out
        marked = pc.binary_join_element_wise("\0", texts.take(pa.array(common)), "")
        words = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = pc.dictionary_encode(words.flatten())
        keys = coded.dictionary.to_pylist()
        self._learn([key for key in keys if key not in self.cache])
        ids = [self.cache[key] for key in keys]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(count) - count
        code = coded.indices.to_numpy()
        n = count[code]
        upto = np.cumsum(n)
        tokens = flat[np.repeat(start[code] - (upto - n), n) + np.arange(upto[-1])]
        ends = upto[words.offsets.to_numpy()[1:] - 1]
        begin = 0
        for k, end in zip(common.tolist(), ends.tolist()):
            out[k] = tokens[begin:end].tobytes()
            begin = end
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_of(path: str) -> ChunkTokenizer:
    """One per Python worker, so that its cache serves later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the binary parts of n, longest first."""
    out = [(start, longest) for start in range(0, n - n % longest, longest)]
    start, length = n - n % longest, longest >> 1
    while length:
        if n & length:
            out.append((start, length))
            start += length
        length >>= 1
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, bucket, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession, BATCH_DOCS)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, start, length, ids, tokens = [], [], [], [], []
            for k, found in enumerate(tokenizer.encode(batch.column(1))):
                found += end
                n = len(found) // 4
                for s, size in pieces(n, longest):
                    row.append(k)
                    start.append(s)
                    length.append(size)
                    ids.append(found[4 * s:4 * (s + size)])
                    tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64())],
                names=["id", "start", "length", "ids", "doc_tokens"])

    out = rows.mapInArrow(run, schema)
    return out.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(),
                            "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, so that a reader stacks rows without padding."""
    packed.write.partitionBy("bucket").parquet(path)
