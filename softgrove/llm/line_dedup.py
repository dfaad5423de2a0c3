"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per group.

Lines are normalised (lower case, digits to 0, white space to single blanks);
every line that is not empty then takes part, or with ``min_words`` those with
as many words, and others always stay. Equal normalised lines are collapsed first, with map-side counting. Two different ones
are linked if their 64-bit SimHash fingerprints (over distinct words, so that a
separator that makes up half a line has no more weight than a word) differ in at
most ``radius`` bits and their edit similarity, 1 - distance / longer
length, is at least ``similarity``. Connected lines are a group, and of all its
occurrences the first (smallest id, text hash and line number) stays.

Candidates meet by the pigeonhole principle: of ``m`` blocks of a fingerprint,
at least m - radius agree, so lines are joined on every choice of that many
blocks. m follows the number of distinct lines, so that a key is rarely shared
by chance; the result does not depend on it. Only lines with a partner within
the radius get their text fetched, and go on only under the keys at which they meet one. A pair is
verified under the first key that it shares and only if it is not connected yet; a task returns
spanning links, not all pairs.
Keys with many lines are cut into chunks and compared chunk pair by chunk pair,
so no key lands in one task.

Null text has no lines. Rows that repeat id and text are one document: they keep
and lose the same lines. A null id comes after all others. An empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches, written
from softgrove.llm.components import components

MIN_WORDS = 1
#: for taking lines out of texts, where short ones (list marks, brackets) carry the layout
MIN_WORDS_OUT = 5
RADIUS = 3
SIMILARITY = 0.8
CHUNK = 1024
SLICE_WORDS = 100_000
SEGMENT = 255  # a byte counts no further
SLOTS = 1 << 23
TASK_LINES = 4096
DIGIT = re.compile(r"\d")
ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def folded(text: str) -> str:
    """Lower case, digits to 0."""
    return text.encode().translate(ASCII).decode() if text.isascii() else DIGIT.sub("0", text.lower())


def normalise(line: str) -> str:
    return " ".join(folded(line).split())


def fingerprints(lines: list[str]) -> np.ndarray:
    """Majority bits of the hashes of the distinct words of each line (every line has a word).

    Ones are counted in bytes, eight bits of a hash to a 64-bit word, over segments of at most SEGMENT words.
    """
    import xxhash

    words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
    number = words.flatten().dictionary_encode()
    vocabulary = number.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, vocabulary, itertools.repeat(3))), np.uint8).reshape(-1, 8)
    line = np.repeat(np.arange(len(lines)), words.value_lengths().to_numpy())
    both = np.sort(line * len(vocabulary) + number.indices.to_numpy())
    line, flat = np.divmod(both[np.diff(both, prepend=-1) > 0], len(vocabulary))
    n = np.bincount(line)
    segments = -(-n // SEGMENT)
    first = np.cumsum(segments) - segments
    start = np.repeat(np.cumsum(n) - n, segments) + (np.arange(segments.sum()) - np.repeat(first, segments)) * SEGMENT
    counted = np.empty((len(start), 64), np.uint8)
    step = max(1, SLICE_WORDS // SEGMENT)
    for k in range(0, len(start), step):
        begin, end = start[k], start[k + step] if k + step < len(start) else len(flat)
        bits = np.unpackbits(hashes[flat[begin:end]], axis=1).view(np.uint64)
        counted[k:k + step] = np.add.reduceat(bits, start[k:k + step] - begin, axis=0).view(np.uint8)
    ones = np.add.reduceat(counted, first, axis=0, dtype=np.int64)
    out = np.packbits(2 * ones > n[:, None], axis=1)
    return out.view(">u8").ravel().astype(np.uint64).view(np.int64)


def _differ_at(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer."""
    start = _differ_at(a, b)
    a, b = a[start:], b[start:]
    end = _differ_at(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        vertical = same | down
        more = (down | ~(across | up)) & every
        less = up & across
        distance += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up = (less | ~(vertical | more)) & every
        down = more & vertical
    return distance


def at_most(a: str, b: str) -> int:
    """An upper bound of the edit distance: words are replaced one by one, but for one run that only the longer line has."""
    one, other = sorted((a.split(" "), b.split(" ")), key=len)
    more = len(other) - len(one)
    left = itertools.accumulate((0 if x == y else max(len(x), len(y)) for x, y in zip(one, other)), initial=0)
    right = list(itertools.accumulate((0 if x == y else max(len(x), len(y)) for x, y in zip(reversed(one), reversed(other))),
                                      initial=0))
    size = list(itertools.accumulate((len(x) + 1 for x in other), initial=0))
    return min(x + y + size[k + more] - size[k] for k, (x, y) in enumerate(zip(left, reversed(right))))


def similar(a: str, b: str, similarity: float) -> bool:
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < similarity * longer:
        return False
    allowed = (1 - similarity) * longer + 1e-9
    return at_most(a, b) <= allowed or edit_distance(a, b) <= allowed


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of characters by code point modulo 64; a row per text."""
    return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
                     for t in texts])


def at_least(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance: characters that one side has more of."""
    more = others - one
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))


def place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "line_no")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_hash, line_no, line_hash and fp of every line that takes part, written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("line_no", T.IntegerType()),
                           T.StructField("line_hash", T.BinaryType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            row, number, found = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for at, line in enumerate(folded(text or "").split("\n")):
                    line = " ".join(line.split())
                    if line.count(" ") + 1 >= min_words and line:
                        row.append(k)
                        number.append(at)
                        found.append(line)
            take = pa.array(row, pa.int64())
            hashes = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()),
                 pa.array(hashes, pa.binary()), pa.array(fingerprints(found) if found else [], pa.int64())],
                names=["id", "text_hash", "line_no", "line_hash", "fp"])

    return written(rows.mapInArrow(run, schema), "lines")


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks with which at most one line in 32 shares a key by chance."""
    blocks = radius + 2
    while blocks < 16 and n * math.comb(blocks, radius) > 2 ** (64 * (blocks - radius) / blocks) / 32:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int) -> list[int]:
    """Bits that must agree, for every choice of blocks - radius blocks."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << cut[k + 1]) - 1) ^ ((1 << cut[k]) - 1) for k in range(blocks)]
    return [sum(block[k] for k in choice) for choice in itertools.combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(choice: int, fp: np.ndarray, text: list[str], letters: np.ndarray, n_left: int, must_agree: np.ndarray,
              radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links (rows) that join what is alike under one key; with ``n_left`` < rows, only between left rows and others."""
    n, whole = len(fp), n_left == len(fp)
    length = letters.sum(1)
    group = np.arange(n)
    links: list[tuple[int, int]] = []
    for a in range(n_left):
        begin = a + 1 if whole else n_left
        differ = fp[begin:] ^ fp[a]
        near = np.flatnonzero((np.bitwise_count(differ) <= radius) & (group[begin:] != group[a]))
        if not len(near):
            continue
        first = np.argmax((must_agree[:, None] & differ[near]) == 0, axis=0)
        allowed = (1 - similarity) * np.maximum(length[begin + near], length[a]) + 1e-9
        near = near[(first == choice) & (at_least(letters[a], letters[begin + near]) <= allowed)]
        for k in (begin + near).tolist():
            if group[k] != group[a] and similar(text[a], text[k], similarity):
                group[group == group[k]] = group[a]
                links.append((a, k))
    return links


def _sorted_groups(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, list[int]]:
    """Columns of a task sorted by key and chunk pair, the order, and where groups begin."""
    column = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "own", "choice", "fp")}
    order = np.lexsort((column["own"], column["j"], column["i"], column["key"], column["choice"]))
    column = {c: v[order] for c, v in column.items()}
    new = np.zeros(len(order), bool)
    for c in ("choice", "key", "i", "j"):
        new[1:] |= column[c][1:] != column[c][:-1]
    column["fp"] = column["fp"].view(np.uint64)
    return column, order, [0, *np.flatnonzero(new).tolist(), len(order)]


def _has_partner(column: dict[str, np.ndarray], edges: list[int], must_agree: np.ndarray, radius: int) -> np.ndarray:
    """Rows within the radius of another row of their group, under the first key that the two share."""
    fp, choice = column["fp"], column["choice"]
    out = np.zeros(len(fp), bool)

    def close(differ: np.ndarray, mine) -> np.ndarray:
        near = np.bitwise_count(differ) <= radius
        near[near] = np.argmax((must_agree[:, None] & differ[near]) == 0, axis=0) == (mine[near] if np.ndim(mine) else mine)
        return near

    begin, end = np.array(edges[:-1]), np.array(edges[1:])
    pairs = begin[(end - begin == 2) & (column["i"][begin] == column["j"][begin])]
    near = close(fp[pairs] ^ fp[pairs + 1], choice[pairs])
    out[pairs[near]] = out[pairs[near] + 1] = True
    for x, y in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist()):
        whole = column["i"][x] == column["j"][x]
        n_left = y - x if whole else int((column["own"][x:y] == column["i"][x]).sum())
        for a in range(x, x + n_left):
            first = a + 1 if whole else x + n_left
            near = close(fp[first:y] ^ fp[a], choice[a])
            if near.any():
                out[a] = True
                out[first:y][near] = True
    lone = begin[(end - begin == 2) & (column["i"][begin] != column["j"][begin])]
    near = close(fp[lone] ^ fp[lone + 1], choice[lone]) & (column["own"][lone] != column["own"][lone + 1])
    out[lone[near]] = out[lone[near] + 1] = True
    return out


def _in_tasks(met: DataFrame) -> DataFrame:
    """Rows of ``met`` dealt to tasks: small keys share one, each chunk pair of a large key has its own."""
    tasks = max(1, -(-met.count() // TASK_LINES))
    own = F.pmod(F.xxhash64("line_hash"), F.col("chunks")).cast("int")
    rows = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    task = F.when(F.col("chunks") == 1, F.pmod("key", F.lit(tasks))).otherwise(F.xxhash64("key", "i", "j"))
    return rows.withColumn("task", task).drop("other", "chunks")


def _slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def _slots(rows: DataFrame, *columns: str) -> DataFrame:
    """Hash slots of the rows' keys: at most SLOTS small rows, so it may be broadcast at any size of the input."""
    return F.broadcast(rows.select(_slot(*columns).alias("slot")).distinct())


def links(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, radius: int, similarity: float,
          chunk: int) -> DataFrame:
    """Spanning links (a, b) between line hashes. ``distinct`` has line_hash, fp and first (a place).

    Lines that share a key are compared by fingerprint first; the texts of those
    with a partner are then fetched and verified. Slot filters keep what shares no
    key, or is not wanted, out of the shuffles.
    """
    choice = masks(blocks_for(distinct.count(), radius), radius)
    must_agree = np.array(choice, np.uint64)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(choice)])
    each = distinct.select("line_hash", "fp", F.posexplode(keys).alias("choice", "key"))
    shared = each.select("key").repartition("key")  # few keys repeat, so they are not counted before the shuffle
    shared = shared.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(shared.select(F.col("key").alias("shared"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks")),
                     "shared-keys")
    each = each.withColumn("slot", _slot("key")).join(_slots(shared, "shared"), "slot", "left_semi").drop("slot")
    met = written(each.join(shared, F.col("key") == F.col("shared")).drop("shared"), "met-lines")

    def partners(table: pa.Table) -> pa.Table:
        column, order, edges = _sorted_groups(table)
        return table.take(pa.array(order[_has_partner(column, edges, must_agree, radius)], pa.int64()))

    met = _in_tasks(met)
    near = written(met.groupBy("task").applyInArrow(partners, met.schema), "candidates")
    wanted = near.select("line_hash").distinct().join(distinct.select("line_hash", "first"), "line_hash")
    wanted = written(wanted.select("line_hash", "first.*"), "wanted-lines")
    texts = docs.select(docs[id_col].alias("__id"), F.xxhash64(docs[text_col]).alias("__hash"),
                        F.posexplode(F.split(docs[text_col], "\n")).alias("__line_no", "__line"))
    texts = texts.withColumn("slot", _slot("__hash", "__line_no")).join(_slots(wanted, "text_hash", "line_no"), "slot", "left_semi")
    texts = texts.join(wanted, texts["__id"].eqNullSafe(wanted["id"]) & (texts["__hash"] == wanted["text_hash"])
                       & (texts["__line_no"] == wanted["line_no"]))
    texts = written(texts.select("line_hash", F.col("__line").alias("line")).dropDuplicates(["line_hash"]), "line-texts")
    rows = near.join(texts, "line_hash")

    def verify(table: pa.Table) -> pa.Table:
        column, order, edges = _sorted_groups(table)
        raw, hashes = table.column("line").to_pylist(), table.column("line_hash").to_pylist()
        text = [normalise(raw[k]) for k in order]
        letters = letter_counts(text)
        found: list[tuple[int, int]] = []
        for begin, end in zip(edges, edges[1:]):
            if end - begin > 1:
                i, j = column["i"][begin], column["j"][begin]
                n_left = end - begin if i == j else int((column["own"][begin:end] == i).sum())
                joined = _spanning(int(column["choice"][begin]), column["fp"][begin:end], text[begin:end],
                                   letters[begin:end], n_left, must_agree, radius, similarity)
                found += [(begin + a, begin + b) for a, b in joined]
        return pa.table({"a": pa.array([hashes[order[a]] for a, _ in found], pa.binary()),
                         "b": pa.array([hashes[order[b]] for _, b in found], pa.binary())})

    return rows.groupBy("task").applyInArrow(verify, "a binary, b binary")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                radius: int = RADIUS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """id, text_hash, line_no, first (the occurrence that stays) and kept of every line that takes part."""
    found = lines(docs, id_col, text_col, min_words)
    distinct = written(found.groupBy("line_hash").agg(F.max("fp").alias("fp"), F.min(place()).alias("first")),
                       "distinct-lines")
    linked = components(links(distinct, docs, id_col, text_col, radius, similarity, chunk))
    rooted = distinct.join(linked, distinct["line_hash"] == linked["node"], "left").select(
        "line_hash", F.coalesce("component", "line_hash").alias("root"), "first")
    rooted = written(rooted, "rooted-lines")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    stays = written(rooted.select("line_hash", "root").join(least, "root").select(
        F.col("line_hash").alias("group_line"), "least"), "line-groups")
    out = found.join(stays, found["line_hash"] == stays["group_line"])
    return out.select("id", "text_hash", "line_no", F.col("least").alias("first"),
                      place().eqNullSafe(F.col("least")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS_OUT,
                 **options) -> DataFrame:
    """``docs`` with the lines of at least ``min_words`` words that do not stay taken out of the text."""
    dropped = line_groups(docs, id_col, text_col, min_words, **options).filter("NOT kept")
    dropped = written(dropped.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.collect_set("line_no").alias("__dropped")), "dropped-lines")
    same = docs[id_col].eqNullSafe(dropped["__id"]) & (F.xxhash64(docs[text_col]) == dropped["__hash"])
    out = docs.join(dropped, same, "left")
    left = F.array_join(F.filter(F.split(docs[text_col], "\n"),
                                 lambda line, k: ~F.array_contains(F.col("__dropped"), k)), "\n")
    text = F.when(F.col("__dropped").isNull(), docs[text_col]).otherwise(left)
    return out.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
