"""Near duplicates: tiled exact comparison of SimHash fingerprints.

Every text gets a 64-bit fingerprint; equal fingerprints are collapsed first.
The distinct ones are laid out in tiles by their population counts: the count
of ones in each of ``blocks`` equal parts of the fingerprint. One differing bit
changes one of these counts by one, so two fingerprints within the radius lie in
tiles whose counts differ by at most the radius in all; every other pair of
tiles is skipped. The remaining tile pairs are compared exactly with numpy,
exclusive-or and bit counts. The number of parts follows the number of distinct
fingerprints, so that a tile stays near TILE fingerprints; results do not depend
on it. Larger tiles are cut into chunks, and a task gets one chunk and at most
PER_TASK partner chunks.

A task returns the spanning links of what it compared, not all pairs, and
components are found by distributed star contraction. The texts are not
shuffled.

Null text counts as empty and has fingerprint zero, like a text without words.
Rows that repeat an id are returned one by one. A null id takes part, but is the
smallest of a group only if there is no other. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches, written
from softgrove.llm.components import components
from softgrove.llm.keeping import stay

SHINGLE = 3
SEED = 42
RADIUS = 2
TILE = 4096
PER_TASK = 24
STEP = 256
#: parts of a fingerprint -> bits that hold the count of one part
COUNT_BITS = {1: 7, 2: 6, 4: 5, 8: 4, 16: 3}


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' hashes, unsigned."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, seed), "big")
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:len(words) - shingle + 1].tolist()
    end = end[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(start), 1 << 16):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(start[k:k + (1 << 16)], end[k:k + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
    return pa.array(found.view(np.int64))


def blocks_for(n: int, tile: int = TILE) -> int:
    """Fewest parts with which random fingerprints share a tile with at most ``tile`` others."""
    for blocks in COUNT_BITS:
        width = 64 // blocks
        same = 1.0
        for k in range(1, width + 1):  # chance that two parts have the same count: C(2w, w) / 4**w
            same *= (2 * k - 1) / (2 * k)
        if n * same ** blocks <= tile:
            return blocks
    return max(COUNT_BITS)


def steps(blocks: int, radius: int) -> list[int]:
    """Differences of tile keys within the radius, one of each pair of opposite ones."""
    bits = COUNT_BITS[blocks]
    found = {0}
    for _ in range(radius):
        found |= {d + sign * (1 << (bits * k)) for d, k, sign in itertools.product(found, range(blocks), (1, -1))}
    return sorted(d for d in found if d >= 0)


def tile_key(fp: Column, blocks: int) -> Column:
    width, bits = 64 // blocks, COUNT_BITS[blocks]
    key = F.lit(0).cast("long")
    for k in range(blocks):
        part = F.shiftrightunsigned(fp, k * width)
        if blocks > 1:
            part = part.bitwiseAND(F.lit((1 << width) - 1))
        key = key + F.shiftleft(F.bit_count(part).cast("long"), k * bits)
    return key


def _compare(left: np.ndarray, right: np.ndarray, radius: int, parent: np.ndarray, shift: int) -> None:
    """Joins, in the union-find forest ``parent``, rows of left with rows of right (numbered from shift)."""

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for begin in range(0, len(left), STEP):
        near = np.bitwise_count(left[begin:begin + STEP, None] ^ right[None, :]) <= radius
        for a, b in np.argwhere(near):
            x, y = root(begin + int(a)), root(shift + int(b))
            if x != y:
                parent[max(x, y)] = min(x, y)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, per_task: int = PER_TASK) -> DataFrame:
    """Spanning links (a, b) of all pairs of ``fps`` (distinct column fp) at most ``radius`` bits apart."""
    blocks = blocks_for(fps.count(), tile)
    fps = fps.select("fp", tile_key(F.col("fp"), blocks).alias("key"))
    tiles = fps.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    tiles = written(tiles, "tiles")
    other = tiles.select(F.col("key").alias("other"), F.col("chunks").alias("other_chunks"))
    pairs = tiles.withColumn("step", F.explode(F.array(*[F.lit(d).cast("long") for d in steps(blocks, radius)])))
    pairs = pairs.withColumn("other", F.col("key") + F.col("step")).join(other, "other")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_chunks") - 1)))
    pairs = pairs.filter("step > 0 OR i <= j").withColumn("itself", F.expr("step = 0 AND i = j"))
    number = F.row_number().over(Window.partitionBy("key", "i").orderBy(F.desc("itself"), "step", "j")) - 1
    pairs = pairs.withColumn("part", F.floor(number / per_task).cast("int"))
    task = ["key", "i", "part"]
    sent = pairs.select(*task, F.col("key").alias("tile"), F.col("i").alias("chunk"), F.lit(False).alias("partner")) \
        .distinct().unionByName(pairs.filter("NOT itself").select(
            *task, F.col("other").alias("tile"), F.col("j").alias("chunk"), F.lit(True).alias("partner")))
    sent = written(sent, "tile-pairs")
    placed = fps.join(tiles, "key").select("fp", F.col("key").alias("tile"),
                                           F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
    rows = placed.join(sent, ["tile", "chunk"]).select(*task, "partner", "fp")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        partner = table.column("partner").to_numpy().astype(bool)
        left, right = fp[~partner], fp[partner]
        order = np.concatenate([left, right])
        parent = np.arange(len(order))
        if key[2].as_py() == 0:
            _compare(left.view(np.uint64), left.view(np.uint64), radius, parent, 0)
        _compare(left.view(np.uint64), right.view(np.uint64), radius, parent, len(left))
        moved = np.flatnonzero(parent != np.arange(len(order)))
        return pa.table({"a": order[parent[moved]], "b": order[moved]})

    return rows.groupBy(*task).applyInArrow(compare, "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and fp of each row, written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"),
                       fingerprint_of(docs[text_col]).alias("fp"))
    return written(rows, "fingerprints")


def groups(marked: DataFrame, radius: int = RADIUS, tile: int = TILE, per_task: int = PER_TASK) -> DataFrame:
    """For each distinct fp of ``marked`` (id, text_hash, fp): root (a fp of the group), keep_id and keep_hash.

    The row that stays has the smallest id of the group.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    fps = written(marked.groupBy("fp").agg(first), "distinct-fps")
    linked = components(links(fps, radius, tile, per_task))
    rooted = fps.join(linked, fps["fp"] == linked["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "first")
    rooted = written(rooted, "rooted-fps")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return written(rooted.select("fp", "root").join(least, "root").select(
        F.col("fp").alias("group_fp"), "root", F.col("least.id").alias("keep_id"),
        F.col("least.text_hash").alias("keep_hash")), "fp-groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp, root, keep_id, keep_hash."""
    marked = fingerprints(docs, id_col, text_col)
    found = groups(marked, radius, tile)
    return marked.join(found, marked["fp"] == found["group_fp"]).drop("group_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
             tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: the one with the smallest id of each group."""
    member = written(near_duplicates(docs, id_col, text_col, radius, tile), "near-members")
    return stay(docs, member, id_col, F.xxhash64(docs[text_col]))
