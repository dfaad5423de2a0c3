"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become whole numbers, floor(scale * component). The index holds them in
blocks. Within a block every dimension is a posting list cut into segments of
like values, ordered by value, with the largest and smallest value of each
segment. The impact of a segment on a query is its weight times the larger end
of the segment, so it bounds what each posting adds to a score.

A query takes the segments of a block in rounds of falling quantised impact, from
both ends of the value order according to the sign of its weight, and adds
impacts to accumulators. What a vector may still gain is bounded by the best
open segments of the dimensions where it was not met; a dimension is counted for
each vector, so that a vector met in c of them gains at most the sum of the
largest open impacts but c. Vectors whose bound is below the k-th best exact
score seen so far are proven out. Rounds end when few others are left, or with
the last segment; the others, the possible members, are scored exactly.

Blocks meet groups of queries by a join on the number of the block, so the work
spreads over blocks and lanes of groups, and each pair hands on at most k rows a
query. The k best of those are the answer.

Rows whose vector is null, or holds a null or a component that is not finite,
take no part. Shorter vectors count as continued with zeros; an empty vector
scores 0 with all. Scaled components are limited to +-2**26, so that sums fit a
BIGINT. Rows that repeat are rows of their own: a query meets all rows but
itself. Ties go to the smaller id, rows without an id come last and are never
queries. No queries or no other rows give an empty result; other columns of the
table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softgrove.llm.common import batches_of, written

SCALE = 256
LIMIT = 1 << 26
BLOCK_ROWS = 16_384
GROUP_ROWS = 128
LEVELS = 32
#: Shares of the largest impact at which a round ends; the last round takes what lowers the score.
HORIZONS = (0.75, 0.5, 0.375, 0.25, 0.18, 0.12, 0.06, 0.0)
#: Possible members that end the rounds, as a share of a block.
FEW = 1 / 64
EXACT = float(1 << 53)
INDEX_SCHEMA = ("block long, dims int, rids binary, ids binary, nameless binary, vectors binary, postings binary, "
                "bounds binary, high binary, low binary")
GROUP_SCHEMA = "group long, dims int, rids binary, ids binary, vectors binary"
HIT_SCHEMA = "query_rid long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def scaled(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * component), the component as double."""
    return F.transform(vector, lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(limit))), F.lit(-float(limit)))).cast("long"))


def matrix(lists: pa.Array, dims: int | None = None, kind: type = np.int32) -> np.ndarray:
    """Lists of numbers as rows, continued with zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0)) if dims is None else dims
    if len(lengths) and (lengths == width).all():
        return values[offsets[0]:offsets[-1]].reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    for k, n in enumerate(lengths.tolist()):
        out[k, :n] = values[offsets[k]:offsets[k + 1]]
    return out


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of at most so many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + len(batch) >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, rows - n)]).combine_chunks()
            batch = batch.slice(rows - n)
            held, n = [], 0
        if len(batch):
            held.append(batch)
            n += len(batch)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def indexed(vectors: np.ndarray, levels: int) -> dict[str, np.ndarray]:
    """Posting lists by dimension in order of value, cut into segments of equal value ranges."""
    n, dims = vectors.shape
    low = vectors.min(axis=0, initial=LIMIT).astype(np.int64) if n else np.zeros(dims, np.int64)
    span = vectors.max(axis=0, initial=-LIMIT).astype(np.int64) - low + 1
    level = (vectors - low) * levels // span
    postings = np.argsort(level, axis=0, kind="stable").T.astype(np.uint16)
    bounds = np.zeros((dims, levels + 1), np.int32)
    ends = np.empty((2, dims, levels), np.int64)
    for d in range(dims):
        bounds[d, 1:] = np.cumsum(np.bincount(level[:, d], minlength=levels))
        ends[0, d], ends[1, d] = low[d], low[d] + span[d] - 1
        np.maximum.at(ends[0, d], level[:, d], vectors[:, d])
        np.minimum.at(ends[1, d], level[:, d], vectors[:, d])
    high = np.maximum.accumulate(ends[0], axis=1)  # empty segments take the end of a neighbour, so that ends stay in order
    least = np.minimum.accumulate(ends[1][:, ::-1], axis=1)[:, ::-1]
    return {"postings": postings, "bounds": bounds, "high": high.astype(np.int32), "low": least.astype(np.int32)}


class Block:
    """A block of the index with its search."""

    def __init__(self, vectors: np.ndarray, postings: np.ndarray, bounds: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.vectors, self.postings, self.bounds, self.high, self.low = vectors, postings, bounds, high, low
        self.largest = np.abs(vectors).max(axis=0, initial=0).astype(np.float64)
        self.floats = vectors.astype(np.float64)

    def exact(self, query: np.ndarray, members: np.ndarray, bound: float) -> np.ndarray:
        if bound < EXACT:
            return (self.floats[members] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[members].astype(np.int64) @ query.astype(np.int64)

    def possible(self, query: np.ndarray, k: int, least: float, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of all vectors that may be among the k best and reach ``least``."""
        n = len(self.vectors)
        bound = float(self.largest @ np.abs(query).astype(np.float64))
        slack = 0.0 if bound < EXACT else bound * 2.0 ** -44
        used = np.flatnonzero(query)
        weight = query[used].astype(np.float64)
        up = weight > 0
        # impacts and posting ranges in order of falling impact: from the high values if the weight is positive
        impact = np.where(up[:, None], self.high[used][:, ::-1], self.low[used]) * weight[:, None]
        edges = self.bounds[used].astype(np.int64)
        upper, counts = np.zeros(n), np.zeros(n, np.int64)
        done = np.zeros(len(used), np.int64)
        alive, top = np.ones(n, bool), float(impact.max(initial=0.0))
        if own >= 0:
            alive[own] = False
        levels = impact.shape[1]
        rows = np.arange(len(used))
        for at, horizon in enumerate((*[h * top for h in HORIZONS], -np.inf)):
            upto = np.maximum((impact >= horizon).sum(axis=1), done)
            taken, added = [], []
            for j in np.flatnonzero(upto > done).tolist():
                a, b = int(done[j]), int(upto[j])
                if up[j]:
                    cut = edges[j, levels - b:levels - a + 1]
                    added.append(np.repeat(impact[j, a:b][::-1], np.diff(cut)))
                else:
                    cut = edges[j, a:b + 1]
                    added.append(np.repeat(impact[j, a:b], np.diff(cut)))
                taken.append(self.postings[used[j], cut[0]:cut[-1]])
            done = upto
            if taken:
                ids = np.concatenate(taken).astype(np.intp)
                upper += np.bincount(ids, np.concatenate(added), n)
                counts += np.bincount(ids, minlength=n)
            still = done < levels
            rest = np.sort(impact[rows[still], done[still]])[::-1]
            gain = np.concatenate([[0.0], np.cumsum(rest)])
            bounds = upper + gain[np.minimum(len(used) - counts, len(rest))]
            if at in (0, 2, 4) and n > 4 * k:  # a higher k-th best score, from the best so far
                best = np.argpartition(np.where(alive, bounds, -np.inf), n - 4 * k)[n - 4 * k:]
                best = best[alive[best]]
                if len(best) >= k:
                    least = max(least, float(np.sort(self.exact(query, best, bound))[-k]))
            alive &= bounds + slack >= least
            if alive.sum() <= max(4 * k, FEW * n):
                break
        members = np.flatnonzero(alive)
        return members, self.exact(query, members, bound)


def best_of(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, nameless rows last."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], nameless[keep], -scores[keep]))][:k]


def n_blocks(n_rows: int, block_rows: int) -> int:
    return max(1, -(-n_rows // block_rows))


def build_index(rows: DataFrame, n_rows: int, block_rows: int = BLOCK_ROWS, levels: int = LEVELS) -> DataFrame:
    """Blocks of (rid, id, vector): one row each, all its arrays as little-endian bytes.

    ``block`` counts partitions from 0; one that holds more rows than a block may gives several rows of the same number.
    """
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("a block holds 1 to 65,536 rows")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, block_rows):
            vectors = matrix(table["vector"].combine_chunks() if table["vector"].num_chunks != 1 else table["vector"].chunk(0))
            parts = indexed(vectors, levels)
            rids = table["rid"].to_numpy()
            ids = table["id"].combine_chunks()
            nameless = np.asarray(ids.is_null())
            columns = {"block": TaskContext.get().partitionId(), "dims": vectors.shape[1], "rids": rids.tobytes(),
                       "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), "nameless": nameless.tobytes(),
                       "vectors": vectors.tobytes(), **{k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()}}
            yield pa.RecordBatch.from_pylist([columns], pa.schema([
                ("block", pa.int64()), ("dims", pa.int32()), *[(c, pa.binary()) for c in list(columns)[2:]]]))

    return rows.repartition(n_blocks(n_rows, block_rows)).mapInArrow(build, INDEX_SCHEMA)


def group_queries(queries: DataFrame, n_queries: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, group_rows):
            vectors = matrix(table["vector"].combine_chunks() if table["vector"].num_chunks != 1 else table["vector"].chunk(0))
            rids = table["rid"].to_numpy()
            yield pa.RecordBatch.from_pylist(
                [{"group": rids[0], "dims": vectors.shape[1], "rids": rids.tobytes(),
                  "ids": table["id"].to_numpy().tobytes(), "vectors": vectors.tobytes()}],
                pa.schema([("group", pa.int64()), ("dims", pa.int32()), ("rids", pa.binary()), ("ids", pa.binary()),
                           ("vectors", pa.binary())]))

    return queries.repartition(max(1, -(-n_queries // group_rows))).mapInArrow(group, GROUP_SCHEMA)


def _search(k: int):
    hits = pa.schema([(c, pa.int64()) for c in ("query_rid", "query_id", "vec_id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, Block] | None = None
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                dims = row["dims"].as_py()
                number = row["rids"].as_buffer()[:8].to_pybytes()

                def array(name: str, kind: type, row: dict = row) -> np.ndarray:
                    return np.frombuffer(row[name].as_buffer(), kind)

                if held is None or held[0] != number:
                    rids = array("rids", np.int64)
                    n = len(rids)
                    held = number, Block(
                        array("vectors", np.int32).reshape(n, dims), array("postings", np.uint16).reshape(dims, n),
                        array("bounds", np.int32).reshape(dims, -1) if dims else np.zeros((0, 2), np.int32),
                        array("high", np.int32).reshape(dims, -1) if dims else np.zeros((0, 1), np.int32),
                        array("low", np.int32).reshape(dims, -1) if dims else np.zeros((0, 1), np.int32))
                    rids, ids, nameless = rids.copy(), array("ids", np.int64).copy(), array("nameless", np.bool_).copy()
                    place = {r: p for p, r in enumerate(rids.tolist())}
                block = held[1]
                q_rids, q_ids = array("q_rids", np.int64), array("q_ids", np.int64)
                q_dims = row["q_dims"].as_py()
                queries = array("q_vectors", np.int32).reshape(len(q_rids), q_dims)
                if q_dims < dims:
                    queries = np.pad(queries, ((0, 0), (0, dims - q_dims)))
                out: list[np.ndarray] = []
                for rid, qid, query in zip(q_rids.tolist(), q_ids.tolist(), queries[:, :dims]):
                    members, scores = block.possible(query, k, -np.inf, place.get(rid, -1))
                    best = best_of(scores, ids[members], nameless[members], k)
                    found = members[best]
                    out.append(np.stack([np.full(len(found), rid), np.full(len(found), qid), ids[found], scores[best],
                                         nameless[found]]))
                table = np.concatenate(out, axis=1) if out else np.empty((5, 0), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table[0]), pa.array(table[1]), pa.array(table[2], mask=table[4].astype(bool)),
                     pa.array(table[3])], schema=hits)

    return search


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, levels: int = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row where ``is_query`` holds (a condition on ``id``)."""
    spark = df.sparkSession
    own = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("vector")).filter(usable(F.col("vector")))
    own = own.select("id", scaled(F.col("vector"), scale, LIMIT).cast("array<int>").alias("vector"))
    own = written(own.withColumn("rid", F.monotonically_increasing_id()), "search-vectors")
    n_rows = own.count()
    index = written(build_index(own, n_rows, block_rows, levels), "search-index")
    queries = own.filter(F.col("id").isNotNull() & is_query)
    n_queries = queries.count()
    groups = written(group_queries(queries, n_queries, group_rows), "search-queries")
    blocks_in_all = n_blocks(n_rows, block_rows)
    lanes = max(1, min(-(-n_queries // group_rows), -(-4 * spark.sparkContext.defaultParallelism // blocks_in_all)))
    parts = blocks_in_all * lanes
    by_block = groups.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_in_all - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("group"), F.lit(lanes)).cast("long").alias("lane"), F.col("dims").alias("q_dims"), F.col("rids").alias("q_rids"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    blocks = index.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    pairs = by_block.repartition(parts, "block", "lane").join(blocks.repartition(parts, "block", "lane"), ["block", "lane"])
    with batches_of(spark, 1):
        hits = written(pairs.mapInArrow(_search(k), HIT_SCHEMA), "search-hits")
    best = Window.partitionBy("query_rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
