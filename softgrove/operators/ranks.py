"""Ranks, running totals and hash thresholds over whole tables without one task seeing them all.

Rows are counted per order bucket, the bucket counts are summed up to offsets,
and rows are numbered inside their bucket only. Where only the rows before a cut
are wanted, just the buckets that hold a cut are ranked, and all other rows are
compared with the hash found there, without any shuffle of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softgrove.operators.joins import null_safe_join

BUCKET_ROWS = 65_536
BUCKET_GROUP = 128  # numbered buckets that are summed up together
MAX_CUTS = 9_999  # points of one sketch
# Buckets with a cut up to which they are sent along with the scan; more are joined by shuffle.
BROADCAST_CUTS = 200_000
# Digit counts that a pass of radix selection may bring to the driver.
RADIX_COUNTS = 1 << 17


def _offsets(df: DataFrame, keys: Sequence[str], bucket: str, weight) -> DataFrame:
    """Total ``weight`` of the buckets before each bucket (``__before``) and in it (``__n``).

    Summed in two steps, over groups of buckets and inside them, so that no window holds all buckets of a group.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("__n"))
    if dict(sizes.dtypes)[bucket] == "string":
        part = F.col(bucket).substr(F.lit(1), F.floor(F.length(bucket) / 2).cast("int"))
    else:
        part = F.floor(F.col(bucket) / BUCKET_GROUP)
    sizes = sizes.withColumn("__part", part)

    def before(name: str, group: Sequence[str], order: str):
        window = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    parts = sizes.groupBy(*keys, "__part").agg(F.sum("__n").alias("__sum"))
    parts = parts.withColumn("__first", before("__sum", keys, "__part")).drop("__sum")
    inside = sizes.withColumn("__inside", before("__n", [*keys, "__part"], bucket))
    both = null_safe_join(inside, parts, [*keys, "__part"])
    return both.withColumn("__before", F.col("__first") + F.col("__inside")).select(*keys, bucket, "__n", "__before")


def _number_in_buckets(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], out: str) -> DataFrame:
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    offsets = _offsets(df, keys, bucket, F.lit(1)).drop("__n")
    numbered = null_safe_join(df, offsets, [*keys, bucket]).withColumn(out, F.col("__before") + F.row_number().over(inside))
    return numbered.drop("__before", bucket)


def hash_digits(size: int) -> int:
    """Hex digits of a hash that part ``size`` rows into buckets of about BUCKET_ROWS rows."""
    digits = 2
    while digits < 7 and size > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def hash_rank(df: DataFrame, hashed: str, keys: Sequence[str] = (), ties: Sequence[str] = (), out: str = "rank",
              size: int = 0) -> DataFrame:
    """Position (1-based) of every row in the order of a hex hash, per group of ``keys``.

    ``size`` is the number of rows of the largest group (or a bound); it sets how
    many buckets are made, so that a bucket stays small however long the table is.

    A hash spreads its rows evenly over its own prefixes, so buckets stay equal
    even when one group holds most rows.
    """
    bucketed = df.withColumn("__bucket", F.substring(hashed, 1, hash_digits(size)))
    return _number_in_buckets(bucketed, list(keys), "__bucket", [hashed, *ties], out)


def hash_thresholds(df: DataFrame, hashed: str, cuts: DataFrame, keys: Sequence[str] = (), size: int = 0) -> DataFrame:
    """``cuts`` (keys, position, ...) with ``threshold``, the hash at that 1-based position of the group.

    Positions beyond the group are left out. ``hashed`` is distinct within a group.
    Rows are counted per hash prefix; only those in a bucket with a cut are ranked.
    """
    if not keys:
        one = F.lit(0).alias("__all")
        return hash_thresholds(df.select("*", one), hashed, cuts.select("*", one), ["__all"], size).drop("__all")
    keys = list(keys)
    bucketed = df.select(*keys, hashed, F.substring(hashed, 1, hash_digits(size)).alias("__bucket"))
    offsets = _offsets(bucketed, keys, "__bucket", F.lit(1))
    wanted = null_safe_join(offsets, cuts, keys).filter("__before < position AND position <= __before + __n").drop("__n").persist()
    try:
        n = wanted.count()
        buckets = wanted.select(*keys, "__bucket").distinct()
        inside = null_safe_join(bucketed, F.broadcast(buckets) if n <= BROADCAST_CUTS else buckets, [*keys, "__bucket"])
        rank = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(hashed))
        ranked = inside.withColumn("__rank", rank).withColumnRenamed(hashed, "threshold")
        found = null_safe_join(wanted.withColumn("__rank", F.col("position") - F.col("__before")), ranked,
                               [*keys, "__bucket", "__rank"])
        found = found.drop("__bucket", "__rank", "__before")
        if n <= BROADCAST_CUTS:
            return df.sparkSession.createDataFrame(found.collect(), found.schema)  # at most BROADCAST_CUTS rows
        return found
    finally:
        wanted.unpersist()


def radix_thresholds(df: DataFrame, hashed: str, group: str, positions: Mapping[int, Sequence[int]]) -> dict[tuple[int, int], str]:
    """``{(group, position): hash at that 1-based position of the group}`` for a few groups and positions.

    Radix selection: rows are counted by the next hex digits of their hash, only among those that agree with the
    digits found so far; what comes to the driver are counts of digits, whose number does not depend on the rows.
    Each pass is one aggregation without a window or a sort. Positions beyond the group are left out.
    """
    spark = df.sparkSession
    todo = [(g, p, "", p) for g, ps in positions.items() for p in ps]
    out: dict[tuple[int, int], str] = {}
    while todo:
        places = sorted({(g, prefix) for g, _, prefix, _ in todo})
        length = len(todo[0][2])
        more = 1
        while more < 6 and len(places) * 16 ** (more + 1) <= RADIX_COUNTS:
            more += 1
        rows = df.select(F.col(group).cast("int").alias("g"), F.col(hashed).alias("h"))
        if length:
            wanted = spark.createDataFrame(places, "g int, prefix string")
            rows = rows.withColumn("prefix", F.substring("h", 1, length)).join(F.broadcast(wanted), ["g", "prefix"], "left_semi")
        counted = rows.groupBy("g", F.substring("h", 1, length + more).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()  # at most RADIX_COUNTS rows, or 16 by place
        found: dict[tuple[int, str], list] = {}
        for r in sorted(counted, key=lambda r: r["p"]):
            found.setdefault((r["g"], r["p"][:length]), []).append(r)
        left = []
        for g, position, prefix, rest in todo:
            for r in found.get((g, prefix), []):
                if rest <= r["n"]:
                    if r["n"] == 1:
                        out[g, position] = r["least"]
                    else:
                        left.append((g, position, r["p"], rest))
                    break
                rest -= r["n"]
        if left and length + more >= 32:
            out.update({(g, position): prefix for g, position, prefix, _ in left})  # equal hashes
            left = []
        todo = left
    return out


def value_buckets(df: DataFrame, value: str, out: str, n_rows: int) -> DataFrame:
    """Adds ``out``: buckets of about BUCKET_ROWS rows in the order of a number (NaN last). Edges come from a sketch."""
    staged = df.withColumn("__v", F.col(value).cast("double"))
    n_buckets = min(MAX_CUTS + 1, -(-n_rows // BUCKET_ROWS))
    if n_buckets < 2:
        return staged.withColumn(out, F.lit(0.0)).drop("__v")
    cuts = staged.agg(F.percentile_approx("__v", [j / n_buckets for j in range(1, n_buckets)], 10 * n_buckets)
                      .alias("c")).first()["c"]
    inf = float("inf")
    edges = [-inf, *sorted({float(c) for c in cuts or [] if -inf < c < inf}), inf]
    return Bucketizer(splits=edges, inputCol="__v", outputCol=out, handleInvalid="keep").transform(staged).drop("__v")


def value_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Position (1-based) in the order of a numeric column with distinct values."""
    return _number_in_buckets(value_buckets(df, value, "__bucket", df.count()), list(keys), "__bucket", [value], out)
