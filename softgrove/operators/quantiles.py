"""Exact quantiles and summaries per group, by radix selection over counted values.

The bits of a double, with those of negative numbers turned over, are in the
order of the numbers. Equal values are counted first. Then the position wanted is
found 16 bits at a time: counts per group, bits found so far and next 16 bits are
summed up in a window of at most 65,536 rows, and the digit that holds the
position joins the bits found. So the work is the same for any distribution and
any number of rows, and no task holds a group. Up to a million counted values in
all, one window by group is as bounded and does without the passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.operators.joins import null_safe_join
from softgrove.session import stored

DIGIT_BITS = 16
#: Counted values up to which one window is small enough for any group.
DIRECT_ROWS = 1_000_000


@F.arrow_udf(T.LongType())
def ordered_bits(values: pa.Array) -> pa.Array:
    """A whole number for each double, in the same order; both zeros are one, NaN is the largest."""
    v = values.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(v), np.float64("nan"), v).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
    return pa.array(np.where(np.isnan(v), np.int64(2**63 - 1), bits))


def _positions(sizes: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, at, rest): the 1-based positions around each quantile of each group."""
    wanted = []
    for k, p in enumerate(probs.values()):
        h = (F.col("__n") - 1) * F.lit(p)
        low = F.floor(h) + 1
        wanted += [F.struct(F.lit(2 * k).alias("at"), low.alias("rest")),
                   F.struct(F.lit(2 * k + 1).alias("at"), F.least(low + 1, F.col("__n")).alias("rest"))]
    return sizes.select(*keys, F.inline(F.array(*wanted)))


def _found(counts: DataFrame, targets: DataFrame, group: list[str], order: str) -> DataFrame:
    """Targets with the row of ``counts`` (group, order, c, v) that holds their position, and the rest inside it."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("__upto", F.sum("c").over(upto))
    joined = null_safe_join(targets, running, group)
    return joined.filter("__upto - c < rest AND rest <= __upto").withColumn("rest", F.expr("rest - (__upto - c)"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Linearly interpolated quantiles per group that has a value."""
    keys = list(keys) or ["__all"]
    own = df if "__all" not in keys else df.withColumn("__all", F.lit(0))
    counted = own.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counted = stored(counted, "counted-values")
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("__n"))
    if counted.count() <= direct_rows:
        found = _found(counted, _positions(sizes, keys, probs), keys, "v")
    else:
        sizes = stored(sizes, "sizes")
        targets = _positions(sizes, keys, probs)
        coded = stored(counted.withColumn("b", ordered_bits(F.col("v").cast("double"))), "coded-values")
        targets = targets.withColumn("prefix", F.lit(0).cast("long"))
        for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
            top = shift == 64 - DIGIT_BITS
            prefix = F.lit(0).cast("long") if top else F.shiftright("b", shift + DIGIT_BITS)
            rows = coded.select(*keys, prefix.alias("prefix"), "v", "c", F.shiftright("b", shift).alias("digit"))
            if not top:
                rows = null_safe_join(rows, targets.select(*keys, "prefix").distinct(), [*keys, "prefix"])
            counts = rows.groupBy(*keys, "prefix", "digit").agg(F.sum("c").alias("c"), F.min("v").alias("v"))
            found = _found(counts, targets, [*keys, "prefix"], "digit")
            targets = stored(found.select(*keys, "at", "rest", F.col("digit").alias("prefix"), "v"), "digits")
            if shift:
                targets = targets.drop("v")
        found = targets
    at = found.groupBy(*keys).agg(*[F.max(F.when(F.col("at") == i, F.col("v"))).alias(f"__v{i}") for i in range(2 * len(probs))])
    out = null_safe_join(at, sizes, keys)

    def between(k: int, p: float) -> Column:
        h = (F.col("__n") - 1) * F.lit(p)
        part, low = h - F.floor(h), F.col(f"__v{2 * k}")
        return F.when(part == 0, low).otherwise(low + (F.col(f"__v{2 * k + 1}") - low) * part)

    own_keys = [k for k in keys if k != "__all"]
    return out.select(*own_keys, *[between(k, p).alias(n) for k, (n, p) in enumerate(probs.items())])


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max per group; a group without values has NULL statistics."""
    v = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                  F.min(v).alias("min"), F.max(v).alias("max"))
    return null_safe_join(plain, exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), keys, "left")
