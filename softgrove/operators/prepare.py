"""Table preparation: global scaling and ordinal encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.ranks import value_rank
from softgrove.session import cut_lineage

# Codes of a column up to which its encoding is broadcast to the table it is applied to.
BROADCAST_CODES = 200_000


def global_minmax_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale all features with the one minimum and maximum of the whole matrix."""
    x = [F.col(f).cast("double") for f in features]
    lows, highs = [F.min(c) for c in x], [F.max(c) for c in x]
    bounds = df.agg((F.least(*lows) if len(x) > 1 else lows[0]).alias("lo"),
                    (F.greatest(*highs) if len(x) > 1 else highs[0]).alias("hi")).first()
    if bounds["lo"] is None:
        return df
    low, span = F.lit(bounds["lo"]), F.lit(bounds["hi"] - bounds["lo"])
    return df.withColumns({f: F.try_divide(c - low, span) for f, c in zip(features, x)})


def first_seen_codes(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """``feature, value, code``: codes 0, 1, .. by first appearance in the order of a unique number."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    firsts = (
        df.select(F.col(order).alias("__o"), F.inline(pairs))
        .groupBy("feature", "value").agg(F.min("__o").alias("__first"))
    )
    return value_rank(firsts, "__first", ["feature"], "__rank").select(
        "feature", "value", (F.col("__rank") - 1).cast("int").alias("code"))


def encode_first_seen(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Replace every value by its first-appearance code."""
    cached = first_seen_codes(df, columns, order).persist()
    codes = cut_lineage(cached)
    cached.unpersist()
    sizes = {r["feature"]: r["count"] for r in codes.groupBy("feature").count().collect()}  # a row per column
    out = df
    for c in columns:
        mine = codes.filter(F.col("feature") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code"))
        mine = F.broadcast(mine) if sizes.get(c, 0) <= BROADCAST_CODES else mine
        out = out.join(mine, F.col(c).cast("string").eqNullSafe(F.col("__v")), "left") \
            .withColumn(c, F.col("__code")).drop("__v", "__code")
    return out
