"""Multiway splits on discrete features: information gain and gain ratio
(Quinlan, Induction of Decision Trees, 1986; C4.5, 1993)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def discrete_counts(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """``keys, fi, value, label, n``: one row per distinct value and label."""
    pairs = F.array(*[F.struct(F.lit(i).alias("fi"), F.col(f).cast("string").alias("value"))
                      for i, f in enumerate(features)])
    long = df.select(*keys, F.col(label).alias("label"), F.inline(pairs))
    return long.groupBy(*keys, "fi", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def feature_scores(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Information gain, split information and gain ratio of every feature.

    Works on counts alone: H = log2 N - sum(c log2 c) / N at every level.
    """
    group = [*keys, "fi"]
    per_value = counts.groupBy(*group, "value").agg(F.sum("n").alias("nv"), F.sum(_xlogx(F.col("n"))).alias("cl"))
    values = per_value.groupBy(*group).agg(
        F.sum("nv").alias("n"), F.count(F.lit(1)).alias("n_values"),
        F.sum(_xlogx(F.col("nv")) - F.col("cl")).alias("inside"), F.sum(_xlogx(F.col("nv"))).alias("vl"))
    labels = (
        counts.groupBy(*group, "label").agg(F.sum("n").alias("nl"))
        .groupBy(*group).agg(F.sum(_xlogx(F.col("nl"))).alias("ll"), F.count(F.lit(1)).alias("n_labels"))
    )
    n = F.col("n")
    gain = F.log2(n) - F.col("ll") / n - F.col("inside") / n
    info = F.log2(n) - F.col("vl") / n
    return values.join(labels, group).select(
        *group, "n", "n_values", "n_labels", gain.alias("gain"), info.alias("split_info"),
        F.when(F.col("n_values") > 1, F.try_divide(gain, info)).alias("gain_ratio"))
