"""Impurity, gain and leaf statistics per group, for any number of labels.

Everything follows from one count per (group, label), combined map-side, so a
group that holds most rows shuffles no more than its labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def _impurity_agg(mass: str, criterion: str) -> Column:
    """Impurity of the masses in a column, one row per label; NULL without any mass."""
    c, n = F.col(mass).cast("double"), F.sum(F.col(mass)).cast("double")
    if criterion == "gini":
        return F.lit(1.0) - F.try_divide(F.sum(c * c), n * n)
    if criterion == "entropy":
        return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - F.try_divide(F.sum(_xlogx(c)), n)))
    raise ValueError(f"unknown criterion {criterion}")


def class_impurity(df: DataFrame, group: Sequence[str], label: str, criterion: str, mass: Column | None = None,
                   out: str = "impurity") -> DataFrame:
    """Gini or entropy of the labels per group, by rows or by membership mass."""
    weight = F.count(F.lit(1)) if mass is None else F.sum(mass)
    per_label = df.groupBy(*group, label).agg(weight.alias("__c"))
    return per_label.groupBy(*group).agg(_impurity_agg("__c", criterion).alias(out))


def binary_gain(df: DataFrame, group: Sequence[str], label: str, test: Column, criterion: str,
                mass: Column | None = None, out: str = "gain") -> DataFrame:
    """Impurity gain of one binary split per group.

    With ``mass`` the sides are weighted by membership while the group itself
    stays crisp; a group without membership falls back to the crisp gain.
    """
    hit = F.coalesce(test, F.lit(False))
    one = F.lit(1.0)
    aggs = [F.count(F.lit(1)).alias("__n"), F.sum(F.when(hit, one).otherwise(0.0)).alias("__h"),
            F.sum(F.when(hit, 0.0).otherwise(one)).alias("__r")]
    if mass is not None:
        aggs += [F.sum(F.when(hit, mass).otherwise(0.0)).alias("__mh"),
                 F.sum(F.when(hit, F.lit(0.0)).otherwise(mass)).alias("__mr")]
    per_label = df.groupBy(*group, label).agg(*aggs)

    def weighted(h: str, r: str) -> Column:
        whole = F.sum(F.col(h) + F.col(r))
        return (F.try_divide(F.sum(h), whole) * _impurity_agg(h, criterion)
                + F.try_divide(F.sum(r), whole) * _impurity_agg(r, criterion))

    crisp = _impurity_agg("__n", criterion) - weighted("__h", "__r")
    if mass is None:
        return per_label.groupBy(*group).agg(crisp.alias(out))
    soft = _impurity_agg("__n", criterion) - weighted("__mh", "__mr")
    return per_label.groupBy(*group).agg(
        F.when(F.sum(F.col("__mh") + F.col("__mr")) > 0, soft).otherwise(crisp).alias(out))


def binary_gain_ratio(df: DataFrame, group: Sequence[str], label: str, feature: str, test: Column,
                      criterion: str = "entropy", out: str = "gain_ratio") -> DataFrame:
    """Gain of a binary split over the impurity of the split feature's own values."""
    gain = binary_gain(df, group, label, test, criterion, out="__gain")
    own = class_impurity(df, group, feature, criterion, out="__own")
    return gain.join(own, list(group)).select(*group, F.try_divide("__gain", "__own").alias(out))


def value_reduction(df: DataFrame, group: Sequence[str], targets: Sequence[str], test: Column,
                    criterion: str = "variance", mass: Column | None = None, out: str = "gain") -> DataFrame:
    """Reduction of variance (or standard deviation) by one binary split, summed over targets."""
    spread = {"variance": F.var_pop, "stddev": F.stddev_pop}[criterion]
    hit = F.coalesce(test, F.lit(False))
    weight = F.lit(1.0) if mass is None else mass
    n_hit, n_all = F.sum(F.when(hit, weight).otherwise(0.0)), F.sum(weight)
    c_hit, c_all = F.sum(F.when(hit, 1.0).otherwise(0.0)), F.count(F.lit(1))
    share = F.when(n_all > 0, n_hit / n_all).otherwise(c_hit / c_all)
    gain: Column | None = None
    for t in targets:
        y = F.col(t).cast("double")
        part = (spread(y) - share * F.coalesce(spread(F.when(hit, y)), F.lit(0.0))
                - (F.lit(1.0) - share) * F.coalesce(spread(F.when(~hit, y)), F.lit(0.0)))
        gain = part if gain is None else gain + part
    return df.groupBy(*group).agg(gain.alias(out))


def majority_label(df: DataFrame, group: Sequence[str], label: str, out: str = "label", total: str | None = None) -> DataFrame:
    """Most frequent label per group, the smallest one on ties; ``total`` names a column with the rows of the group."""
    counted = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("__n"))
    sums = [F.sum("__n").alias(total)] if total else []
    return counted.groupBy(*group).agg(
        F.min_by(F.col(label), F.struct((-F.col("__n")).alias("n"), F.col(label))).alias(out), *sums)


def label_shares(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """``leaf_labels`` and ``leaf_proba`` per group, ascending by label, only labels present."""
    counted = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("__n"))
    sorted_pairs = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("__n").alias("n"))))
    return counted.groupBy(*group).agg(sorted_pairs.alias("__p"), F.sum("__n").alias("__t")).select(
        *group, F.transform("__p", lambda s: s["l"]).alias("leaf_labels"),
        F.transform("__p", lambda s: s["n"] / F.col("__t")).alias("leaf_proba"))


def mean_vector(df: DataFrame, group: Sequence[str], vector: str, out: str = "leaf_mean") -> DataFrame:
    """Element-wise mean of equally long arrays per group."""
    parts = df.select(*group, F.posexplode(vector).alias("__i", "__v"))
    means = parts.groupBy(*group, "__i").agg(F.avg("__v").alias("__m"))
    pairs = F.array_sort(F.collect_list(F.struct("__i", "__m")))
    return means.groupBy(*group).agg(F.transform(pairs, lambda s: s["__m"]).alias(out))
