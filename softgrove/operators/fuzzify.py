"""Fit fuzzy sets per feature (1-D k-means) and turn values into memberships."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from softgrove.functions.membership import ZERO_DISTANCE, logit_slope, membership_array, membership_mass, widths
from softgrove.functions.sqltext import clean_number, num
from softgrove.operators.clusters import optimal_clusters, quantile_starts

# Distinct values of a feature up to which its k-means runs on their counts in one task.
COUNTED_VALUES = 65_536
SET_SCHEMA = "feature_idx int, feature string, set_id int, centroid double, theta double"


def value_spread(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float, int]]:
    """Minimum, maximum, variance and rough number of distinct values of every feature, in one scan."""
    values = ", ".join(clean_number(f) for f in features)
    found = df.selectExpr(f"posexplode(array({values})) AS (fi, v)").groupBy("fi").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_pop("v").alias("var"),
        F.approx_count_distinct("v").alias("d")).collect()
    by = {features[r["fi"]]: (r["lo"] or 0.0, r["hi"] or 0.0, r["var"] or 0.0, r["d"]) for r in found}
    return {f: by.get(f, (0.0, 0.0, 0.0, 0)) for f in features}


def start_centroids(lo: float, hi: float, n_sets: int) -> list[float]:
    """``n_sets`` centroids evenly spaced over a value range."""
    return [lo + (j + 0.5) / n_sets * (hi - lo) for j in range(n_sets)]


def lloyd_step(df: DataFrame, centroids: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """One k-means step of all features in one scan: the shuffle carries one row per
    (task, feature, set). A value goes to the nearest centroid, the lower one on
    ties; an emptied set keeps its centroid.

    Set borders sit in an array literal, so every step runs the same compiled code.
    """
    feats = list(centroids)
    borders = ", ".join(
        "array(" + ", ".join(num((a + b) / 2.0) for a, b in zip(centroids[f], centroids[f][1:])) + ")" for f in feats)
    n_borders = len(centroids[feats[0]]) - 1
    nearest = " + ".join(f"if(v > get(b, {j}), 1, 0)" for j in range(n_borders)) or "0"
    values = ", ".join(clean_number(f) for f in feats)
    found = (
        df.selectExpr(f"posexplode(array({values})) AS (fi, v)").where("v IS NOT NULL")
        .selectExpr("fi", "v", f"get(array({borders}), fi) AS b")
        .groupBy("fi", F.expr(f"{nearest} AS set_id")).agg(F.avg("v").alias("c")).collect()
    )
    moved = {f: list(c) for f, c in centroids.items()}
    for r in found:
        moved[feats[r["fi"]]][r["set_id"]] = r["c"]
    return moved


def settled(before: Sequence[float], after: Sequence[float], variance: float, tol: float) -> bool:
    """Squared moves of the centroids add up to at most ``tol`` of the variance."""
    return sum((a - b) ** 2 for a, b in zip(before, after)) <= tol * variance


def lloyd_on_counts(df: DataFrame, starts: Mapping[str, Sequence[float]], variances: Mapping[str, float],
                    max_iter: int, tol: float) -> dict[str, list[float]]:
    """All k-means steps of a feature in one task, over its counted distinct values.

    Only for features whose number of distinct values is known to be small; the
    table itself is counted with map-side combining before.
    """
    feats = list(starts)
    values = ", ".join(clean_number(f) for f in feats)
    first = [list(starts[f]) for f in feats]
    spread = [variances[f] for f in feats]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        v, n = group["v"].to_numpy(), group["n"].to_numpy().astype(float)
        mass, weight = np.concatenate([[0.0], np.cumsum(v * n)]), np.concatenate([[0.0], np.cumsum(n)])
        c = np.array(first[key[0]])
        for _ in range(max_iter):
            cut = np.concatenate([[0], np.searchsorted(v, (c[:-1] + c[1:]) / 2.0, side="right"), [len(v)]])
            count = weight[cut[1:]] - weight[cut[:-1]]
            moved = np.where(count > 0, (mass[cut[1:]] - mass[cut[:-1]]) / np.maximum(count, 1.0), c)
            done = settled(c, moved, spread[key[0]], tol)
            c = moved
            if done:
                break
        return pd.DataFrame({"fi": key[0], "c": [c.tolist()]})

    found = (
        df.selectExpr(f"posexplode(array({values})) AS (fi, v)").where("v IS NOT NULL")
        .groupBy("fi", "v").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("fi").applyInPandas(run, "fi int, c array<double>").collect()
    )
    out = {f: list(c) for f, c in starts.items()}
    out.update({feats[r["fi"]]: list(r["c"]) for r in found})
    return out


@dataclass(frozen=True)
class FuzzySets:
    """Fitted fuzzy sets: feature -> ((centroid, width), ...), usable on new rows."""

    sets: Mapping[str, tuple[tuple[float, float], ...]]

    @staticmethod
    def from_centroids(centroids: Mapping[str, Sequence[float]]) -> FuzzySets:
        return FuzzySets({f: tuple(zip(c, widths(c))) for f, c in centroids.items()})

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], n_sets: int = 5, max_iter: int = 300, tol: float = 1e-4,
            cache: bool = True, method: str = "lloyd") -> FuzzySets:
        """k-means of every feature by itself.

        ``method`` "lloyd" starts from evenly spaced centroids. "optimal" gives the least sum of squares for
        features with few distinct values (fewer sets than asked for if there are fewer values), and starts
        the others from quantiles.

        Features with few distinct values are counted once and settled on the counts;
        the others take one scan of the table per step, all together.

        Stops after ``max_iter`` steps, or when the squared moves of the centroids of
        every feature add up to at most ``tol`` of its variance.
        """
        data = df.select(*[F.col(f).cast("double").alias(f) for f in features])
        if cache:
            data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            spread = value_spread(data, features)
            centroids = {f: start_centroids(s[0], s[1], n_sets) for f, s in spread.items()}
            variances = {f: s[2] for f, s in spread.items()}
            few = [f for f in features if spread[f][3] <= COUNTED_VALUES]
            wide = [f for f in features if f not in few]
            if method == "optimal":
                if wide:
                    centroids.update(quantile_starts(data, wide, n_sets))
                if few:
                    centroids.update({few[r["fi"]]: list(r["centroids"]) for r in optimal_clusters(data, few, n_sets).collect()})
            elif few:
                centroids.update(lloyd_on_counts(data, {f: centroids[f] for f in few}, variances, max_iter, tol))
            moving = wide
            for _ in range(max_iter):
                if not moving:
                    break
                moved = lloyd_step(data, {f: centroids[f] for f in moving})
                rest = [f for f in moving if not settled(centroids[f], moved[f], variances[f], tol)]
                centroids.update(moved)
                moving = rest
            return FuzzySets.from_centroids(centroids)
        finally:
            if cache:
                data.unpersist()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, f, j, float(c), float(t)) for i, (f, s) in enumerate(self.sets.items())
             for j, (c, t) in enumerate(s)], SET_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> FuzzySets:
        out: dict[str, list] = {}
        for r in table.orderBy("feature_idx", "set_id").collect():
            out.setdefault(r["feature"], []).append((r["centroid"], r["theta"]))
        return FuzzySets({f: tuple(s) for f, s in out.items()})

    def transform(self, df: DataFrame, reg: float = 0.0, logit: bool = False) -> DataFrame:
        """Add ``dm_<feature>`` (one membership per set) and ``m_<feature>`` (their sum).

        ``reg`` matters only with ``logit``: it steepens the slopes.
        """
        slope = logit_slope(reg) if logit else 1.0
        cols = {}
        for f, s in self.sets.items():
            cols[f"dm_{f}"] = membership_array(f, s, slope)
            cols[f"m_{f}"] = membership_mass(f, s, slope)
        return df.withColumns(cols)

    def flatten(self, df: DataFrame) -> DataFrame:
        """Add every single membership as an ordinary column ``dm_<feature>_<set>``."""
        return df.withColumns({
            f"dm_{f}_{j}": membership_array(f, [s[j]])[0]
            for f, s in self.sets.items() for j in range(len(s))})

    def flat_names(self) -> list[str]:
        return [f"dm_{f}_{j}" for f, s in self.sets.items() for j in range(len(s))]


def theta_table(sets: DataFrame) -> DataFrame:
    """Widths from a table of centroids (``feature, set_id, centroid``): one array per
    feature, so no pairs are joined; the arrays have ``n_sets`` elements."""
    all_of = F.sort_array(F.collect_list("centroid").over(Window.partitionBy("feature")))
    gap = F.transform(F.col("__c"), lambda o: F.when(F.abs(F.col("centroid") - o) == 0, F.lit(ZERO_DISTANCE))
                      .otherwise(F.abs(F.col("centroid") - o)))
    return sets.withColumn("__c", all_of).withColumn("theta", F.array_min(gap)).drop("__c")
