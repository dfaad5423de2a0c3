"""Optimal one-dimensional clusters: least sum of squares over all ways to cut the ordered values.

Values are counted by Spark first, so a frequent value is one row, and each
feature's counted values are one task. A prefix of the values in k clusters costs
the best prefix in k - 1 plus the last cluster; the best place of the last cut
never moves back as the prefix grows, so each layer is filled by halving: the
middle prefix is solved, and its cut bounds those on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.functions.sqltext import clean_number

CLUSTER_SCHEMA = "fi int, centroids array<double>, sse double"


class Intervals:
    """Sum of squares of the counted values i..j around their mean, from prefix sums of centred values."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.shift = np.average(values, weights=counts)
        v = values - self.shift
        self.n, self.s, self.q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (counts, counts * v, counts * v * v))

    def cost(self, first, end):
        n, s, q = (x[end] - x[first] for x in (self.n, self.s, self.q))
        return np.maximum(0.0, q - s * s / n)

    def mean(self, first: int, end: int) -> float:
        return float(self.shift + (self.s[end] - self.s[first]) / (self.n[end] - self.n[first]))


def optimal_cuts(values: np.ndarray, counts: np.ndarray, k: int) -> tuple[list[int], float]:
    """Ends of the ``k`` clusters of rising values, and their sum of squares; the leftmost cuts on ties."""
    inside, n = Intervals(values, counts), len(values)
    best = inside.cost(np.zeros(n, int), np.arange(1, n + 1))  # by last value
    cuts = []
    for layer in range(1, k):
        cost, cut = np.full(n, np.inf), np.zeros(n, int)
        todo = [(layer, n - 1, layer, n - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            starts = np.arange(left, min(middle, right) + 1)  # first value of the last cluster
            tried = best[starts - 1] + inside.cost(starts, middle + 1)
            at = int(np.argmin(tried))
            cost[middle], cut[middle] = tried[at], starts[at]
            todo += [(low, middle - 1, left, cut[middle]), (middle + 1, high, cut[middle], right)]
        best = cost
        cuts.append(cut)
    ends, end = [], n
    for cut in reversed(cuts):
        ends.append(end)
        end = int(cut[end - 1])
    return [end, *reversed(ends)], float(best[-1])


def optimal_clusters(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(fi, centroids, sse) of every feature with a value; fewer centroids if it has fewer different values.

    The caller knows that each feature has few distinct values: they are sorted in one task.
    """
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        values, counts = group["v"].to_numpy(), group["n"].to_numpy().astype(float)
        ends, sse = optimal_cuts(values, counts, min(k, len(values)))
        inside = Intervals(values, counts)
        centroids = [inside.mean(a, b) for a, b in zip([0, *ends], ends)]
        return pd.DataFrame({"fi": [key[0]], "centroids": [centroids], "sse": [sse]})

    values = ", ".join(clean_number(f) for f in features)
    counted = df.selectExpr(f"posexplode(array({values})) AS (fi, v)").where("v IS NOT NULL").groupBy("fi", "v").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.groupBy("fi").applyInPandas(run, CLUSTER_SCHEMA)


def quantile_starts(df: DataFrame, features: Sequence[str], k: int) -> dict[str, list[float]]:
    """Start centroids at the middles of ``k`` runs of equally many rows, from one sketch each."""
    middles = ", ".join(f"{(j + 0.5) / k!r}D" for j in range(k))
    row = df.selectExpr(*[f"percentile_approx({clean_number(f)}, array({middles}), 10000) AS q{i}"
                          for i, f in enumerate(features)]).first()
    return {f: [float(c) for c in row[f"q{i}"] or [0.0] * k] for i, f in enumerate(features)}
