"""Optimal cuts against all cuts."""

import itertools
import random

import numpy as np
import pytest

from softgrove.operators import fuzzify
from softgrove.operators.clusters import Intervals, optimal_cuts
from softgrove.operators.fuzzify import FuzzySets


@pytest.mark.parametrize("seed", range(8))
def test_best_of_all_cuts(seed):
    rng = random.Random(seed)
    values = np.array(sorted(rng.sample(range(1000), rng.randrange(1, 12))), float)
    counts = np.array([rng.randrange(1, 9) for _ in values], float)
    inside = Intervals(values, counts)
    for k in range(1, min(5, len(values)) + 1):
        ends, sse = optimal_cuts(values, counts, k)
        tried = []
        for cuts in itertools.combinations(range(1, len(values)), k - 1):
            edges = [0, *cuts, len(values)]
            parts = [(values[a:b], counts[a:b]) for a, b in zip(edges, edges[1:])]
            tried.append(sum(float((n * (v - np.average(v, weights=n)) ** 2).sum()) for v, n in parts))
        assert sse == pytest.approx(min(tried), abs=1e-6)
        assert ends[-1] == len(values) and len(ends) == k and ends == sorted(set(ends))
        assert sum(inside.cost(a, b) for a, b in zip([0, *ends], ends)) == pytest.approx(sse, abs=1e-6)


def test_sets_by_the_optimal_method(spark, monkeypatch):
    rows = [(float(k % 3) * 10 + (k % 2), 5.0, None, rng) for k, rng in ((k, float(random.Random(k).gauss(0, 9))) for k in range(200))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    sets = FuzzySets.fit(df, ["a", "b", "c", "d"], 3, method="optimal").sets
    assert [c for c, _ in sets["a"]] == pytest.approx([0.5, 10.5, 20.5], abs=0.02)
    assert [c for c, _ in sets["b"]] == [5.0] and len(sets["c"]) == len(sets["d"]) == 3
    monkeypatch.setattr(fuzzify, "COUNTED_VALUES", 50)
    wide = FuzzySets.fit(df, ["a", "d"], 3, method="optimal").sets  # d: quantile start, then scans

    def squares(centroids):
        return sum(min((r[3] - c) ** 2 for c, _ in centroids) for r in rows)

    assert squares(sets["d"]) <= squares(wide["d"]) <= 1.1 * squares(sets["d"])
