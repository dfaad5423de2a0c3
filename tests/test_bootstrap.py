"""Exact bootstrap weights from Poisson draws with a surplus."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from softgrove.functions.draws import poisson_steps
from softgrove.operators.sampling import bootstrap_array, bootstrap_weights


def test_any_number_of_draws(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    for n_rows in (1, 7, 40, 2000):  # the last mean is a sum of several draws
        sums = bootstrap_weights(df, ["k"], 3, n_rows, seed=4).groupBy("subset").agg(F.sum("w").alias("s"), F.min("w").alias("m"))
        assert sorted(r["subset"] for r in sums.collect()) == [0, 1, 2]
        assert all(r["s"] == n_rows and r["m"] >= 1 for r in sums.collect())


def test_degenerate_tables(spark):
    one = spark.createDataFrame([(5, "a")], "k int, mw string")
    assert [tuple(r) for r in bootstrap_weights(one, ["k"], 2, seed=1).orderBy("subset").collect()] == [(5, 0, 1), (5, 1, 1)]
    empty = bootstrap_weights(one.filter("k < 0"), ["k"], 2)
    assert empty.columns == ["k", "subset", "w"] and empty.count() == 0
    assert bootstrap_weights(one, ["k"], 2, 0).count() == 0


def test_keys_with_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(30)] + [(None, "x"), (None, None)], "a int, b string")
    weights = bootstrap_weights(df, ["a", "b"], 2, seed=3)
    assert [r["s"] for r in weights.groupBy("subset").agg(F.sum("w").alias("s")).collect()] == [32, 32]


def test_weights_are_those_of_uniform_draws(spark):
    n, subsets = 400, 50
    df = spark.range(n).withColumnRenamed("id", "k")
    found = {r["w"]: r["n"] for r in bootstrap_weights(df, ["k"], subsets, seed=9).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    found[0] = n * subsets - sum(found.values())
    for w in range(4):
        expected = n * subsets * math.comb(n, w) * (1 / n) ** w * (1 - 1 / n) ** (n - w)
        assert found[w] == pytest.approx(expected, abs=5 * math.sqrt(expected))


def test_no_exchange_of_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = bootstrap_array(df, ["k"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_steps_sum_up():
    for mean in (0.1, 1.0, 8.0):
        steps = poisson_steps(mean)
        assert steps == sorted(steps) and 1 - steps[-1] < 1e-12
