"""Radix quantiles and thresholds against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from softgrove.operators import ranks
from softgrove.operators.quantiles import describe, exact_quantiles, ordered_bits

PROBS = {"low": 0.0, "q1": 0.25, "odd": 0.371, "q3": 0.75, "high": 1.0}


@pytest.mark.parametrize("direct_rows", [0, 1_000_000])
def test_quantiles_of_any_distribution(spark, direct_rows):
    rng = random.Random(2)
    rows = [("a", rng.choice([1e300, -1e300, 5e-324, 0.0, -0.0, 1.5, -2.5])) for _ in range(200)]
    rows += [("hot", 7.25)] * 500 + [("hot", rng.gauss(0, 1)) for _ in range(101)] + [(None, float(k)) for k in range(50)]
    rows += [("one", -3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: [r[p] for p in PROBS] for r in exact_quantiles(df, ["k"], "v", PROBS, direct_rows).collect()}
    assert set(got) == {"a", "hot", None, "one"}
    for k, found in got.items():
        values = [v for g, v in rows if g == k and v is not None]
        assert found == pytest.approx(list(np.quantile(values, list(PROBS.values()))), rel=1e-12)
    every = exact_quantiles(df, [], "v", {"m": 0.5}, direct_rows).collect()
    assert [r["m"] for r in every] == pytest.approx([np.quantile([v for _, v in rows if v is not None], 0.5)])
    assert {r["k"]: r["q50"] for r in describe(df, ["k"], "v").collect()}["none"] is None


def test_bits_are_in_the_order_of_the_numbers(spark):
    values = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in [*values, -0.0]], "v double").withColumn("b", ordered_bits("v"))
    bits = [r["b"] for r in df.collect()]
    assert bits[:-1] == sorted(bits[:-1]) and len(set(bits[:-1])) == len(values) and bits[-1] == bits[4]


@pytest.mark.parametrize("counts", [16, 1 << 17])
def test_radix_thresholds(spark, monkeypatch, counts):
    monkeypatch.setattr(ranks, "RADIX_COUNTS", counts)
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    local = {g: sorted(r["h"] for r in df.collect() if r["g"] == g) for g in (0, 1)}
    wanted = {0: [1, 7, 250], 1: [2, 249, 251], 5: [1]}
    got = ranks.radix_thresholds(df, "h", "g", wanted)
    assert got == {(g, p): local[g][p - 1] for g, ps in wanted.items() if g in local for p in ps if p <= 250}
    same = spark.createDataFrame([(0, "a" * 32)] * 3 + [(0, "b" * 32)], "g int, h string")
    assert ranks.radix_thresholds(same, "h", "g", {0: [2, 4]}) == {(0, 2): "a" * 32, (0, 4): "b" * 32}


def test_offsets_in_two_steps(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), f"{rng.randrange(4096):03x}", float(rng.randrange(900))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, b string, d double")
    for bucket, place in (("b", 1), ("d", 2)):
        for keys in ([], ["k"]):
            found = ranks._offsets(df, keys, bucket, F.lit(1)).collect()
            assert len(found) == len({(r[0] if keys else 0, r[place]) for r in rows})
            for r in found[::37]:
                assert r["__before"] == sum((not keys or x[0] == r["k"]) and x[place] < r[bucket] for x in rows)
