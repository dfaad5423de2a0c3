"""Thresholds among any number of labels: each value once, exact sums, large classes and buckets, whatever the dealing."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from softgrove.functions.criteria import GainSpec
from softgrove.operators import manyclass
from softgrove.operators.splits import Layout
from softgrove.plans.multiway import MultiwaySpec, _numeric_scores, fit_multiway

SCHEMA = "model int, node string, w double, yi {}, x array<double>, fs array<int>, xb array<int>"


def bits(left, right):
    if left <= 0 or right <= 0:
        return 0.0
    return (left * math.log1p(right / left) + right * math.log1p(left / right)) / math.log(2)


def expected(rows):
    """(model, node, feature, value): rows of the node, passing rows, gain; by definition."""
    out = {}
    for key in {(m, node, fi) for m, node, _, _, _, fs, _ in rows for fi in fs}:
        own = [(y, x[key[2]], w) for m, node, w, y, x, fs, _ in rows if (m, node) == key[:2] and key[2] in fs]
        classes = Counter()
        for y, _, w in own:
            classes[y] += w
        a = sum(classes.values())
        for v in {v for _, v, _ in own if v is not None}:
            passing = Counter()
            for y, x, w in own:
                if x is not None and x >= v:
                    passing[y] += w
            h = sum(passing.values())
            gain = (bits(h, a - h) - sum(bits(passing[y], c - passing[y]) for y, c in classes.items())) / a
            out[(*key, v)] = (a, h, gain if h < a else None)
    return out


def random_rows(n=700, labels=60, label=int):
    rng = random.Random(9)
    rows = []
    for _ in range(n):
        x = [round(rng.gauss(0, 1), 1) if rng.random() > 0.1 else None, float(rng.randrange(5)) if rng.random() > 0.1 else None]
        y = rng.randrange(labels) if rng.random() > 0.3 else 0
        rows.append((rng.randrange(2), rng.choice(["", "/a"]), float(rng.randrange(1, 4)), label(y), x,
                     rng.choice([[0, 1], [0, 1], [1]]), [None if x[0] is None else math.floor(x[0]) + 10, None]))
    return rows


def candidates(spark, rows, bucketed=frozenset(), kind="bigint"):
    df = spark.createDataFrame(rows, SCHEMA.format(kind))
    layout = Layout(("a", "b"), "class", 0, GainSpec("entropy"), bucketed=bucketed)
    return manyclass.many_candidates(df if bucketed else df.drop("xb"), layout)


@pytest.mark.parametrize("light,dealt,bucketed,label,kind", [
    (1 << 20, 1 << 21, frozenset(), int, "bigint"), (1 << 20, 64, frozenset([0]), str, "string"),
    (20, 64, frozenset([0]), int, "bigint"), (20, 1 << 21, frozenset(), float, "double"), (0, 64, frozenset([0]), int, "int")])
def test_candidates_by_definition(spark, monkeypatch, light, dealt, bucketed, label, kind):
    monkeypatch.setattr(manyclass, "LIGHT_CELLS", light)
    monkeypatch.setattr(manyclass, "DEALT_CELLS", dealt)
    rows = random_rows(label=label)
    found = candidates(spark, rows, bucketed, kind).filter("vmin IS NOT NULL").collect()
    want = expected(rows)
    assert len(found) == len(want)  # once per value, not per value and label
    for r in found:
        a, h, gain = want[(r["model"], r["node"], r["fi"], r["vmin"])]
        assert (r["a_n"], r["h_n"]) == (a, h)
        assert (r["gain"] is None) == (gain is None)
        assert gain is None or math.isclose(r["gain"], gain, rel_tol=1e-9, abs_tol=1e-12)


def test_both_ends_keep_their_digits(spark):
    """One row of 2**30 and more splits off at either end; the gains are equal and right to nine digits."""
    n = float(1 << 29)
    values = [(1.0, 0, 1.0), (2.0, 0, n), (2.0, 1, n), (3.0, 2, n), (4.0, 2, 1.0)]
    rows = [(0, "", w, y, [v, 0.0], [0], [0, None]) for v, y, w in values]
    found = {r["vmin"]: r["gain"] for r in candidates(spark, rows).filter("vmin IS NOT NULL").collect()}
    for v, gain in {k[3]: g for k, (_, _, g) in expected(rows).items()}.items():
        assert gain is None or math.isclose(found[v], gain, rel_tol=1e-9)
    assert found[2.0] == found[4.0]


def test_ranking_sees_a_row_per_feature(spark):
    df = spark.createDataFrame([(float(k % 97), float(k % 5), k % 40) for k in range(2000)], "a double, b double, label int")
    spec = MultiwaySpec((), "label", "c45", max_depth=0, numeric=("a", "b"))
    assert _numeric_scores(df.withColumn("path", F.lit("")), spec, {}).count() == 2


def test_more_values_than_buckets_are_for(spark):
    rng = random.Random(2)
    values = [(k, k % 300) for k in range(70_000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v), y if v < 69_990 else 7) for v, y in values], "x double, label int")
    model = fit_multiway(df, MultiwaySpec((), "label", "c45", max_depth=1, numeric=("x",)))
    assert fit_multiway(df.repartition(3), MultiwaySpec((), "label", "c45", max_depth=1, numeric=("x",))).nodes.exceptAll(
        model.nodes).count() == 0
    classes = Counter(y if v < 69_990 else 7 for v, y in values)
    passing, best = Counter(), None
    for v in sorted((v for v, _ in values), reverse=True)[:-1]:
        passing[v % 300 if v < 69_990 else 7] += 1
        if v > 69_900 or v < 50:
            h = 70_000 - v
            score = 1 - sum(bits(passing[y], c - passing[y]) for y, c in classes.items()) / bits(h, v)
            best = max(best or (-1, 0), (round(score, 12), -v))
    root = model.nodes.filter("depth = 0").first()
    assert (root["threshold"], root["n"]) == (-best[1], 70_000) and math.isclose(root["score"], best[0], rel_tol=1e-9)
    assert model.nodes.filter("path LIKE '/x%'").count() >= 2
    assert model.transform(df).filter("prediction IS NULL").count() == 0
