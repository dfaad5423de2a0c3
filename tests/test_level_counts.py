"""Kept counts with subtraction, and the sorted scan, against counting every node's rows."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from softgrove.operators import manyclass, scan, siblings
from softgrove.plans import route, tree as tree_module
from softgrove.plans.frame import ModelSpec
from softgrove.plans.grow import StopRules
from softgrove.plans.tree import TreeSpec, fit_forest, fit_soft_and_crisp, fit_tree

SETS = {"a": [(2.0, 5.0), (9.0, 5.0)], "b": [(30.0, 50.0), (70.0, 50.0)]}


def rows_of(spark, classes, n=600):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        a, b, c = rng.choice([None, *range(12)]), rng.randrange(40), rng.choice(["x", "y", None])
        rows.append((k, a, float(b) if k % 3 else rng.gauss(40, 20), c, ((a or 0) // 2 + b // 9 + (c == "x") + rng.randrange(2)) % classes))
    return spark.createDataFrame(rows, "id int, a int, b double, c string, y int")


def same(one, two):
    assert set(one) == set(two)
    for m, tree in one.items():
        assert set(tree) == set(two[m])
        for i, n in tree.items():
            other = two[m][i]
            assert (n.fi, n.num, n.cat, n.open) == (other.fi, other.num, other.cat, other.open)
            assert (n.gain is None) == (other.gain is None) and (n.gain is None or n.gain == pytest.approx(other.gain))
            assert list(n.stats) == list(other.stats)


@pytest.mark.parametrize("inline", [256, 4])
def test_subtraction_gives_the_same_trees(spark, monkeypatch, inline):
    monkeypatch.setattr(route, "INLINE_NODES", inline)  # rows routed by a condition, or by joins
    df = rows_of(spark, 3)
    weighted = df.withColumn("mw", F.expr("transform(sequence(0, 3), t -> struct(t AS model, pmod(hash(id, t), 3L) AS w))"))
    spec = TreeSpec(("a", "b", "c"), ("y",), categorical=("c",), rules=StopRules(max_depth=3, min_samples_split=8))
    models = [ModelSpec(0, 0), ModelSpec(1), ModelSpec(2, 0, (0, 1)), ModelSpec(3, None, (1, 2))]
    plain, _ = fit_forest(weighted, spec, models, [SETS], "mw", df)
    kept, _ = fit_forest(weighted, replace(spec, subtract_rows=0), models, [SETS], "mw", df)
    monkeypatch.setattr(tree_module, "few_values", lambda counts, spec: True)
    always, _ = fit_forest(weighted, spec, models, [SETS], "mw", df)
    same(plain, kept)
    same(plain, always)


def test_at_most_half_of_a_level_is_counted(spark, monkeypatch):
    counted = []

    def watched(kept, rows, pairs, layout, run=siblings.child_counts):
        counted.append(rows.agg(F.sum("w")).first()[0] or 0)
        return run(kept, rows, pairs, layout)

    monkeypatch.setattr(siblings, "child_counts", watched)
    monkeypatch.setattr(tree_module, "few_values", lambda counts, spec: True)
    fit_tree(rows_of(spark, 3), TreeSpec(("a", "b"), ("y",), rules=StopRules(max_depth=4)))
    assert len(counted) >= 3 and all(c <= 300 for c in counted)


@pytest.mark.parametrize("criterion,soft", [("gini", False), ("entropy", False), ("gini", True), ("entropy", True)])
@pytest.mark.parametrize("rows_at_once", [7, 1 << 15])
def test_scan_gives_the_same_trees(spark, monkeypatch, criterion, soft, rows_at_once):
    monkeypatch.setattr(scan, "SCAN_ROWS", rows_at_once)
    df = rows_of(spark, 9)
    weighted = df.withColumn("mw", F.expr("transform(sequence(0, 2), t -> struct(t AS model, pmod(hash(id, t), 3L) AS w))"))
    spec = TreeSpec(("a", "b"), ("y",), criterion=criterion, fuzzy_sets=SETS if soft else None, rules=StopRules(max_depth=3))
    models = [ModelSpec(0, 0 if soft else None), ModelSpec(1, None, (1,)), ModelSpec(2, 0 if soft else None, (0,))]
    scanned, _ = fit_forest(weighted, spec, models, [SETS] if soft else [], "mw", df)
    monkeypatch.setattr(scan, "applies", lambda layout, counts: False)
    windows, _ = fit_forest(weighted, spec, models, [SETS] if soft else [], "mw", df)
    same(scanned, windows)


def test_scan_limits():
    from softgrove.functions.criteria import GainSpec
    from softgrove.operators.splits import Layout

    layout = Layout(("a",), "class", manyclass.WIDE_CLASSES + 1, GainSpec("gini"))
    assert scan.applies(layout, {"a": (10**9, 1000)}) and scan.applies(layout, {"a": (1000, 1000)})
    assert not scan.applies(layout, {"a": (10**9, 10**6)})
    assert not scan.applies(replace(layout, bucketed=frozenset([0])), {"a": (1000, 1000)})


def test_soft_and_crisp_in_one_run(spark):
    df = rows_of(spark, 3)
    spec = TreeSpec(("a", "b"), ("y",), fuzzy_sets=SETS, rules=StopRules(max_depth=2))
    soft, crisp = fit_soft_and_crisp(df, spec)
    same({0: soft.tree, 1: crisp.tree}, {0: fit_tree(df, spec).tree, 1: fit_tree(df, replace(spec, fuzzy_sets=None)).tree})
