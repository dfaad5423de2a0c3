"""Counts by fold at the roots of cross-validations, against training rows spelled out."""

import random

import pytest
from pyspark.sql import functions as F

from softgrove.plans.experiments import Config, trial_weights, trials, with_folds
from softgrove.plans.frame import ModelSpec
from softgrove.plans.grow import StopRules
from softgrove.plans.tree import TreeSpec, fit_forest

SETS = [{"a": [(2.0, 5.0), (9.0, 5.0)], "b": [(30.0, 50.0), (70.0, 50.0)]}, {"a": [(6.0, 7.0)]}]


def rows_of(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(12)]), rng.gauss(50, 20), rng.choice(["x", "y", None]), rng.choice([0, 1, 2, None]))
            for k in range(300)]
    rows += [(k, 3, 7.0, "z", 1) for k in range(300, 500)]  # one hot value
    rows = [(*r, None if r[4] is None else r[4] * 2.0 + (r[1] or 0)) for r in rows]
    return spark.createDataFrame(rows, "id int, a int, b double, c string, y int, v double")


@pytest.mark.parametrize("task", ["class", "value"])
@pytest.mark.parametrize("direct_limit", [20, 100_000])
@pytest.mark.parametrize("depth", [0, 2])
def test_same_forest_as_from_rows(spark, task, direct_limit, depth):
    df = rows_of(spark).filter("v IS NOT NULL" if task == "value" else "TRUE")
    spec = TreeSpec(("a", "b", "c"), ("y" if task == "class" else "v",), task, categorical=("c",),
                    rules=StopRules(max_depth=depth), direct_limit=direct_limit)
    configs = [Config(0, (0, 1)), Config(), Config(1, (0, 2))]
    todo = trials(len(configs), 2, 3)
    folded = with_folds(df, ["id"], 3, 2, 7, True)
    weighted = folded.withColumn("mw", F.expr(trial_weights(todo, 2, 3, len(configs), False)))
    models = [ModelSpec(t.model, configs[t.config].variant, configs[t.config].features) for t in todo]
    plain, _ = fit_forest(weighted, spec, models, SETS, "mw", df)
    by_fold, _ = fit_forest(weighted, spec, models, SETS, "mw", df, "__folds", [(t.repeat, t.fold) for t in todo])
    assert set(plain) == set(by_fold)
    for m, tree in plain.items():
        assert set(tree) == set(by_fold[m])
        for i, n in tree.items():
            other = by_fold[m][i]
            assert (n.fi, n.num, n.cat) == (other.fi, other.num, other.cat)
            assert n.gain == pytest.approx(other.gain) and list(n.stats) == pytest.approx(list(other.stats))


def test_rows_are_counted_once_per_repeat(spark):
    """Whatever the folds and models, the counted rows are rows x repeats x features."""
    from softgrove.functions.criteria import GainSpec
    from softgrove.operators.folds import FoldCounts, FoldModel
    from softgrove.operators.splits import Layout

    base = spark.createDataFrame([([1.0, 2.0], 0, [0, 1, 4])] * 10, "x array<double>, yi int, folds array<int>")
    layout = Layout(("a", "b"), "class", 2, GainSpec("gini"))
    models = [FoldModel((r * 5 + f) * 2 + c, r, f, (0, 1)) for r in range(3) for f in range(5) for c in range(2)]
    assert FoldCounts(base, layout, models, "folds").long.count() == 10 * 3 * 2
