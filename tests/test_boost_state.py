"""Boosting keeps the scores of all models in the row they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.plans import score as scoring
from softgrove.plans.boost import BoostSpec, fit_boosted_models
from softgrove.plans.frame import ModelSpec
from softgrove.plans.grow import StopRules
from softgrove.plans.tree import TreeSpec

TREE = TreeSpec(("x", "c", "z"), ("y",), "value", criterion="variance", categorical=("c",), rules=StopRules(max_depth=2))


def weighted(spark):
    """Model 0 has two thirds of the rows, model 1 all; some rows feed none."""
    return spark.range(200).select(
        F.expr("if(id % 11 = 0, NULL, cast(id * 37 % 101 AS double))").alias("x"),
        F.expr("if(id % 13 = 0, NULL, concat('k', id % 4))").alias("c"), F.expr("cast(id % 7 AS double)").alias("z"),
        F.expr("cast((id * 37 % 101) / 10 + id % 4 AS double)").alias("y"),
        F.expr("if(id % 50 = 0, cast(array() AS array<struct<model: int, w: bigint>>), array(struct(0 AS model, if(id % 3 = 0, "
               "0L, 2L) AS w), struct(1 AS model, 1L AS w)))").alias("mw"))


def splits(rounds):
    return [(m, n.node, n.fi, n.num, n.cat, [round(s, 6) for s in n.stats]) for forest, _ in rounds
            for m in sorted(forest) for n in forest[m].values()]


def test_walk_and_conditions_agree(spark, monkeypatch):
    spec = BoostSpec(TREE, n_estimators=4, learning_rate=0.5, checkpoint_every=2)
    models = [ModelSpec(0), ModelSpec(1)]
    by_condition, _ = fit_boosted_models(weighted(spark), spec, models, [], "mw")
    assert any(n.cat is not None for forest, _ in by_condition for t in forest.values() for n in t.values())
    monkeypatch.setattr(scoring, "INLINE_NODES", 0)
    walked, _ = fit_boosted_models(weighted(spark), spec, models, [], "mw")
    assert splits(walked) == splits(by_condition)
    monkeypatch.setattr(scoring, "PART_NODES", 1)
    monkeypatch.setattr(scoring, "PAIRS_AT_ONCE", 7)
    in_parts, _ = fit_boosted_models(weighted(spark), spec, models, [], "mw")
    assert splits(in_parts) == splits(by_condition)


def test_models_do_not_touch_each_other(spark):
    spec = BoostSpec(TREE, n_estimators=3, learning_rate=0.5)
    both, _ = fit_boosted_models(weighted(spark), spec, [ModelSpec(0), ModelSpec(1)], [], "mw")
    one = weighted(spark).withColumn("mw", F.filter("mw", lambda s: s["model"] == 1))
    alone, _ = fit_boosted_models(one, spec, [ModelSpec(1)], [], "mw")
    assert [s for s in splits(both) if s[0] == 1] == splits(alone)


def test_a_cached_row_is_an_input_row(spark, monkeypatch):
    sizes = []
    persist = DataFrame.persist

    def counted(self, *args):
        out = persist(self, *args)
        if "mw" in self.columns and "y0" in self.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "persist", counted)
    fit_boosted_models(weighted(spark), BoostSpec(TREE, n_estimators=3), [ModelSpec(0), ModelSpec(1)], [], "mw")
    assert sizes == [196] * 3
