"""Early stopping: strata, the chosen loss, and models that stop one by one."""

import math

import pytest
from pyspark.sql import functions as F

from softgrove.functions.losses import LOSSES
from softgrove.operators.sampling import stratified_holdout
from softgrove.plans.boost import BoostSpec, fit_boosted_models
from softgrove.plans.experiments import Config, cross_validate_boosted
from softgrove.plans.frame import ModelSpec
from softgrove.plans.grow import StopRules
from softgrove.plans.tree import TreeSpec


def rows_of(spark, n=300):
    return spark.range(n).selectExpr("id", "cast(id % 10 AS double) AS x", "cast(id % 7 AS double) AS z",
                                     "cast(if(id % 10 > 6, 2, if(id % 3 = 0, 1, 0)) AS int) AS y")


def test_strata(spark):
    df = rows_of(spark).withColumn("y", F.when(F.col("id") > 5, F.col("y")))
    out = stratified_holdout(df, ["id"], "y", 0.1, out="held")
    assert out.columns == [*df.columns, "held"] and out.count() == 300
    n = {r["y"]: (r["n"], r["h"]) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.expr("count_if(held)").alias("h")).collect()}
    assert sum(h for _, h in n.values()) == math.ceil(0.1 * 300)
    assert all(abs(h - 0.1 * k) <= 1 for k, h in n.values())


def test_losses_of_rows(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0, -1.0)], "y0 double, y1 double, f0 double, f1 double")
    ys, fs = [F.col("y0"), F.col("y1")], [F.col("f0"), F.col("f1")]
    got = df.select(LOSSES["softmax"].of_row(ys, fs).alias("s"), LOSSES["residual"].of_row(ys, fs).alias("r")).first()
    assert got["s"] == pytest.approx(math.log(1 + math.exp(-3))) and got["r"] == pytest.approx(0.5 + 0.5)


def test_models_stop_one_by_one(spark):
    df = rows_of(spark)
    tree = TreeSpec(("x", "z"), ("y",), "class", criterion="variance", rules=StopRules(max_depth=1))
    spec = BoostSpec(tree, n_estimators=12, learning_rate=0.9, loss="softmax", n_classes=3, n_iter_no_change=1,
                     validation_fraction=0.2, key=("id",))
    weighted = df.withColumn("mw", F.expr("array(struct(0 AS model, 1L AS w), struct(1 AS model, 1L AS w))"))
    models = [ModelSpec(0), ModelSpec(1, None, (1,))]  # the second one can learn nothing
    history = []
    rounds, _ = fit_boosted_models(weighted, spec, models, [], "mw", history)
    trees = {m: sum(m in forest for forest, _ in rounds) for m in (0, 1)}
    assert 1 < trees[1] < trees[0]
    for m in (0, 1):
        losses = [e for _, k, e in history if k == m]
        assert len(losses) == trees[m] and all(b < a for a, b in zip(losses, losses[1:-1]))
    single = [ModelSpec(1, None, (1,))]
    alone, _ = fit_boosted_models(df.withColumn("mw", F.expr("array(struct(1 AS model, 1L AS w))")), spec, single, [], "mw")
    assert len(alone) == trees[1]
    for (forest, _), (other, _) in zip(rounds, alone):
        assert [(n.fi, n.num) for n in forest[1].values()] == [(n.fi, n.num) for n in other[1].values()]


def test_stopped_models_are_scored_with_what_they_have(spark):
    spec = BoostSpec(TreeSpec(("x", "z"), ("y",), "class", criterion="variance", rules=StopRules(max_depth=1)), n_estimators=6,
                     learning_rate=0.9, loss="softmax", n_classes=3, n_iter_no_change=1, validation_fraction=0.2, key=("id",))
    out = cross_validate_boosted(rows_of(spark), spec, ["id"], [Config(), Config(features=(1,))], n_folds=2).collect()
    assert len(out) == 4 and all(0 < r["acc_test"] <= 1 for r in out)
    assert min(r["acc_test"] for r in out if r["config"] == 0) > max(r["acc_test"] for r in out if r["config"] == 1)
