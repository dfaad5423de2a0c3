"""Comparison of soft trees with the tree learners that come with Spark."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.functions.metrics import accuracy
from softgrove.operators.sampling import stratified_sample
from softgrove.plans.experiments import Config, cross_validate, with_folds
from softgrove.plans.tree import TreeSpec


def compare_baselines(df: DataFrame, spec: TreeSpec, key: Sequence[str], ds_name: str, n_rows: int = 1000,
                      n_folds: int = 10, n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """Repeated k-fold of the soft and the crisp tree and of Spark's own learners on a
    stratified sample (a feature of this comparison; the whole table if it is smaller).

    Spark's learners stop at 30 levels, the most they allow; ours follow the spec.

    Result: ``model_name, ds_name, with_fuzzy_rules, sn, fold, acc_test, elapsed_time``.
    """
    target = spec.targets[0]
    sample = stratified_sample(df, key, target, n_rows, seed).select(*key, *spec.features, target).persist()
    sets = [spec.fuzzy_sets] if spec.fuzzy_sets is not None else []
    configs = [Config(variant=0), Config()] if sets else [Config()]
    ours = cross_validate(sample, spec, key, configs, sets, n_folds, n_repeats, seed)
    soft = F.col("config") == 0 if sets else F.lit(False)
    ours = ours.select(F.when(soft, "soft_tree").otherwise("crisp_tree").alias("model_name"), soft.alias("with_fuzzy_rules"),
                       F.col("repeat").alias("sn"), "fold", "acc_test", "elapsed_time")
    folded = with_folds(sample, key, n_folds, n_repeats, seed, True).withColumn(
        "label", F.col(target).cast("double")).persist()
    assembler = VectorAssembler(inputCols=list(spec.features), outputCol="features")
    depth = int(min(spec.rules.max_depth + 1, 30))
    learners = {"spark_tree": DecisionTreeClassifier(maxDepth=depth, seed=seed),
                "spark_forest": RandomForestClassifier(maxDepth=depth, numTrees=20, seed=seed)}
    scored: list[tuple] = []
    try:
        for r in range(n_repeats):
            for f in range(n_folds):
                fold = F.get("__folds", F.lit(r))
                for name, learner in learners.items():
                    started = time.time()
                    model = Pipeline(stages=[assembler, learner]).fit(folded.filter(fold != f))
                    elapsed = time.time() - started
                    hits = model.transform(folded.filter(fold == f)).agg(
                        accuracy(F.col("label"), F.col("prediction")).alias("acc_test")).first()["acc_test"]
                    scored.append((name, False, r, f, hits, elapsed))
        ours = df.sparkSession.createDataFrame(ours.collect(), ours.schema)  # a row per fit
    finally:
        folded.unpersist()
        sample.unpersist()
    theirs = df.sparkSession.createDataFrame(
        scored, "model_name string, with_fuzzy_rules boolean, sn int, fold int, acc_test double, elapsed_time double")
    return ours.unionByName(theirs).withColumn("ds_name", F.lit(ds_name))
