"""Bagged trees: bootstrap weights instead of row copies, all trees grown together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.functions import encode
from softgrove.functions.sqltext import num, value
from softgrove.operators.sampling import bootstrap_array, feature_subspace
from softgrove.plans.frame import ModelSpec
from softgrove.plans.route import Tree
from softgrove.plans.score import is_small, summed_leaves, tree_sql
from softgrove.plans.store import load_trees, node_table, save_trees
from softgrove.plans.tree import Coding, TreeSpec, fit_forest, leaf_label, leaf_mean


@dataclass(frozen=True)
class ForestSpec:
    """``bootstrap``: "exact" draws as many rows as the table has per tree; "poisson"
    weights every row independently and needs no shuffle; "none" uses every row once."""

    tree: TreeSpec
    key: tuple[str, ...]
    n_estimators: int = 100
    max_features: int | None = None  # default int(sqrt(number of features))
    bootstrap: str = "exact"
    seed: int = 0


@dataclass
class ForestModel:
    spec: ForestSpec
    trees: list[Tree]
    coding: Coding

    def votes(self) -> Column:
        """``array<double>``: votes per label, or sum of leaf means per output."""
        tree = self.spec.tree
        if tree.task == "class":
            def leaf(n):
                label = leaf_label(n, self.coding)
                return [float(v == label) for v in self.coding.labels]
        else:
            def leaf(n):
                return leaf_mean(n, self.coding)
        width = self.coding.width
        if is_small(self.trees):
            parts = [tree_sql(t, tree.features, lambda n: f"array({', '.join(map(num, leaf(n)))})") for t in self.trees]
            added = parts[0]
            for p in parts[1:]:
                added = f"zip_with({added}, {p}, (a, b) -> a + b)"
            return F.expr(added)
        return summed_leaves(self.trees, tree.features, tree.categorical, leaf, width)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Majority vote (smallest label on ties) or mean of the trees."""
        if self.spec.tree.task == "class":
            labels = ", ".join(value(v) for v in self.coding.labels)
            staged = df.withColumn("__at", encode.argmax_decode(self.votes()))
            return staged.withColumn(prediction, F.expr(f"get(array({labels}), __at)")).drop("__at")
        total = F.transform(self.votes(), lambda s: s / F.lit(float(len(self.trees))))
        return df.withColumn(prediction, total if self.coding.width > 1 else F.get(total, F.lit(0)))


    def nodes(self, spark: SparkSession) -> DataFrame:
        return node_table(spark, self.spec.tree, self.trees, [self.coding] * len(self.trees))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as tables; :meth:`load` scores with them again."""
        options = {"key": self.spec.key, "max_features": self.spec.max_features, "bootstrap": self.spec.bootstrap,
                   "seed": self.spec.seed}
        save_trees(spark, path, self.spec.tree, self.trees, [self.coding] * len(self.trees), options)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        tree, trees, codings, options = load_trees(spark, path)
        spec = ForestSpec(tree, tuple(options["key"]), len(trees), options["max_features"], options["bootstrap"],
                          options["seed"])
        return ForestModel(spec, trees, codings[0])


def fit_bagged(df: DataFrame, spec: ForestSpec) -> ForestModel:
    """Level-wise training of all trees in the same jobs, keyed by tree."""
    tree = spec.tree
    picks = feature_subspace(spec.n_estimators, len(tree.features), spec.max_features, spec.seed)
    variants = [tree.fuzzy_sets] if tree.fuzzy_sets is not None else []
    models = [ModelSpec(t, 0 if variants else None, picks[t]) for t in range(spec.n_estimators)]
    if spec.bootstrap == "none":
        every = f"transform(sequence(0, {spec.n_estimators - 1}), t -> struct(t AS model, 1L AS w))"
        weighted = df.withColumn("mw", F.expr(every))
    else:
        weighted = bootstrap_array(df, spec.key, spec.n_estimators, spec.seed, spec.bootstrap)
    forest, coding = fit_forest(weighted, tree, models, variants, "mw", df)
    return ForestModel(spec, [forest[t] for t in sorted(forest)], coding)
