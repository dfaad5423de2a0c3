"""Leaf rules: what the leaves of a grown tree predict, as a plug-in.

A rule turns the training rows of all leaves, ``leaf`` and ``y``, into a table of
one value per leaf. Rules are aggregations by leaf, so Spark runs them over the
routed rows however many rows a leaf has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.quantiles import exact_quantiles
from softgrove.plans.tree import TreeModel
from softgrove.session import stored

LeafRule = Callable[[DataFrame], DataFrame]


def quantile_rule(p: float) -> LeafRule:
    return lambda rows: exact_quantiles(rows, ["leaf"], "y", {"value": p})


LEAF_RULES: dict[str, LeafRule] = {
    "mean": lambda rows: rows.groupBy("leaf").agg(F.avg("y").alias("value")),
    "median": quantile_rule(0.5),
}


def register_leaf_rule(name: str, rule: LeafRule) -> None:
    """``rule(rows)`` gets the columns leaf and y, and returns leaf and value."""
    LEAF_RULES[name] = rule


@dataclass
class RuledTree:
    """A tree whose leaves predict by a rule; ``leaves`` has leaf and value."""

    model: TreeModel
    leaves: DataFrame

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        at = df.withColumn("__leaf", self.model.leaf_id())
        values = self.leaves.select(F.col("leaf").alias("__leaf"), F.col("value").alias(prediction))
        return at.join(values, "__leaf", "left").drop("__leaf")


def with_leaf_rule(model: TreeModel, train: DataFrame, rule: str) -> RuledTree:
    """``model`` with the leaf values that a registered rule gives on the training rows."""
    rows = train.select(model.leaf_id().alias("leaf"), F.col(model.spec.targets[0]).cast("double").alias("y"))
    return RuledTree(model, stored(LEAF_RULES[rule](rows.filter("y IS NOT NULL")), "leaves"))
