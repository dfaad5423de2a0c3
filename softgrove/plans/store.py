"""Ensembles as tables: nodes of all trees, targets' coding per tree, fuzzy sets and options."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from softgrove.plans.route import Tree
from softgrove.plans.tree import NODE_SCHEMA, Coding, TreeModel, TreeSpec, tree_of


def node_table(spark: SparkSession, spec: TreeSpec, trees: Sequence[Tree], codings: Sequence[Coding]) -> DataFrame:
    """One row per node; ``model_id`` is the position of the tree."""
    rows = [row for i, (tree, coding) in enumerate(zip(trees, codings))
            for row in TreeModel(spec, tree, coding).node_rows(i)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def save_trees(spark: SparkSession, path: str, spec: TreeSpec, trees: Sequence[Tree], codings: Sequence[Coding],
               options: dict) -> None:
    TreeModel(spec, trees[0], codings[0]).save(spark, path)
    node_table(spark, spec, trees, codings).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(i, list(c.centres)) for i, c in enumerate(codings)], "model_id int, centres array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/codings")
    spark.createDataFrame([(json.dumps(options),)], "options string").write.mode("overwrite").parquet(f"{path}/options")


def load_trees(spark: SparkSession, path: str) -> tuple[TreeSpec, list[Tree], list[Coding], dict]:
    spec, first = TreeModel.load_head(spark, path)
    centres = {r["model_id"]: tuple(r["centres"]) for r in spark.read.parquet(f"{path}/codings").collect()}
    codings = [Coding(first.labels, centres[i]) for i in sorted(centres)]
    rows: list[list] = [[] for _ in codings]
    for r in spark.read.parquet(f"{path}/nodes").collect():  # the model itself
        rows[r["model_id"]].append(r)
    trees = [tree_of(part, coding, i) for i, (part, coding) in enumerate(zip(rows, codings))]
    return spec, trees, codings, json.loads(spark.read.parquet(f"{path}/options").first()["options"])
