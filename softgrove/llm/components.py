"""Connected components by alternating large and small stars.

Each round contracts every neighbourhood to its smallest node, so the number of
rounds grows with the logarithm of the longest chain. Rounds are cut by tables
in the shared folder. The smallest neighbour of each node is written before it
is joined, so the join is a broadcast if that table is small, else a shuffle
whose hot nodes the adaptive skew join splits. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    least = written(least, "star")
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges run from x down to y."""
    least = written(edges.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u"), "star")
    moved = edges.join(least, F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("m").alias("y"))
    own = least.select(F.col("u").alias("x"), F.col("m").alias("y"))
    return moved.filter("x <> y").unionByName(own.filter("x <> y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its smallest node.

    Edges from a node to itself, repeated edges and edges with a null end are allowed; the last are left out.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        stars = _small_star(_large_star(edges)).select(F.col("y").alias("a"), F.col("x").alias("b")).distinct()
        edges = written(stars, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
