"""Multiway trees over discrete features (ID3, C4.5), one job per level.

A node is named by its path, so rows find their node from the splits alone: the
child is the value of the node's split feature. C4.5 also takes numeric features,
which split in two at a threshold.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from softgrove.functions.criteria import GainSpec
from softgrove.functions.sqltext import clean_number, name, text
from softgrove.operators.impurity import majority_label
from softgrove.operators.manyclass import cut_bits, many_candidates
from softgrove.operators.multiway import discrete_counts, feature_scores
from softgrove.operators.splits import Layout
from softgrove.plans.frame import add_buckets, value_edges
from softgrove.session import cut_lineage, stored

BROADCAST_SPLITS = 200_000
TIE_DIGITS = 12


@dataclass(frozen=True)
class MultiwaySpec:
    """``algo``: "id3" ranks by information gain, "c45" by gain ratio. A node at depth d
    is split only if d <= max_depth. ``numeric`` features are for "c45" only."""

    features: tuple[str, ...]
    target: str
    algo: str = "id3"
    max_depth: int = 1_000_000
    min_samples_split: int = 2
    min_gain: float = 1e-7
    numeric: tuple[str, ...] = ()
    checkpoint_every: int = 5


@dataclass
class MultiwayModel:
    """``nodes``: path, depth, feature, threshold, score, n, label; leaves have no feature."""

    spec: MultiwaySpec
    nodes: DataFrame
    depth: int

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Label of the deepest node reached; a value never seen stays at its parent."""
        out = df.withColumns({"__path": F.lit(""), "__label": F.lit(None).cast(self.nodes.schema["label"].dataType)})
        sizes = {r["depth"]: r["count"] for r in self.nodes.groupBy("depth").count().collect()}  # a row per level
        for d in range(self.depth + 1):
            level = self.nodes.filter(F.col("depth") == d).select(
                F.col("path").alias("__path"), F.col("feature").alias("__feature"),
                F.col("threshold").alias("__threshold"), F.col("label").alias("__l"), *_marks("path"))
            if sizes.get(d, 0) <= BROADCAST_SPLITS:  # all rows have the root's path, so a shuffle would make one task
                level = F.broadcast(level)
            out = out.join(level, "__path", "left").withColumn("__label", F.coalesce("__l", "__label"))
            out = out.withColumn("__path", F.expr(_child_sql(self.spec, "__feature", "__threshold"))) \
                .drop("__feature", "__threshold", "__l", "__stem", "__said")
        return out.withColumnRenamed("__label", prediction).drop("__path")


    def save(self, path: str) -> None:
        """Write the model as tables; :meth:`load` scores with them again."""
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps({**asdict(self.spec), "depth": self.depth}),)], "options string") \
            .write.mode("overwrite").parquet(f"{path}/options")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MultiwayModel:
        options = json.loads(spark.read.parquet(f"{path}/options").first()["options"])
        depth = options.pop("depth")
        spec = MultiwaySpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
        return MultiwayModel(spec, spark.read.parquet(f"{path}/nodes"), depth)


def _escaped(value: str) -> str:
    """SQL of a text that cannot be taken for the marks of a path."""
    return f"replace(replace(replace({value}, '%', '%25'), '/', '%2F'), '=', '%3D')"


def _marks(path: str) -> list[Column]:
    """What the children of a split have in common in their paths, made once per split and not per row."""
    return [F.expr(f"concat({path}, '/', {_escaped('feature')})").alias("__stem"),
            F.col("threshold").cast("string").alias("__said")]


def _child_sql(spec: MultiwaySpec, feature: str, threshold: str) -> str:
    """Path of the child a row goes to, from the split's :func:`_marks`; NULL at a leaf.

    A step is feature=value, feature? for a missing value, or feature>=threshold and feature<threshold.
    """
    every = (*spec.features, *spec.numeric)
    texts = " ".join(f"WHEN {text(f)} THEN coalesce(concat('=', {_escaped(f'cast({name(f)} AS string)')}), '?')"
                     for f in spec.features)
    for f in spec.numeric:
        texts += f" WHEN {text(f)} THEN concat(if(coalesce({clean_number(f)} >= {threshold}, false), '>=', '<'), __said)"
    return f"if({feature} IS NULL, NULL, concat(__stem, CASE {feature} {texts} END))" if every else "NULL"


def _rank_order() -> Column:
    """Higher score, then lower feature, then lower threshold."""
    return F.struct((-F.round("score", TIE_DIGITS)).alias("k"), "fi", "threshold")


def _numeric_scores(rows: DataFrame, spec: MultiwaySpec, edges: Mapping[str, list[float]]) -> DataFrame:
    """Best binary split by gain ratio of every numeric feature at every node; any number of labels."""
    bucketed = frozenset(i for i, f in enumerate(spec.numeric) if f in edges)
    if bucketed:
        rows = add_buckets(rows, spec.numeric, edges)
    base = rows.select(
        F.lit(0).alias("model"), F.col("path").alias("node"), F.lit(1.0).alias("w"), F.col(spec.target).alias("yi"),
        F.expr(f"array({', '.join(clean_number(f) for f in spec.numeric)})").alias("x"),
        F.expr(f"array({', '.join(map(str, range(len(spec.numeric))))})").alias("fs"),
        *(["xb"] if bucketed else []))
    layout = Layout(spec.numeric, "class", 0, GainSpec("entropy"), bucketed=bucketed)
    found = many_candidates(base, layout).filter("gain IS NOT NULL").selectExpr(
        "node AS path", f"fi + {len(spec.features)} AS fi", "vmin AS threshold",
        f"gain / ({cut_bits('h_n', 'r_n')} / a_n) AS score")
    best = found.groupBy("path", "fi").agg(F.min_by(F.struct("threshold", "score"), _rank_order()).alias("b"))
    return best.select("path", "fi", "b.*")


def fit_multiway(df: DataFrame, spec: MultiwaySpec) -> MultiwayModel:
    """Grow level by level; node tables stay distributed, only their number reaches the driver."""
    if spec.numeric and spec.algo != "c45":
        raise ValueError("numeric features need algo='c45'")
    every = (*spec.features, *spec.numeric)
    measure = {"id3": "gain", "c45": "gain_ratio"}[spec.algo]
    rows = df.select(*every, spec.target).filter(F.col(spec.target).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    names = F.array(*[F.lit(f) for f in every])
    levels: list[DataFrame] = []
    depth = 0
    try:
        edges = value_edges(rows, spec.numeric, ()) if spec.numeric else {}
        current = rows.withColumns({"path": F.lit(""), "used": F.expr("cast(array() AS array<int>)")})
        while True:
            # all rows of a path have the same used features
            stats = stored(majority_label(current, ["path", "used"], spec.target, total="n"), "node-stats")
            best = None
            if depth <= spec.max_depth:
                parts = []
                if spec.features:
                    counts = discrete_counts(current, ["path"], spec.features, spec.target)
                    parts.append(feature_scores(counts, ["path"]).filter("n_values > 1").selectExpr(
                        "path", "fi", "cast(NULL AS double) AS threshold", f"{measure} AS score"))
                if spec.numeric:
                    parts.append(_numeric_scores(current, spec, edges))
                ranked = reduce(DataFrame.unionByName, parts)
                best = (
                    ranked.join(stats.select("path", "used", "n"), "path")
                    .filter(~F.array_contains("used", F.col("fi")) & (F.col("n") >= spec.min_samples_split))
                    .groupBy("path").agg(F.min_by(F.struct("fi", "threshold", "score"), _rank_order()).alias("b"))
                    .select("path", "b.*").filter(F.col("score") > spec.min_gain)
                )
            level = stats.drop("used").withColumnRenamed("label", "label").withColumn("depth", F.lit(depth))
            if best is not None:
                level = level.join(best, "path", "left")
            else:
                level = level.withColumns({"fi": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double"),
                                           "score": F.lit(None).cast("double")})
            level = level.withColumn("feature", F.get(names, F.col("fi"))).select(
                "path", "depth", "fi", "feature", "threshold", "score", "n", "label")
            level = cut_lineage(level)
            levels.append(level)
            splits = level.filter("feature IS NOT NULL").select(
                "path", F.col("fi").alias("__fi"), F.col("feature").alias("__feature"), F.col("threshold").alias("__threshold"),
                *_marks("path"))
            n_splits = splits.count()
            if n_splits == 0:
                break
            splits = F.broadcast(splits) if n_splits <= BROADCAST_SPLITS else splits
            once = f"if(__fi < {len(spec.features)}, array_append(used, __fi), used)"
            current = (
                current.join(splits, "path")
                .withColumns({"path": F.expr(_child_sql(spec, "__feature", "__threshold")), "used": F.expr(once)})
                .drop("__fi", "__feature", "__threshold", "__stem", "__said")
            )
            depth += 1
            if depth % spec.checkpoint_every == 0:
                current = cut_lineage(current)
    finally:
        rows.unpersist()
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return MultiwayModel(spec, nodes.drop("fi"), depth)
