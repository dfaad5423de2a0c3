"""Single soft or crisp trees: estimator, fitted model and its tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from softgrove.functions.criteria import GainSpec
from softgrove.functions.sqltext import name, num, value
from softgrove.operators import scan
from softgrove.operators.folds import FoldCounts, FoldModel
from softgrove.operators.splits import DIRECT_LIMIT, Layout
from softgrove.plans.frame import FuzzySetMap, ModelSpec, base_rows, expand_models, masses_sql, value_counts, value_edges
from softgrove.plans.frontier import TableTree, grow_tables
from softgrove.plans.grow import StopRules, grow
from softgrove.plans.route import Forest, Node, Tree
from softgrove.plans.score import is_small, leaf_ids, split_test, summed_leaves, tree_column

#: Nodes up to which a tree that may become a table is grown with its nodes on the driver.
DRIVER_NODES = 20_000

NODE_SCHEMA = (
    "model_id int, node_id bigint, depth int, is_leaf boolean, feature_idx int, feature string, split_kind string, "
    "split_num double, split_cat string, gain double, n double, leaf_value string, leaf_mean array<double>, "
    "leaf_labels array<string>, leaf_proba array<double>, class_counts array<double>, path string"
)


@dataclass(frozen=True)
class TreeSpec:
    """What to train. ``targets`` has several columns only for multi-output regression."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    task: str = "class"
    criterion: str | None = None
    fuzzy_sets: FuzzySetMap | None = None
    categorical: tuple[str, ...] = ()
    rules: StopRules = field(default_factory=StopRules)
    direct_limit: int = DIRECT_LIMIT
    cache: bool = True
    gain: GainSpec | None = None  # overrides criterion and softness
    subtract_rows: int = 4_000_000  # values from which counts are kept to get the larger child by subtraction

    def gain_spec(self) -> GainSpec:
        if self.gain is not None:
            return self.gain
        default = "gini" if self.task == "class" else "variance"
        return GainSpec(self.criterion or default, soft=self.fuzzy_sets is not None)


@dataclass(frozen=True)
class Coding:
    """How targets were coded: sorted labels, or the centre subtracted per output."""

    labels: tuple = ()
    centres: tuple[float, ...] = ()

    @property
    def width(self) -> int:
        return len(self.labels) or len(self.centres)


def label_coding(df: DataFrame, target: str) -> Coding:
    """Sorted distinct labels; they are part of the model, like its leaves."""
    found = df.select(F.col(target).alias("y")).where("y is not null").distinct().collect()
    return Coding(labels=tuple(sorted(r["y"] for r in found)))


def value_coding(df: DataFrame, targets: Sequence[str]) -> Coding:
    """Targets are centred before squares are summed, to keep digits."""
    row = df.agg(*[F.avg(F.col(t).cast("double")).alias(f"y{i}") for i, t in enumerate(targets)]).first()
    return Coding(centres=tuple(float(row[i] or 0.0) for i in range(len(targets))))


def target_columns(coding: Coding, targets: Sequence[str]) -> dict[str, Column]:
    if coding.labels:
        known = f"array({', '.join(value(v) for v in coding.labels)})"
        return {"yi": F.expr(f"cast(array_position({known}, {name(targets[0])}) - 1 AS int)")}
    return {f"t{i}": F.expr(f"cast({name(t)} AS double) - {num(c)}")
            for i, (t, c) in enumerate(zip(targets, coding.centres))}


def leaf_mean(node: Node, coding: Coding) -> list[float]:
    o = coding.width
    return [c + node.stats[1 + i] / node.stats[0] for i, c in zip(range(o), coding.centres)]


def leaf_label(node: Node, coding: Coding):
    """Most frequent label, the smallest one on ties."""
    counts = node.stats[: coding.width]
    return coding.labels[counts.index(max(counts))]


def fit_forest(df: DataFrame, spec: TreeSpec, models: Sequence[ModelSpec], variants: Sequence[FuzzySetMap] = (),
               weights: str | None = None, source: DataFrame | None = None, folds: str | None = None,
               held_out: Sequence[tuple[int, int]] = ()) -> tuple[Forest, Coding]:
    """Train every model of ``models`` in the same level jobs.

    ``source`` is the table without ``weights``, if weighting it is costly: labels and
    value ranges are read from it. If models train on all folds but one, ``folds`` names
    the array of folds by repeat and ``held_out`` has (repeat, fold) of each model; roots
    are then counted by fold.
    """
    with training(df, spec, models, variants, weights, source, [folds] if folds else []) as t:
        roots = None
        if folds:
            every = tuple(range(len(spec.features)))
            masses = [masses_sql(spec.features, [v], [ModelSpec(0, 0)]) for v in variants]
            roots = FoldCounts(t.base, t.layout, [FoldModel(m.model, r, f, m.features or every, m.variant)
                                              for m, (r, f) in zip(models, held_out)], folds, masses)
        search = None
        if scan.applies(t.layout, t.counts):
            search = partial(scan.best_splits_scanned, count_first=any(n > 2 * d for n, d in t.counts.values()))
        return grow(t.rows, t.layout, spec.rules, [m.model for m in models], search, roots=roots, subtract=t.few_values), t.coding


@dataclass(frozen=True)
class Training:
    """Rows of all models, their layout, the coding of targets, the base, (values, distinct values) by feature, and
    whether counts are far fewer than rows."""

    rows: DataFrame
    layout: Layout
    coding: Coding
    base: DataFrame
    counts: Mapping[str, tuple[int, int]]
    few_values: bool


def few_values(counts: Mapping[str, tuple[int, int]], spec: TreeSpec) -> bool:
    """Counts pay for being kept if there are many rows and few distinct values; texts are taken to have few."""
    rows, distinct = (sum(c[i] for c in counts.values()) for i in (0, 1))
    return rows >= spec.subtract_rows and 8 * distinct <= rows and spec.rules.max_depth >= 1


@contextmanager
def training(df: DataFrame, spec: TreeSpec, models: Sequence[ModelSpec], variants: Sequence[FuzzySetMap] = (),
             weights: str | None = None, source: DataFrame | None = None, keep: Sequence[str] = (),
             ) -> Iterator[Training]:
    """What growth needs, over a cached base with a row per input row."""
    source = df if source is None else source
    coding = label_coding(source, spec.targets[0]) if spec.task == "class" else value_coding(source, spec.targets)
    counts = value_counts(source, spec.features, spec.categorical)
    edges = value_edges(source, spec.features, spec.categorical, spec.direct_limit, counts)
    gain = spec.gain_spec()
    if variants and not gain.soft:
        gain = replace(gain, soft=True)
    cats = frozenset(i for i, f in enumerate(spec.features) if f in set(spec.categorical))
    layout = Layout(tuple(spec.features), spec.task, coding.width, gain, cats,
                    frozenset(i for i, f in enumerate(spec.features) if f in edges),
                    masses_sql(spec.features, variants, models) if variants and gain.soft else "0D")
    base = base_rows(df, spec.features, spec.categorical, target_columns(coding, spec.targets), weights, edges, keep)
    if spec.task == "class":
        base = base.filter(F.col("yi") >= 0)
    if spec.cache:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Training(expand_models(base.drop(*keep), spec.features, models), layout, coding, base, counts,
                       few_values(counts, spec))
    finally:
        if spec.cache:
            base.unpersist()


def tree_of(rows: Sequence, coding: Coding, model: int = 0) -> Tree:
    """A tree from the rows of its node table."""
    tree: Tree = {}
    for r in rows:
        if r["class_counts"] is not None:
            stats = list(r["class_counts"])
        else:
            mean = r["leaf_mean"] or [0.0] * coding.width
            stats = [r["n"], *[(m - c) * r["n"] for m, c in zip(mean, coding.centres)]]
        node = int("1" + r["path"], 2)
        tree[node] = Node(model, node, r["depth"], stats, r["feature_idx"], r["split_num"], r["split_cat"], r["gain"],
                          seq=max(0, -1 - r["node_id"]))
    return tree


@dataclass
class TreeModel:
    """A fitted tree. ``transform`` is a projection and needs no fuzzification of new rows."""

    spec: TreeSpec
    tree: Tree
    coding: Coding

    def _vector(self, node: Node) -> list[float]:
        if self.spec.task == "value":
            return leaf_mean(node, self.coding)
        counts = node.stats[: self.coding.width]
        return [c / sum(counts) for c in counts]

    def leaf_vector(self) -> Column:
        """Class shares or output means of the leaf a row falls into."""
        if is_small([self.tree]):
            return tree_column(self.tree, self.spec.features,
                               lambda n: f"array({', '.join(map(num, self._vector(n)))})")
        return summed_leaves([self.tree], self.spec.features, self.spec.categorical, self._vector, self.coding.width)

    def leaf_id(self) -> Column:
        if is_small([self.tree]):
            return tree_column(self.tree, self.spec.features, lambda n: f"{n.id}L")
        return leaf_ids(self.tree, self.spec.features, self.spec.categorical)

    def prediction(self) -> Column:
        if self.spec.task == "class":
            if is_small([self.tree]):
                return tree_column(self.tree, self.spec.features, lambda n: value(leaf_label(n, self.coding)))
            at = summed_leaves([self.tree], self.spec.features, self.spec.categorical,
                               lambda n: [float(self.coding.labels.index(leaf_label(n, self.coding)))], 1)[0]
            return F.get(F.array(*[F.lit(v) for v in self.coding.labels]), at.cast("int"))
        if len(self.spec.targets) > 1:
            return self.leaf_vector()
        if is_small([self.tree]):
            return tree_column(self.tree, self.spec.features, lambda n: num(leaf_mean(n, self.coding)[0]))
        return self.leaf_vector()[0]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.prediction())

    def transform_proba(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (aligned with all labels), ``leaf_labels`` and ``leaf_proba``
        (only the labels present in the leaf, ascending)."""
        labels = F.array(*[F.lit(v) for v in self.coding.labels])
        present = F.filter(F.arrays_zip(labels.alias("label"), F.col("probability").alias("p")), lambda s: s["p"] > 0)
        return (
            df.withColumn("probability", self.leaf_vector())
            .withColumn("__present", present)
            .withColumn("leaf_labels", F.transform("__present", lambda s: s["label"]))
            .withColumn("leaf_proba", F.transform("__present", lambda s: s["p"]))
            .drop("__present")
        )

    def node_rows(self, model_id: int = 0) -> list[tuple]:
        out = []
        for node_id in sorted(self.tree):
            n = self.tree[node_id]
            counts = [float(c) for c in n.stats[: self.coding.width]] if self.spec.task == "class" else None
            size = sum(counts) if counts else float(n.stats[0])
            value = mean = labels = proba = None
            if n.is_leaf and self.spec.task == "class":
                value = str(leaf_label(n, self.coding))
                labels = [str(v) for v, c in zip(self.coding.labels, counts) if c > 0]
                proba = [c / size for c in counts if c > 0]
            elif n.is_leaf:
                mean = leaf_mean(n, self.coding)
                value = str(mean[0])
            kind = None if n.is_leaf else ("==" if n.cat is not None else ">=")
            out.append((model_id, n.id, n.depth, n.is_leaf, n.fi,
                        None if n.is_leaf else self.spec.features[n.fi], kind, n.num, n.cat, n.gain, size,
                        value, mean, labels, proba, counts, n.path))
        return out

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table, one row per node."""
        return spark.createDataFrame(self.node_rows(), NODE_SCHEMA)

    def rules(self, spark: SparkSession) -> DataFrame:
        """One row per leaf with the condition that leads to it."""
        out: list[tuple] = []

        todo: list[tuple[int, str]] = [(1, "")]
        while todo:
            node, path = todo.pop()
            at = self.tree[node]
            if at.is_leaf:
                label = str(leaf_label(at, self.coding)) if self.spec.task == "class" else None
                mean = None if self.spec.task == "class" else leaf_mean(at, self.coding)[0]
                size = sum(at.stats[: self.coding.width]) if self.spec.task == "class" else at.stats[0]
                out.append((at.id, path or "TRUE", float(size), label, mean))
                continue
            name = self.spec.features[at.fi]
            test = f"{name} == {at.cat}" if at.cat is not None else f"{name} >= {at.num!r}"
            before = f"{path} AND " if path else ""
            todo += [(2 * node + 1, f"{before}NOT {test}"), (2 * node, before + test)]
        return spark.createDataFrame(out, "leaf_id bigint, rule string, n double, label string, mean double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as tables; :meth:`load` scores with them again."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        label_type = "string" if not self.coding.labels else spark.createDataFrame(
            [(self.coding.labels[0],)]).schema[0].dataType.simpleString()
        head = [(list(self.spec.features), list(self.spec.targets), self.spec.task, self.spec.criterion,
                 list(self.spec.categorical), list(self.coding.labels), list(self.coding.centres))]
        spark.createDataFrame(head, f"features array<string>, targets array<string>, task string, criterion string, "
                                    f"categorical array<string>, labels array<{label_type}>, centres array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        sets = [(f, i, float(c), float(t)) for f, s in (self.spec.fuzzy_sets or {}).items() for i, (c, t) in enumerate(s)]
        spark.createDataFrame(sets, "feature string, set_id int, centroid double, theta double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/fuzzy_sets")

    @staticmethod
    def load_head(spark: SparkSession, path: str) -> tuple[TreeSpec, Coding]:
        head = spark.read.parquet(f"{path}/head").first()
        sets: dict[str, list] = {}
        for r in spark.read.parquet(f"{path}/fuzzy_sets").orderBy("feature", "set_id").collect():
            sets.setdefault(r["feature"], []).append((r["centroid"], r["theta"]))
        spec = TreeSpec(tuple(head["features"]), tuple(head["targets"]), head["task"], head["criterion"],
                        sets or None, tuple(head["categorical"]))
        return spec, Coding(tuple(head["labels"]), tuple(head["centres"]))

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        spec, coding = TreeModel.load_head(spark, path)
        return TreeModel(spec, tree_of(spark.read.parquet(f"{path}/nodes").collect(), coding), coding)

    def split_columns(self) -> list[Column]:
        """Tests of all inner nodes, for reports on how often each one passes."""
        return [split_test(self.spec.features[n.fi], n.num, n.cat).alias(f"node_{i}")
                for i, n in sorted(self.tree.items()) if not n.is_leaf]


def fit_soft_and_crisp(df: DataFrame, spec: TreeSpec) -> tuple[TreeModel, TreeModel]:
    """The soft tree of ``spec`` and the crisp one, grown in the same jobs."""
    forest, coding = fit_forest(df.withColumn("__mw", F.expr("array(struct(0 AS model, 1L AS w), struct(1 AS model, 1L AS w))")),
                                spec, [ModelSpec(0, 0), ModelSpec(1)], [spec.fuzzy_sets], "__mw", df)
    return TreeModel(spec, forest[0], coding), TreeModel(replace(spec, fuzzy_sets=None), forest[1], coding)


def fit_tree(df: DataFrame, spec: TreeSpec) -> TreeModel:
    """Train one classification or regression tree."""
    variants = [spec.fuzzy_sets] if spec.fuzzy_sets is not None else []
    forest, coding = fit_forest(df, spec, [ModelSpec(0, 0 if variants else None)], variants)
    return TreeModel(spec, forest[0], coding)


def fit_table_tree(df: DataFrame, spec: TreeSpec, driver_nodes: int = DRIVER_NODES) -> TableTree:
    """Train a tree of any size: beyond ``driver_nodes`` nodes, all that is known of nodes is a table."""
    variants = [spec.fuzzy_sets] if spec.fuzzy_sets is not None else []
    with training(df, spec, [ModelSpec(0, 0 if variants else None)], variants) as t:
        forest = grow(t.rows, t.layout, spec.rules, [0], limit=driver_nodes, subtract=t.few_values) if driver_nodes else None
        table = grow_tables(t.rows, t.layout, spec.rules, forest)
    return TableTree(tuple(spec.features), tuple(spec.categorical), spec.task, t.coding.labels, t.coding.centres, table)
