"""Trees whose nodes are tables: grown and walked without a node on the driver.

Each level is a table of the rows of the open nodes with their node, and a table
of the best splits of these nodes. A join of the two moves the rows to their
children; rows of closed children are left behind. Splits and nodes are appended
to the node table, level by level, in the shared folder, so a lost executor
costs a re-read of one level. The driver sees one number per level, that of the
nodes still open.

A node's row holds its split and the ids of its children, or nothing if it is a
leaf, and its sums. Ids are heap numbers to level 61; deeper children get
negative numbers made of level, task and place, unique within a level.

Rows are scored the same way, one join per level against the splits of that
level, cut every few levels by a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.functions.sqltext import num, value
from softgrove.operators.manyclass import applies, best_many_table
from softgrove.operators.splits import KEYS, Layout, best_table
from softgrove.plans.frame import feature_arrays
from softgrove.plans.grow import StopRules
from softgrove.plans.route import HEAP_DEPTH, Forest, to_open_nodes
from softgrove.session import scratch_path, stored

#: Levels walked in one plan when rows are scored.
LEVELS_AT_ONCE = 6
NODE_TABLE = ("model int, depth int, node bigint, path string, fi int, num double, cat string, gain double, hit bigint, "
              "rest bigint, stats array<double>")


#: columns of a split that a leaf has not
_LEAF = [f"cast(NULL AS {t}) AS {c}" for t, c in (("int", "fi"), ("double", "num"), ("string", "cat"), ("double", "gain"),
                                                 ("bigint", "hit"), ("bigint", "rest"))]


def open_sql(layout: Layout, rules: StopRules, depth: int, stats: str = "stats") -> str:
    """Whether a node with these sums may be split: SQL of the stop rules."""
    if depth > rules.max_depth:
        return "false"
    w = layout.width
    least = num(max(rules.min_samples_split, 2))
    if layout.task == "class":
        return (f"(aggregate({stats}, 0D, (a, c) -> a + c) >= {least} AND size(filter({stats}, c -> c > 0)) > 1)")
    spread = [f"get({stats}, {1 + w + i}) / get({stats}, 0) - pow(get({stats}, {1 + i}) / get({stats}, 0), 2) > "
              f"1e-13D * get({stats}, {1 + w + i}) / get({stats}, 0)" for i in range(w)]
    return f"(get({stats}, 0) >= {least} AND ({' OR '.join(spread)}))"


def child_id(node: str, side: int, depth: int) -> str:
    """Id of a child at ``depth``; ``__at`` numbers the parents of a level where heap numbers end."""
    if depth <= HEAP_DEPTH:
        return f"2 * {node} + {side}"
    return f"-1 - ((2 * __at + {side}) * {1 << 13} + {depth % (1 << 13)})"


def _counted(rows: DataFrame, layout: Layout) -> DataFrame:
    """Class weights of every node as ``stats``."""
    per = rows.groupBy(*KEYS, "yi").agg(F.expr("sum(w) AS c"))
    return per.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("yi", "c"))).alias("m")).selectExpr(
        *KEYS, f"transform(sequence(0, {layout.width - 1}), i -> coalesce(element_at(m, i), 0D)) AS stats")


def _root(rows: DataFrame, layout: Layout) -> DataFrame:
    """Sums of every node of ``rows``."""
    if layout.task == "class":
        return _counted(rows, layout)
    return rows.groupBy(*KEYS).agg(*layout.sums(soft=False)).selectExpr(*KEYS, f"array({', '.join(layout.crisp_stats)}) AS stats")


def _moved(rows: DataFrame, splits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows at the child their node's split sends them to, with whether that one is open."""
    s = splits.selectExpr("model", "node", "fi AS __fi", "num AS __num", "cat AS __cat", "hit AS __hit", "rest AS __rest",
                          "hit_open AS __hit_open", "rest_open AS __rest_open")
    test = "get(x, __fi) >= __num"
    if "xc" in columns:
        test = f"if(__cat IS NOT NULL, get(xc, __fi) = __cat, {test})"
    return rows.join(s, list(KEYS)).withColumn("__go", F.expr(f"coalesce({test}, false)")).selectExpr(
        *[c for c in columns if c != "node"], "if(__go, __hit, __rest) AS node", "if(__go, __hit_open, __rest_open) AS __open")


class NodeTable:
    """Node table of grown trees: a folder with a part per level."""

    def __init__(self, spark: SparkSession, path: str, depth: int):
        self.spark, self.path, self.depth = spark, path, depth

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODE_TABLE).parquet(self.path)

    def level(self, depth: int) -> DataFrame:
        return self.nodes.filter(F.col("depth") == depth)

    def walk(self, rows: DataFrame, model: int | None = None) -> DataFrame:
        """Every row with the ``node`` and ``stats`` of its leaf; ``rows`` has x [, xc] and, unless given, model."""
        if model is not None:
            rows = rows.withColumn("model", F.lit(model))
        out = rows.withColumns({"node": F.lit(1).cast("bigint"), "__on": F.lit(True)})
        test = "get(x, __fi) >= __num"
        if "xc" in rows.columns:
            test = f"if(__cat IS NOT NULL, get(xc, __fi) = __cat, {test})"
        for d in range(self.depth):
            splits = self.level(d).filter("fi IS NOT NULL").selectExpr(
                "model", "node", "fi AS __fi", "num AS __num", "cat AS __cat", "hit AS __hit", "rest AS __rest")
            if d and d % LEVELS_AT_ONCE == 0:
                out = stored(out, "walked")
            out = out.withColumn("__key", F.when(F.col("__on"), F.col("node")))
            splits = splits.withColumnsRenamed({"node": "__key"})
            out = out.join(splits, ["model", "__key"], "left").withColumn("__on", F.expr("__on AND __fi IS NOT NULL"))
            out = out.withColumn("node", F.expr(f"if(__on, if(coalesce({test}, false), __hit, __rest), node)")).withColumn(
                "__depth", F.expr(f"if(__on, {d + 1}, {'__depth' if d else '0'})"))
            out = out.drop("__fi", "__num", "__cat", "__hit", "__rest", "__key")
        if not self.depth:
            out = out.withColumn("__depth", F.lit(0))
        leaves = self.nodes.filter("fi IS NULL").selectExpr("model", "depth AS __depth", "node", "stats")
        return out.join(leaves, ["model", "__depth", "node"], "left").drop("__on", "__depth")


def grow_tables(rows: DataFrame, layout: Layout, rules: StopRules, forest: Forest | None = None) -> NodeTable:
    """Grow on, from the roots of all models or from the open nodes of ``forest``, with tables as the only state.

    ``rows`` are expanded rows (model, w, targets, x [, xc, xb], fs).
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "nodes")
    many = applies(layout)
    columns = [*rows.columns, "node"]
    if forest is None:
        depth = 0
        state = rows.withColumn("node", F.lit(1).cast("bigint"))
        nodes = _root(state, layout).withColumn("path", F.lit(""))
    else:
        found = [n for t in forest.values() for n in t.values()]
        depth = max(n.depth for n in found)
        closed = [(n.model, n.depth, n.id, n.path, n.fi, None if n.num is None else float(n.num), n.cat, n.gain,
                   None if n.is_leaf else forest[n.model][2 * n.node].id,
                   None if n.is_leaf else forest[n.model][2 * n.node + 1].id, [float(s) for s in n.stats])
                  for n in found if not n.open]
        spark.createDataFrame(closed, NODE_TABLE).write.mode("append").parquet(path)
        state = to_open_nodes(rows, forest)
        nodes = spark.createDataFrame([(n.model, n.id, n.path, [float(s) for s in n.stats]) for n in found if n.open],
                                      "model int, node bigint, path string, stats array<double>")
    nodes = stored(nodes.withColumn("is_open", F.expr(open_sql(layout, rules, depth))), "roots")
    _append(nodes.filter("NOT is_open").selectExpr("model", f"{depth} AS depth", "node", "path", *_LEAF, "stats"), path)
    opened = nodes.filter("is_open").drop("is_open")
    if opened.isEmpty():
        return NodeTable(spark, path, depth)
    state = stored(state, "rows")
    while True:
        best = (best_many_table if many else best_table)(state, layout).filter(f"gain > {num(max(rules.min_gain, 0.0))}")
        sums = [] if many else [f"array({', '.join(f'{p}_{s}' for s in layout.crisp_stats)}) AS {p}_stats" for p in ("h", "r")]
        best = opened.join(best.selectExpr(*KEYS, "fi AS fi", "vmin AS num", "cat AS cat", "gain AS gain", *sums), list(KEYS))
        if depth + 1 > HEAP_DEPTH:
            best = stored(best.withColumn("__at", F.monotonically_increasing_id()), "numbered")
        best = best.selectExpr("*", f"{child_id('node', 0, depth + 1)} AS hit", f"{child_id('node', 1, depth + 1)} AS rest")
        if many:  # the classes of the children are counted where the rows arrive
            best = stored(best, "found")
            state = stored(_moved(state, best.withColumns({"hit_open": F.lit(True), "rest_open": F.lit(True)}), columns)
                           .drop("__open"), "rows")
            counted = stored(_counted(state, layout), "classes")
            for side, p in (("hit", "h"), ("rest", "r")):
                best = best.join(counted.withColumnsRenamed({"node": side, "stats": f"{p}_stats"}), ["model", side])
        best = best.withColumns({f"{side}_open": F.expr(f"coalesce({open_sql(layout, rules, depth + 1, f'{p}_stats')}, false)")
                                 for side, p in (("hit", "h"), ("rest", "r"))})
        best = stored(best, "splits")
        inner = best.selectExpr("model", f"{depth} AS depth", "node", "path", "fi", "num", "cat", "gain", "hit", "rest", "stats")
        unsplit = opened.join(best.select(*KEYS), list(KEYS), "left_anti").selectExpr(
            "model", f"{depth} AS depth", "node", "path", *_LEAF, "stats")
        born = best.selectExpr("model", "inline(array(struct(hit AS node, concat(path, '0') AS path, h_stats AS stats, hit_open AS is_open), "
                                        "struct(rest AS node, concat(path, '1') AS path, r_stats AS stats, rest_open AS is_open)))")
        closed = born.filter("NOT is_open").selectExpr("model", f"{depth + 1} AS depth", "node", "path", *_LEAF, "stats")
        _append(inner.unionByName(unsplit).unionByName(closed), path)
        n_split, n_open = best.agg(F.count("*"), F.expr("sum(int(hit_open) + int(rest_open))")).first()
        depth += bool(n_split)
        if not n_open:
            return NodeTable(spark, path, depth)
        opened = born.filter("is_open").drop("is_open")
        if many:
            state = state.join(opened.select(*KEYS), list(KEYS), "left_semi")
        else:
            state = stored(_moved(state, best.filter("hit_open OR rest_open"), columns).filter("__open").drop("__open"), "rows")


def _append(part: DataFrame, path: str) -> None:
    part.write.mode("append").parquet(path)


@dataclass
class TableTree:
    """A fitted tree of any size; ``nodes`` and predictions are tables."""

    features: tuple[str, ...]
    categorical: tuple[str, ...]
    task: str
    labels: tuple
    centres: tuple[float, ...]
    table: NodeTable

    def prediction(self) -> str:
        """SQL over the ``stats`` of a leaf: smallest of the most frequent labels, or means."""
        if self.task == "class":
            known = f"array({', '.join(value(v) for v in self.labels)})"
            return f"get({known}, cast(array_position(stats, array_max(stats)) - 1 AS int))"
        means = [f"{num(c)} + get(stats, {1 + i}) / get(stats, 0)" for i, c in enumerate(self.centres)]
        return means[0] if len(means) == 1 else f"array({', '.join(means)})"

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with the prediction of the tree; one join per level."""
        own = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"),
                        *[c.alias(n) for n, c in feature_arrays(self.features, self.categorical).items()])
        out = self.table.walk(own, 0).withColumn("__p", F.expr(self.prediction()))
        return out.select(*[F.col("__row")[c].alias(c) for c in df.columns], F.col("__p").alias(prediction))

    def nodes(self) -> DataFrame:
        """One row per node: path, split, gain, number of rows and, for leaves, what it predicts."""
        names = f"array({', '.join(value(f) for f in self.features)})"
        size = "aggregate(stats, 0D, (a, c) -> a + c)" if self.task == "class" else "get(stats, 0)"
        return self.table.nodes.selectExpr(
            "model AS model_id", "node AS node_id", "depth", "path", "fi IS NULL AS is_leaf", f"get({names}, fi) AS feature",
            "num AS split_num", "cat AS split_cat", "gain", f"{size} AS n", f"if(fi IS NULL, {self.prediction()}, NULL) AS leaf_value")

    def rules(self) -> DataFrame:
        """One row per leaf with its condition, joined level by level from the leaves' ancestors."""
        names = f"array({', '.join(value(f) for f in self.features)})"
        inner = self.table.nodes.filter("fi IS NOT NULL").selectExpr(
            "path AS p", f"concat(get({names}, fi), if(cat IS NULL, concat(' >= ', num), concat(' == ', cat))) AS test")
        leaves = self.table.nodes.filter("fi IS NULL").selectExpr("path", "node AS leaf_id", "stats")
        steps = leaves.withColumn("d", F.explode(F.expr("if(path = '', array(), sequence(0, length(path) - 1))")))
        steps = steps.withColumn("p", F.expr("substring(path, 1, d)")).join(inner, "p")
        said = steps.groupBy("path").agg(F.expr(
            "array_join(transform(array_sort(collect_list(struct(d, if(substring(path, d + 1, 1) = '0', test, "
            "concat('NOT ', test)) AS t))), s -> s.t), ' AND ') AS rule"))
        return leaves.join(said, "path", "left").selectExpr(
            "leaf_id", "coalesce(rule, 'TRUE') AS rule", f"{self.prediction()} AS prediction")

    def save(self, path: str) -> None:
        self.table.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        head = [(list(self.features), list(self.categorical), self.task, [value(v) for v in self.labels], list(self.centres),
                 self.table.depth)]
        self.table.spark.createDataFrame(
            head, "features array<string>, categorical array<string>, task string, labels array<string>, "
                  "centres array<double>, depth int").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TableTree:
        h = spark.read.parquet(f"{path}/head").first()
        labels = tuple(spark.range(1).select(*[F.expr(v) for v in h["labels"]]).first()) if h["labels"] else ()
        return TableTree(tuple(h["features"]), tuple(h["categorical"]), h["task"], labels, tuple(h["centres"]),
                         NodeTable(spark, f"{path}/nodes", h["depth"]))
