"""Move rows down grown trees: nested conditions for small models, joins for big ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.functions.sqltext import num, text

# Nodes up to which a model becomes one nested condition (larger ones would not be compiled).
INLINE_NODES = 256
BROADCAST_NODES = 200_000


# Depth up to which a heap id is a BIGINT.
HEAP_DEPTH = 61


@dataclass
class Node:
    """A node; ``node`` is its heap number: root 1, passing child 2n, other child 2n+1, of any length.

    Tables know it by ``id``: the heap number, or for deeper nodes a negative
    number in the order of creation within the tree.
    """

    model: int
    node: int
    depth: int
    stats: list[float]
    fi: int | None = None
    num: float | None = None
    cat: str | None = None
    gain: float | None = None
    open: bool = False  # may still be split
    seq: int = 0

    @property
    def is_leaf(self) -> bool:
        return self.fi is None

    @property
    def id(self) -> int:
        return self.node if self.depth <= HEAP_DEPTH else -1 - self.seq

    @property
    def path(self) -> str:
        """A digit per level: 0 for the passing side, 1 for the other."""
        return f"{self.node:b}"[1:]


Tree = dict[int, Node]
Forest = dict[int, Tree]


def passes(fi: int, number: float | None, cat: str | None) -> str:
    """Split test on the feature arrays; missing values fail."""
    if cat is not None:
        return f"coalesce(get(xc, {fi}) = {text(cat)}, false)"
    return f"coalesce(get(x, {fi}) >= {num(number)}, false)"


def _open_node(tree: Tree, node: int) -> str:
    at = tree[node]
    if at.is_leaf:
        return f"{at.id}L" if at.open else "cast(NULL AS bigint)"
    return f"if({passes(at.fi, at.num, at.cat)}, {_open_node(tree, 2 * node)}, {_open_node(tree, 2 * node + 1)})"


def size_of(forest: Forest) -> int:
    return sum(len(t) for t in forest.values())


def to_open_nodes(rows: DataFrame, forest: Forest) -> DataFrame:
    """Rows that sit in a node still to be split, with its id as ``node``."""
    if size_of(forest) <= INLINE_NODES:
        models = sorted(forest)
        if len(models) == 1:
            node = _open_node(forest[models[0]], 1)
        else:
            node = f"CASE model {' '.join(f'WHEN {m} THEN {_open_node(forest[m], 1)}' for m in models)} END"
        return rows.selectExpr("*", f"{node} AS node").filter("node IS NOT NULL")
    return _join_open_nodes(rows, forest)


def to_some_nodes(rows: DataFrame, forest: Forest, wanted: set[tuple[int, int]]) -> DataFrame:
    """Rows that sit in one of the leaves ``wanted`` (model, id), whether or not these may be split."""
    leaves = [n for t in forest.values() for n in t.values() if n.is_leaf]
    before = [n.open for n in leaves]
    for n in leaves:
        n.open = (n.model, n.id) in wanted
    try:
        return to_open_nodes(rows, forest)
    finally:
        for n, was in zip(leaves, before):
            n.open = was


def _advance(rows: DataFrame, splits: list[tuple], how: str) -> DataFrame:
    """One level down: join the splits of the level and move to the child.

    Splits are model metadata of known number; they are broadcast up to
    BROADCAST_NODES and otherwise joined by shuffle.
    """
    table = rows.sparkSession.createDataFrame(
        splits, "model int, node bigint, __fi int, __num double, __cat string, __hit bigint, __rest bigint")
    if len(splits) <= BROADCAST_NODES:
        table = F.broadcast(table)
    test = "get(x, __fi) >= __num"
    if "xc" in rows.columns:
        test = f"if(__cat IS NOT NULL, get(xc, __fi) = __cat, {test})"
    moved = rows.join(table, ["model", "node"], how).withColumn(
        "node", F.expr(f"if(__fi IS NULL, node, if(coalesce({test}, false), __hit, __rest))"))
    if how == "inner":
        moved = moved.filter("node IS NOT NULL")
    return moved.drop("__fi", "__num", "__cat", "__hit", "__rest")


def _level_splits(forest: Forest, depth: int, closed: bool) -> list[tuple]:
    """Splits of a level with the ids of their children; without ``closed``, only those still to be split or passed."""
    out = []
    for m, tree in forest.items():
        for n in tree.values():
            if n.depth == depth and not n.is_leaf:
                hit, rest = [c.id if closed or not c.is_leaf or c.open else None
                             for c in (tree[2 * n.node], tree[2 * n.node + 1])]
                out.append((m, n.id, n.fi, None if n.num is None else float(n.num), n.cat, hit, rest))
    return out


def split_depth(forest: Forest) -> int:
    """Number of split levels of the deepest tree."""
    return max((n.depth + 1 for t in forest.values() for n in t.values() if not n.is_leaf), default=0)


def _join_open_nodes(rows: DataFrame, forest: Forest) -> DataFrame:
    """Rows of closed branches drop out on the way: all open nodes lie on the last level."""
    roots = [m for m, t in forest.items() if not t[1].is_leaf or t[1].open]
    out = rows.filter(F.col("model").isin(roots)).withColumn("node", F.lit(1).cast("bigint"))
    for d in range(split_depth(forest)):
        out = _advance(out, _level_splits(forest, d, False), "inner")
    return out


def to_leaves(rows: DataFrame, forest: Forest) -> DataFrame:
    """Every row with the leaf of its model as ``node``."""
    if size_of(forest) <= INLINE_NODES:
        def leaf(tree: Tree, node: int) -> str:
            at = tree[node]
            if at.is_leaf:
                return f"{at.id}L"
            return f"if({passes(at.fi, at.num, at.cat)}, {leaf(tree, 2 * node)}, {leaf(tree, 2 * node + 1)})"

        models = sorted(forest)
        cases = " ".join(f"WHEN {m} THEN {leaf(forest[m], 1)}" for m in models)
        node = leaf(forest[models[0]], 1) if len(models) == 1 else f"CASE model {cases} END"
        return rows.selectExpr("*", f"{node} AS node")
    out = rows.withColumn("node", F.lit(1).cast("bigint"))
    for d in range(split_depth(forest)):
        out = _advance(out, _level_splits(forest, d, True), "left")
    return out


def leaf_values(rows: DataFrame, forest: Forest, values: Callable[[Node], Sequence[float]], out: str) -> DataFrame:
    """Every row with an ``array<double>`` of values of the leaf it falls into."""
    if size_of(forest) <= INLINE_NODES:
        def leaf(tree: Tree, node: int) -> str:
            at = tree[node]
            if at.is_leaf:
                return f"array({', '.join(num(v) for v in values(at))})"
            return f"if({passes(at.fi, at.num, at.cat)}, {leaf(tree, 2 * node)}, {leaf(tree, 2 * node + 1)})"

        models = sorted(forest)
        cases = " ".join(f"WHEN {m} THEN {leaf(forest[m], 1)}" for m in models)
        return rows.selectExpr("*", (leaf(forest[models[0]], 1) if len(models) == 1 else f"CASE model {cases} END")
                               + f" AS {out}")
    leaves = [(m, n.id, [float(v) for v in values(n)]) for m, t in forest.items() for n in t.values() if n.is_leaf]
    table = rows.sparkSession.createDataFrame(leaves, f"model int, node bigint, {out} array<double>")
    if len(leaves) <= BROADCAST_NODES:
        table = F.broadcast(table)
    return to_leaves(rows, forest).join(table, ["model", "node"], "left").drop("node")
