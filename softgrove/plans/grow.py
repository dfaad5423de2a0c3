"""Grow all trees of all models together, one level per Spark job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators import siblings
from softgrove.operators.manyclass import applies, best_splits_many
from softgrove.operators.splits import Layout, RowCounts, best_of_counts, best_splits
from softgrove.plans.route import Forest, Node, size_of, to_open_nodes, to_some_nodes


@dataclass(frozen=True)
class StopRules:
    """A node at depth d (root 0) is split only if d <= max_depth, so a tree has up
    to max_depth + 1 split levels; it needs ``min_samples_split`` weighted rows and
    a gain above ``min_gain``."""

    max_depth: float = float("inf")
    min_samples_split: int = 2
    min_gain: float = 1e-7


def _is_mixed(stats: list[float], layout: Layout) -> bool:
    if layout.task == "class":
        return sum(1 for c in stats[: layout.width] if c > 0) > 1
    n, o = stats[0], layout.width
    for i in range(o):
        mean, square = stats[1 + i] / n, stats[1 + o + i] / n
        if square - mean * mean > 1e-13 * square:
            return True
    return False


def node_count(stats: list[float], layout: Layout) -> float:
    return sum(stats[: layout.width]) if layout.task == "class" else stats[0]


def root_stats(rows: DataFrame, layout: Layout) -> dict[int, list[float]]:
    """Sums of the whole training set of each model."""
    found = rows.groupBy("model").agg(*layout.sums(soft=False)).collect()
    return {r["model"]: [r[s] for s in layout.crisp_stats] for r in found}


def class_counts(rows: DataFrame, layout: Layout) -> dict[tuple[int, int], list[float]]:
    """Class weights of every (model, node); map-side combined, one row per node and class."""
    out: dict[tuple[int, int], list[float]] = {}
    for r in rows.groupBy("model", "node", "yi").agg(F.expr("sum(w) AS c")).collect():
        out.setdefault((r["model"], r["node"]), [0.0] * layout.width)[r["yi"]] = r["c"]
    return out


def sibling_pairs(forest: Forest, depth: int) -> list[siblings.Pair]:
    """Children at ``depth`` by pairs, of which one at least may be split."""
    out = []
    for m, tree in forest.items():
        for n in tree.values():
            if n.depth != depth - 1 or n.is_leaf:
                continue
            pair = sorted((tree[2 * n.node], tree[2 * n.node + 1]), key=lambda c: sum(c.stats))
            if any(c.open for c in pair):
                out.append(siblings.Pair(m, n.id, pair[0].id, pair[1].id, pair[0].open, pair[1].open))
    return out


def grow(rows: DataFrame, layout: Layout, rules: StopRules, models: Sequence[int],
         search: Callable[[DataFrame, Layout], list] | None = None, limit: int | None = None, roots=None,
         subtract: bool = False) -> Forest:
    """Level-wise growth: every job scores all open nodes of all models at once.

    With ``limit``, growth ends after the level that brings more nodes; those that may be split still are open.
    ``roots`` is a source of counts for the roots of all models, if there is a cheaper one than the rows.
    With ``subtract``, the counts of each level are kept and the larger child's are parent minus sibling.

    Rows carry no state between levels; their node follows from the splits found
    so far, so a lost executor costs one re-read and the plan does not lengthen.
    The sums of a node come with its parent's split, those of a root with its own;
    with many classes they are counted by one more (narrow) job per level.
    """
    many = search is None and applies(layout)
    subtract = subtract and search is None and not many and siblings.applies(layout)
    kept = None
    search = search or (best_splits_many if many else best_splits)

    def is_open(stats: list[float], depth: int) -> bool:
        return (depth <= rules.max_depth and node_count(stats, layout) >= max(rules.min_samples_split, 2)
                and _is_mixed(stats, layout))

    forest: Forest = {m: {1: Node(m, 1, 0, [], open=rules.max_depth >= 0)} for m in sorted(models)}
    if many:
        for m, stats in root_stats(rows, layout).items():
            forest[m][1].stats, forest[m][1].open = stats, is_open(stats, 0)
    depth = 0
    while True:
        waiting = [n for t in forest.values() for n in t.values() if n.open]
        if not waiting or (limit is not None and depth and size_of(forest) > limit):
            break
        by_id = {(n.model, n.id): n for n in waiting}
        if subtract:
            if kept is None:
                kept = siblings.root_counts(roots or RowCounts(to_open_nodes(rows, forest), layout), layout)
            else:
                pairs = sibling_pairs(forest, depth)
                kept = siblings.child_counts(kept, to_some_nodes(rows, forest, {(p.model, p.counted) for p in pairs}), pairs, layout)
            found = best_of_counts(kept, layout)
        elif roots is not None and depth == 0 and not many:
            found = best_of_counts(roots, layout)
        else:
            found = search(to_open_nodes(rows, forest), layout)
        for n in waiting:
            n.open = False
        born: list[Node] = []
        for r in found:
            tree = forest[r["model"]]
            at = by_id[r["model"], r["node"]]
            if depth == 0 and not many:
                at.stats = [r[f"a_{s}"] for s in layout.crisp_stats]
                if not is_open(at.stats, 0):
                    continue
            if not r["gain"] > max(rules.min_gain, 0.0):
                continue
            at.fi, at.num, at.cat, at.gain = r["fi"], r["vmin"], r["cat"], r["gain"]
            for child, side in ((2 * at.node, "h"), (2 * at.node + 1, "r")):
                stats = [] if many else [r[f"{side}_{s}"] for s in layout.crisp_stats]
                tree[child] = Node(at.model, child, at.depth + 1, stats,
                                   open=many or is_open(stats, at.depth + 1), seq=len(tree))
                born.append(tree[child])
        if many and born:
            counted = class_counts(to_open_nodes(rows, forest), layout)
            for n in born:
                n.stats = counted[(n.model, n.id)]
                n.open = is_open(n.stats, n.depth)
        depth += 1
    bare = [m for m, t in forest.items() if not t[1].stats]
    if bare:  # roots without a single candidate
        found = root_stats(rows.filter(F.col("model").isin(bare)), layout)
        for m in bare:
            forest[m][1].stats = found.get(m, [0.0] * len(layout.crisp_stats))
    return forest
