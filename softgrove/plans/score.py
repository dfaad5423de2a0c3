"""Score tables with fitted trees; a narrow projection, so streams work as well.

Small models become nested conditions inside generated code. Models with more
nodes go to the executors as arrays and are walked a batch at a time with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from softgrove.functions.sqltext import clean_number, name, num, text
from softgrove.plans.route import INLINE_NODES, Forest, Node, Tree, passes, size_of

# Trees walked together; bounds the memory of a batch.
TREES_AT_ONCE = 32
# Nodes of the trees that one function holds (about 50 bytes each, and their values).
PART_NODES = 1_000_000
# Pairs of row and model walked together; bounds the memory of a batch.
PAIRS_AT_ONCE = 1_000_000


def test_sql(feature: str, number: float | None, cat: str | None) -> str:
    """Test of one split on a named column; missing values fail."""
    if cat is not None:
        return f"coalesce(cast({name(feature)} AS string) = {text(cat)}, false)"
    return f"coalesce({clean_number(feature)} >= {num(number)}, false)"


def split_test(feature: str, number: float | None, cat: str | None) -> Column:
    return F.expr(test_sql(feature, number, cat))


def tree_sql(tree: Tree, features: Sequence[str], payload: Callable[[Node], str], node: int = 1) -> str:
    """Leaf payload of a row as one nested condition."""
    at = tree[node]
    if at.is_leaf:
        return payload(at)
    return (f"if({test_sql(features[at.fi], at.num, at.cat)}, {tree_sql(tree, features, payload, 2 * node)}, "
            f"{tree_sql(tree, features, payload, 2 * node + 1)})")


def tree_column(tree: Tree, features: Sequence[str], payload: Callable[[Node], str]) -> Column:
    return F.expr(tree_sql(tree, features, payload))


def is_small(trees: Sequence[Tree]) -> bool:
    return sum(len(t) for t in trees) <= INLINE_NODES


def _pack(trees: Sequence[Tree], values: Callable[[Node], Sequence[float]], width: int) -> dict:
    """All trees in flat arrays; a leaf points to itself. Categories are numbered per feature."""
    order = [(i, n) for i, t in enumerate(trees) for n in sorted(t)]
    place = {key: p for p, key in enumerate(order)}
    size = len(order)
    codes: dict[int, dict[str, int]] = {}
    packed = {
        "fi": np.zeros(size, np.int32), "num": np.full(size, np.nan), "cat": np.full(size, -1, np.int32),
        "hit": np.arange(size), "rest": np.arange(size), "value": np.zeros((size, width)), "codes": codes,
        "id": np.array([trees[i][n].id for i, n in order], np.int64),
        "root": np.array([place[(i, 1)] for i in range(len(trees))]),
        "depth": max(n.depth for t in trees for n in t.values()),
    }
    for (i, node), p in place.items():
        at = trees[i][node]
        if at.is_leaf:
            packed["value"][p] = values(at)
            continue
        packed["fi"][p] = at.fi
        if at.cat is not None:
            known = codes.setdefault(at.fi, {})
            packed["cat"][p] = known.setdefault(at.cat, len(known))
        else:
            packed["num"][p] = at.num
        packed["hit"][p], packed["rest"][p] = place[(i, 2 * node)], place[(i, 2 * node + 1)]
    return packed


def _columns(batch: pa.StructArray, codes: dict[int, dict[str, int]]) -> tuple[np.ndarray, np.ndarray | None]:
    """Numbers and category numbers of a batch, features in rows."""
    n = batch.type.num_fields
    x = np.full((n, len(batch)), np.nan)
    xc = np.full((n, len(batch)), -2, np.int32) if codes else None
    for i in range(n):
        column = batch.field(i)
        if not pa.types.is_string(column.type):
            x[i] = column.to_numpy(zero_copy_only=False)
        elif i in codes:
            coded = column.dictionary_encode()
            number = np.array([*[codes[i].get(v, -2) for v in coded.dictionary.to_pylist()], -2], np.int32)
            xc[i] = number[coded.indices.fill_null(len(number) - 1).to_numpy(zero_copy_only=False)]
    return x, xc


def _leaves(packed: dict, roots: np.ndarray, x: np.ndarray, xc: np.ndarray | None) -> np.ndarray:
    """Leaf of every tree (rows) that each row (columns) reaches."""
    row = np.arange(x.shape[1])
    at = np.repeat(roots[:, None], x.shape[1], axis=1)
    for _ in range(packed["depth"]):
        fi = packed["fi"][at]
        with np.errstate(invalid="ignore"):
            go = x[fi, row] >= packed["num"][at]
        if xc is not None:
            go |= xc[fi, row] == packed["cat"][at]
        at = np.where(go, packed["hit"][at], packed["rest"][at])
    return at


def _features(features: Sequence[str], categorical: Sequence[str]) -> Column:
    cats = set(categorical)
    return F.struct(*[F.expr(f"cast({name(f)} AS string)" if f in cats else clean_number(f)).alias(f"f{i}")
                      for i, f in enumerate(features)])


def summed_leaves(trees: Sequence[Tree], features: Sequence[str], categorical: Sequence[str],
                  values: Callable[[Node], Sequence[float]], width: int,
                  weights: Sequence[float] | None = None) -> Column:
    """``array<double>``: weighted sum over trees of per-leaf values, for models of any size.

    The trees go to the executors in parts of at most PART_NODES nodes (or one tree), each a function of its own
    that adds up its trees; the sums of the parts are added per row.
    """
    scale = np.ones(len(trees)) if weights is None else np.asarray(weights, float)
    cuts, size = [0], 0
    for k, tree in enumerate(trees):
        if size and size + len(tree) > PART_NODES:
            cuts.append(k)
            size = 0
        size += len(tree)
    parts = [_summed_part(trees[a:b], features, categorical, values, width, scale[a:b])
             for a, b in zip(cuts, [*cuts[1:], len(trees)])]
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda a, b: a + b)
    return out


def _summed_part(trees: Sequence[Tree], features: Sequence[str], categorical: Sequence[str],
                 values: Callable[[Node], Sequence[float]], width: int, scale: np.ndarray) -> Column:
    packed = _pack(trees, values, width)

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        x, xc = _columns(batch, packed["codes"])
        out = np.zeros((len(batch), width))
        for k in range(0, len(scale), TREES_AT_ONCE):
            at = _leaves(packed, packed["root"][k:k + TREES_AT_ONCE], x, xc)
            for weight, leaf in zip(scale[k:k + TREES_AT_ONCE], at):
                out += weight * packed["value"][leaf]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * width, pa.int32()), pa.array(out.ravel()))

    return run(_features(features, categorical))


def running_leaves(trees: Sequence[Tree], features: Sequence[str], categorical: Sequence[str],
                   values: Callable[[Node], Sequence[float]], weights: Sequence[float]) -> Column:
    """``array<double>``: the weighted sum of a single leaf value after each tree."""
    scale = np.asarray(weights, float)[:, None]
    packed = _pack(trees, values, 1)

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        x, xc = _columns(batch, packed["codes"])
        added = np.empty((len(scale), len(batch)))
        for k in range(0, len(scale), TREES_AT_ONCE):
            at = _leaves(packed, packed["root"][k:k + TREES_AT_ONCE], x, xc)
            added[k:k + TREES_AT_ONCE] = scale[k:k + TREES_AT_ONCE] * packed["value"][at, 0]
        out = np.cumsum(added, axis=0).T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(scale), pa.int32()), pa.array(out.ravel()))

    return run(_features(features, categorical))


def leaf_ids(tree: Tree, features: Sequence[str], categorical: Sequence[str]) -> Column:
    """Id of the leaf of a big tree, as BIGINT."""
    packed = _pack([tree], lambda n: (), 0)

    @F.arrow_udf("bigint")
    def run(batch: pa.Array) -> pa.Array:
        x, xc = _columns(batch, packed["codes"])
        return pa.array(packed["id"][_leaves(packed, packed["root"], x, xc)[0]])

    return run(_features(features, categorical))


def leaves_by_model(forest: Forest, values: Callable[[Node], Sequence[float]], width: int, categorical: bool,
                    alone: bool = False) -> Column:
    """``array<array<double>>``: leaf values of a row in the tree of each entry of its array ``mw`` (NULL without a tree).

    The row has ``x`` (and ``xc``) of :func:`softgrove.plans.frame.feature_arrays`; ``alone`` says that ``mw`` always
    holds exactly the one model. Large forests are walked in parts of at most PART_NODES nodes (or one tree).
    """
    if size_of(forest) <= INLINE_NODES:
        def leaf(tree: Tree, node: int) -> str:
            at = tree[node]
            if at.is_leaf:
                return f"array({', '.join(num(v) for v in values(at))})"
            return f"if({passes(at.fi, at.num, at.cat)}, {leaf(tree, 2 * node)}, {leaf(tree, 2 * node + 1)})"

        if alone and len(forest) == 1:
            return F.expr(f"array({leaf(next(iter(forest.values())), 1)})")
        cases = " ".join(f"WHEN {m} THEN {leaf(t, 1)}" for m, t in sorted(forest.items()))
        return F.expr(f"transform(mw, s -> CASE s.model {cases} END)")
    parts: list[list[int]] = []
    size = 0
    for m in sorted(forest):
        if not parts or size + len(forest[m]) > PART_NODES:
            parts.append([])
            size = 0
        parts[-1].append(m)
        size += len(forest[m])
    out = None
    for part in parts:
        found = _leaves_part({m: forest[m] for m in part}, values, width, categorical)
        out = found if out is None else F.zip_with(out, found, lambda a, b: F.coalesce(a, b))
    return out


def _leaves_part(forest: Forest, values: Callable[[Node], Sequence[float]], width: int, categorical: bool) -> Column:
    models = np.array(sorted(forest))
    packed = _pack([forest[m] for m in models], values, width)

    def walk(at: np.ndarray, row: np.ndarray, x: np.ndarray, xc: np.ndarray | None) -> np.ndarray:
        for _ in range(packed["depth"]):
            fi = packed["fi"][at]
            with np.errstate(invalid="ignore"):
                go = x[row, fi] >= packed["num"][at]
            if xc is not None:
                go |= xc[row, fi] == packed["cat"][at]
            at = np.where(go, packed["hit"][at], packed["rest"][at])
        return at

    @F.arrow_udf("array<array<double>>")
    def run(batch: pa.Array) -> pa.Array:
        n, held = len(batch), batch.field("m")
        x = batch.field("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1 if n else 0)
        model = held.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(held.offsets.to_numpy())
        rows = np.repeat(np.arange(n), sizes)
        place = np.minimum(np.searchsorted(models, model), len(models) - 1)
        xc = None
        if packed["codes"]:
            flat, n_features = batch.field("xc").flatten(), x.shape[1]
            xc = np.full(x.shape, -2, np.int32)
            for i, known in packed["codes"].items():
                column = flat.take(pa.array(np.arange(n) * n_features + i))
                xc[:, i] = [known.get(v, -2) for v in column.to_pylist()]
        at = packed["root"][place]
        for k in range(0, len(at), PAIRS_AT_ONCE):
            part = slice(k, k + PAIRS_AT_ONCE)
            at[part] = walk(at[part], rows[part], x, xc)
        leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()),
                                          pa.array(packed["value"][at].ravel()), mask=pa.array(models[place] != model))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), leaves)

    fields = [F.col("x"), F.col("mw")["model"].alias("m"), *([F.col("xc")] if categorical else [])]
    return run(F.struct(*fields))
