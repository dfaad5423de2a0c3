"""Split candidates for many classes at a cost that does not grow with their number.

Gini and entropy depend on the class masses c of a side only through its total
and the sum of f(c), with f(c) = c^2 or c log2 c. Going down the values, a row of
class y changes one term of that sum, from f(C_y - c) to f(C_y). Two running sums
(per class, then over all) replace one running sum per class. With value buckets
both are made in two steps, over buckets and inside them. A category is compared
with the class totals of its node and needs no running sum.

Where the number of classes is not known (``width`` 0), rows are dealt by class
once, with all their features, and a task sorts its classes itself; only classes
too large for a task are counted by value and summed up in buckets. A class that
is cut into l and r holds g(l, r) = l log2((l + r) / l) + r log2((l + r) / r) bits
about the sides. Rows change g of one class; these changes are whole multiples of
a small unit, so their sums are exact in any order, at both ends of the values too,
and the sums over all go along one row per distinct value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.splits import KEYS, TIE_DIGITS, Layout, unroll
from softgrove.session import stored

# Up to this many classes one running sum per class is cheaper.
WIDE_CLASSES = 4
#: Features times rows up to which a class of a node is sorted in one task, and what a task gets about.
LIGHT_CELLS = 1 << 20
DEALT_CELLS = 1 << 21
#: Large classes that are broadcast; more are joined by shuffle.
BROADCAST_CLASSES = 200_000
OUT_ROWS = 1 << 16
BUCKET_OF_MISSING = -1


def _square(c: str) -> str:
    return f"({c}) * ({c})"


def _xlogx(c: str) -> str:
    return f"if(({c}) > 0, ({c}) * log2({c}), 0D)"


# criterion -> (term f of one class, count times impurity from total n and sum of terms s)
SEPARABLE = {
    "gini": (_square, lambda n, s: f"({n} - {s} / {n})"),
    "entropy": (_xlogx, lambda n, s: f"({n} * log2({n}) - {s})"),
}


def applies(layout: Layout) -> bool:
    return (layout.task == "class" and layout.width > WIDE_CLASSES and layout.gain.gain is None
            and layout.gain.criterion in SEPARABLE)


def _running(df: DataFrame, part: list[str], masses: dict[str, str], bucketed: bool) -> DataFrame:
    """Adds, for each ``out: mass``, the sum of ``mass`` over all values down to the row's (``out``) and over all
    (``all_out``), per group ``part``.

    With buckets, the sums of whole buckets are added up first and joined, so that a
    window holds one bucket; without, a group has few values.
    """
    every = ", ".join(part)
    if not bucketed:
        return df.selectExpr("*", *[
            e for out, mass in masses.items() for e in (
                f"sum({mass}) OVER (PARTITION BY {every} ORDER BY ord DESC NULLS LAST) AS {out}",
                f"sum({mass}) OVER (PARTITION BY {every}) AS all_{out}")])
    whole = df.groupBy(*part, "b").agg(*[F.expr(f"sum({mass}) AS in_{out}") for out, mass in masses.items()])
    before = f"OVER (PARTITION BY {every} ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = whole.selectExpr(*part, "b", *[
        e for out in masses for e in (f"coalesce(sum(in_{out}) {before}, 0) AS before_{out}",
                                      f"sum(in_{out}) OVER (PARTITION BY {every}) AS all_{out}")])
    inside = f"OVER (PARTITION BY {every}, b ORDER BY ord DESC NULLS LAST)"
    return df.join(whole, [*part, "b"]).selectExpr(
        "*", *[f"before_{out} + sum({mass}) {inside} AS {out}" for out, mass in masses.items()]) \
        .drop(*[f"before_{out}" for out in masses])


def _numeric(long: DataFrame, layout: Layout, tags: dict[str, str]) -> DataFrame:
    """Candidates "value >= v": totals and sums of terms of the passing side and of the node, for each kind of mass."""
    f, _ = SEPARABLE[layout.gain.criterion]
    bucket = "if(num IS NULL, -1, coalesce(bkt, 0))" if layout.bucketed else "0"
    hist = long.groupBy(*KEYS, "fi", F.col("num").alias("ord"), F.expr(f"{bucket} AS b"), "yi").agg(F.expr("sum(w) AS c"))
    if "g" in tags:
        hist = hist.withColumn("num", F.col("ord")).selectExpr("*", f"c * {layout.masses} AS g").drop("num")
    group = [*KEYS, "fi"]
    hist = _running(hist, [*group, "yi"], {f"run_{t}": mass for t, mass in tags.items()}, bool(layout.bucketed))
    changed = []
    for t, mass in tags.items():
        run, left = f"run_{t}", f"greatest(0D, all_run_{t} - run_{t})"
        changed += [f"{f(run)} - {f(f'greatest(0D, {run} - {mass})')} AS up_{t}", f"{f(left)} - {f(f'{left} + {mass}')} AS down_{t}"]
    hist = hist.selectExpr("*", *changed)
    sums = {out: mass for t, own in tags.items()
            for out, mass in ((f"h_{t}", own), (f"hs_{t}", f"up_{t}"), (f"ds_{t}", f"down_{t}"))}
    hist = _running(hist, group, sums, bool(layout.bucketed))
    return hist.selectExpr(*group, "ord AS vmin", "cast(NULL AS string) AS cat",
                           *[f"{x}_{t}" for t in tags for x in ("h", "hs", "ds")],
                           *[e for t in tags for e in (f"all_h_{t} AS a_{t}", f"all_hs_{t} AS as_{t}")])


def _categories(long: DataFrame, layout: Layout, tags: dict[str, str]) -> DataFrame:
    """Candidates "equals this category", by grouping and a join with the class totals; no window."""
    f, _ = SEPARABLE[layout.gain.criterion]
    group = [*KEYS, "fi"]
    hist = long.groupBy(*group, "cat", "yi").agg(F.expr("sum(w) AS c"))
    classes = hist.groupBy(*group, "yi").agg(F.sum("c").alias("all_c"))
    whole = classes.groupBy(*group).agg(F.sum("all_c").alias("a_n"), F.expr(f"sum({f('all_c')}) AS as_n"))
    values = hist.join(classes, [*group, "yi"]).groupBy(*group, "cat").agg(
        F.sum("c").alias("h_n"), F.expr(f"sum({f('c')}) AS hs_n"),
        F.expr(f"sum({f('greatest(0D, all_c - c)')} - {f('all_c')}) AS ds_n"))
    none = [f"0D AS {x}_{t}" for t in tags if t != "n" for x in ("h", "hs", "ds", "a", "as")]  # texts have no membership
    return values.join(whole, group).selectExpr("*", "cast(NULL AS double) AS vmin", *none)


def cut_bits(left: str, right: str) -> str:
    """SQL of the bits of ``left`` + ``right`` rows about their side; keeps its digits where one side is small."""
    return (f"if(({left}) > 0 AND ({right}) > 0, (({left}) * log1p(({right}) / ({left})) + ({right}) * "
            f"log1p(({left}) / ({right}))) / {math.log(2)!r}D, 0D)")


def _cut_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros(len(left))
    inner = (left > 0) & (right > 0)
    a, b = left[inner], right[inner]
    out[inner] = (a * np.log1p(b / a) + b * np.log1p(a / b)) / math.log(2)
    return out


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))


def _whole_classes(node: np.ndarray, kind: np.ndarray, w: np.ndarray, value: np.ndarray,
                   unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each node and value (NaN where missing), its rows and changes of the bits of all classes.

    ``kind`` numbers the classes of the nodes, which are here as a whole. The order of equal values in a class
    does not matter, as their changes add up to the same.
    """
    n = len(value)
    up = np.lexsort((value, node)) if node.any() else np.argsort(value)  # NaN comes last
    width = n.bit_length()
    place = np.empty(n, np.int64)
    place[up] = np.arange(n - 1, -1, -1)
    if np.isnan(value[up[-1]]) or node.any():  # missing values go last in their class
        place[np.isnan(value)] += n
        width += 1
    key = np.sort(kind << width | place)
    back = key & ((1 << width) - 1)
    back = up[n - 1 - np.where(back >= n, back - n, back)]
    kind, run = key >> width, np.cumsum(w[back])
    first = _firsts(kind)
    size = np.diff(np.append(first, n))
    run -= np.repeat(run[first] - w[back[first]], size)
    whole = np.repeat(run[first + size - 1], size)
    bits = np.rint(_cut_bits(run, whole - run) * unit).astype(np.int64)
    change = np.empty(n, np.int64)
    change[back] = np.diff(bits, prepend=0)  # bits are 0 at the end of a class
    v = value[up]
    same = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    first = np.flatnonzero(np.append(True, ~same | (node[up][1:] != node[up][:-1])))
    return up[first], np.add.reduceat(w[up], first), np.add.reduceat(change[up], first)


def _light(rows: DataFrame, layout: Layout, unit: float, parts: int) -> DataFrame:
    """Sums by value of rows whose classes fit a task: one shuffle of rows, not of cells."""
    every = range(len(layout.features))
    absent = "double('NaN')"  # of a feature that the row's model does not use; a missing value is NULL
    wide = rows.repartition(parts, *KEYS, "yi").selectExpr(
        *KEYS, "yi", "w", *[f"if(array_contains(fs, {i}), get(x, {i}), {absent}) AS x{i}" for i in every],
        *[f"get(xb, {i}) AS b{i}" for i in sorted(layout.bucketed)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        (model, _), (node, nodes), (label, labels) = (_codes(table[c]) for c in (*KEYS, "yi"))
        node = model * nodes + node
        kind, w = node * labels + label, table["w"].to_numpy()
        if len(kind) * int(kind.max()) >= 1 << 60:  # it is packed with a position below
            kind = np.unique(kind, return_inverse=True)[1]
        for i in every:
            missing = table[f"x{i}"].is_null().to_numpy()
            value = table[f"x{i}"].to_numpy()
            used = np.flatnonzero(missing | ~np.isnan(value))
            if not len(used):
                continue
            at, n, d = _whole_classes(*((node, kind, w, value) if len(used) == len(value) else
                                        (node[used], kind[used], w[used], value[used])), unit)
            at = used[at]
            out = table.select(KEYS).take(pa.array(at))
            bucket = table[f"b{i}"].fill_null(0).to_numpy()[at] if i in layout.bucketed else np.zeros(len(at), np.int32)
            for name, column in (("fi", np.full(len(at), i, np.int32)), ("b", np.where(missing[at], BUCKET_OF_MISSING, bucket)),
                                 ("num", pa.array(value[at], mask=missing[at])), ("n", n), ("d", d)):
                out = out.append_column(name, column if isinstance(column, pa.Array) else pa.array(column))
            yield from out.to_batches(OUT_ROWS)

    types = {f.name: f.dataType.simpleString() for f in wide.schema}
    return wide.mapInArrow(summed, ", ".join(f"{c} {types[c]}" for c in KEYS) + ", fi int, b int, num double, n double, d bigint")


def _heavy(rows: DataFrame, layout: Layout, unit: float) -> DataFrame:
    """Sums by value of rows of large classes, which are counted by value first and summed up in buckets."""
    group = [*KEYS, "fi"]
    bucket = f"if(num IS NULL, {BUCKET_OF_MISSING}, {'coalesce(bkt, 0)' if layout.bucketed else '0'})"
    hist = unroll(rows, layout).groupBy(*group, F.col("num").alias("ord"), F.expr(f"{bucket} AS b"), "yi").agg(F.sum("w").alias("c"))
    if layout.bucketed:
        hist = stored(hist, "class-counts")  # it is read twice
    hist = _running(hist, [*group, "yi"], {"run": "c"}, bool(layout.bucketed))
    now, was = (f"cast(rint({cut_bits(run, f'greatest(0D, all_run - ({run}))')} * {unit!r}D) AS bigint)"
                for run in ("run", "greatest(0D, run - c)"))
    return hist.selectExpr(*group, "b", "ord AS num", "c AS n", f"{now} - {was} AS d")


def _any_classes(rows: DataFrame, layout: Layout) -> DataFrame:
    """Entropy candidates "value >= v" of any number of classes: one row per node, feature and distinct value."""
    kinds = rows.groupBy(*KEYS, "yi").agg(F.sum("w").alias("n"), F.sum(F.size("fs")).alias("cells"))
    nodes = kinds.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.max("cells").alias("most"))
    sizes = nodes.agg(F.max("n").alias("n"), F.sum("cells").alias("cells"), F.max("most").alias("most")).first()
    # the bits of a node are at most its rows, so their sum in units stays below 2**62
    unit = 2.0 ** (61 - math.ceil(math.log2(max(2.0, sizes["n"] or 0.0))))
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-(sizes["cells"] or 0) // DEALT_CELLS))
    group = [*KEYS, "fi"]
    if (sizes["most"] or 0) <= LIGHT_CELLS:
        values = _light(rows, layout, unit, parts)
    else:
        large = stored(kinds.filter(F.col("cells") > LIGHT_CELLS).select(*KEYS, "yi"), "large-classes")
        large = F.broadcast(large) if large.count() <= BROADCAST_CLASSES else large
        on = [*KEYS, "yi"]
        values = _light(rows.join(large, on, "left_anti"), layout, unit, parts).unionByName(
            _heavy(rows.join(large, on, "left_semi"), layout, unit))
    # a value has at most a row per task, so counting before the shuffle would save little
    values = values.repartition(*group, "b", "num").groupBy(*group, "b", F.col("num").alias("ord")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    if layout.bucketed:
        values = stored(values, "value-sums")  # read twice
    values = _running(values, group, {"h_n": "n", "bits": "d"}, bool(layout.bucketed))
    found = values.selectExpr(*group, "ord AS vmin", "cast(NULL AS string) AS cat", "all_h_n AS a_n", "h_n",
                              "if(all_h_n - h_n <= 1e-12D * all_h_n, 0D, all_h_n - h_n) AS r_n", "bits")
    gain = f"({cut_bits('h_n', 'r_n')} - bits / {unit!r}D) / a_n"
    return found.selectExpr(*group, "vmin", "cat", "a_n", "h_n", "r_n", f"if(vmin IS NOT NULL AND r_n > 0, {gain}, NULL) AS gain")


def many_candidates(rows: DataFrame, layout: Layout) -> DataFrame:
    """Every candidate of every node: ``KEYS, fi, vmin, cat, a_n, h_n, r_n, gain`` (NULL where it is not valid)."""
    if layout.width == 0 and layout.gain.criterion == "entropy" and not layout.soft and not layout.categorical:
        return _any_classes(rows, layout)
    _, mass_impurity = SEPARABLE[layout.gain.criterion]
    tags = {"n": "c", "g": "g"} if layout.soft else {"n": "c"}
    long = unroll(rows, layout)
    if not layout.categorical:
        found = _numeric(long, layout, tags)
    else:
        texts = F.col("fi").isin(sorted(layout.categorical))
        found = _numeric(long.filter(~texts), layout, tags).unionByName(_categories(long.filter(texts), layout, tags))
    found = found.selectExpr("*", *[f"if(a_{t} - h_{t} <= 1e-12D * a_{t}, 0D, a_{t} - h_{t}) AS r_{t}" for t in tags],
                             *[f"greatest(0D, as_{t} + ds_{t}) AS rs_{t}" for t in tags])

    def children(t: str) -> str:
        return f"({mass_impurity(f'h_{t}', f'hs_{t}')} + {mass_impurity(f'r_{t}', f'rs_{t}')}) / a_{t}"

    parent = f"{mass_impurity('a_n', 'as_n')} / a_n"
    gain = f"{parent} - {children('n')}"
    if layout.soft:
        gain = f"if(a_g > 0, if(h_g > 0 AND r_g > 0, {parent} - {children('g')}, NULL), {gain})"
    return found.selectExpr(*KEYS, "fi", "vmin", "cat", "a_n", "h_n", "r_n",
                            f"if((vmin IS NOT NULL OR cat IS NOT NULL) AND r_n > 0, {gain}, NULL) AS gain")


def best_many_table(rows: DataFrame, layout: Layout) -> DataFrame:
    """Best split per (model, node) with the totals (not the class sums) of both sides."""
    return (
        many_candidates(rows, layout)
        .selectExpr(*KEYS, "struct(gain, fi, vmin, cat, a_n, h_n, r_n) AS b",
                    f"if(gain IS NULL, NULL, struct(-round(gain, {TIE_DIGITS}) AS k, fi, vmin, cat)) AS k")
        .groupBy(*KEYS).agg(F.expr("min_by(b, k) AS b"), F.expr("min(k) AS k")).filter("k IS NOT NULL")
        .selectExpr(*KEYS, "b.*")
    )


def best_splits_many(rows: DataFrame, layout: Layout) -> list:
    return best_many_table(rows, layout).collect()
