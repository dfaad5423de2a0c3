"""Best split of every node and feature by one sorted scan, for any criterion over class masses.

Rows (model, node, feature, value, class, weight) are dealt by (model, node,
feature) and sorted by falling value, and a task goes through its sorted rows a
batch at a time: running class sums of a segment come from one cumulative sum
with the sums before the segment taken off, gains of all its values from those.
One shuffle replaces the windows, and the class sums of both sides come along.

A segment is held whole, so the scan is used only where the rows of a feature,
or its distinct values times classes if equal ones are counted first, are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.manyclass import WIDE_CLASSES
from softgrove.operators.splits import KEYS, TIE_DIGITS, Layout, unroll

#: Rows of a segment at most, and rows that are scanned together.
SEGMENT_ROWS = 1 << 20
SCAN_ROWS = 1 << 15
RESIDUE = 1e-12


def _gini(mass: np.ndarray, whole: np.ndarray) -> np.ndarray:
    share = mass / whole[:, None]
    return 1 - (share * share).sum(axis=1)


def _entropy(mass: np.ndarray, whole: np.ndarray) -> np.ndarray:
    logs = np.log2(mass, where=mass > 0, out=np.zeros_like(mass))
    return np.maximum(0.0, np.log2(whole) - (mass * logs).sum(axis=1) / whole)


CRITERIA = {"gini": _gini, "entropy": _entropy}


def rows_of(n: int, distinct: int, width: int) -> int:
    return min(n, distinct * width)


def applies(layout: Layout, counts: Mapping[str, tuple[int, int]]) -> bool:
    """``counts``: values and distinct values of each feature."""
    return (layout.task == "class" and layout.width > WIDE_CLASSES and layout.gain.gain is None
            and layout.gain.criterion in CRITERIA and not layout.categorical and not layout.bucketed
            and all(rows_of(n, d, layout.width) <= SEGMENT_ROWS for n, d in counts.values()))


def _gains(layout: Layout, node: np.ndarray, hit: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Gain of each candidate; [candidate, class] masses, crisp ones first and then memberships. NaN if there is none."""
    w = layout.width
    impurity = CRITERIA[layout.gain.criterion]
    totals = [[m[:, :w].sum(axis=1), m[:, w:].sum(axis=1)] for m in (node, hit, rest)]
    (a_n, a_g), (h_n, h_g), (r_n, r_g) = totals
    parent = impurity(node[:, :w], a_n)
    crisp = parent - h_n / a_n * impurity(hit[:, :w], h_n) - r_n / a_n * impurity(rest[:, :w], r_n)
    if not layout.soft:
        return crisp
    soft = parent - h_g / a_g * impurity(hit[:, w:], h_g) - r_g / a_g * impurity(rest[:, w:], r_g)
    return np.where(a_g > 0, np.where((h_g > 0) & (r_g > 0), soft, np.nan), crisp)


def _scan(layout: Layout, table: pa.Table) -> pa.RecordBatch | None:
    """Best candidate of each segment of rows sorted by segment and falling value, missing ones last."""
    cols = {c: table[c].to_numpy() for c in (*KEYS, "fi", "yi", "w")}
    value = table["num"].to_numpy()  # NaN where missing
    n, w = len(value), layout.width
    change = np.zeros(n, bool)
    change[0] = True
    for c in (*KEYS, "fi"):
        change[1:] |= cols[c][1:] != cols[c][:-1]
    start = np.flatnonzero(change)
    segment = np.cumsum(change) - 1
    mass = np.zeros((n, w * (1 + layout.soft)))
    mass[np.arange(n), cols["yi"]] = cols["w"]
    if layout.soft:
        mass[np.arange(n), w + cols["yi"]] = cols["w"] * table["m"].to_numpy()
    run = np.cumsum(mass, axis=0)
    before = np.vstack([np.zeros(mass.shape[1]), run])[start]
    ends = np.append(start[1:], n) - 1
    whole = run[ends] - before
    last = np.ones(n, bool)  # of its value
    last[:-1] = change[1:] | (value[1:] != value[:-1])
    at = np.flatnonzero(last & ~np.isnan(value))
    node, hit = whole[segment[at]], run[at] - before[segment[at]]
    rest = node - hit
    rest[:, w:][rest[:, w:] <= RESIDUE * node[:, w:]] = 0.0
    inner = rest[:, :w].sum(axis=1) > 0
    at, node, hit, rest = at[inner], node[inner], hit[inner], rest[inner]
    if not len(at):
        return None
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = _gains(layout, node, hit, rest)
    key = np.where(np.isnan(gain), -np.inf, np.round(gain, TIE_DIGITS))
    where = segment[at]
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    best = np.repeat(np.maximum.reduceat(key, first), np.diff(np.append(first, len(at))))
    tied = np.flatnonzero((key == best) & np.isfinite(best))
    if not len(tied):
        return None
    chosen = tied[np.append(where[tied][1:] != where[tied][:-1], True)]  # the lowest value comes last
    out = {c: pa.array(cols[c][at[chosen]]) for c in (*KEYS, "fi")}
    out |= {"vmin": pa.array(value[at[chosen]]), "gain": pa.array(gain[chosen])}
    for p, m in (("a", node), ("h", hit), ("r", rest)):
        out |= {f"{p}_{s}": pa.array(m[chosen, i]) for i, s in enumerate(layout.crisp_stats)}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def best_splits_scanned(rows: DataFrame, layout: Layout, count_first: bool) -> list:
    """Best split per (model, node), collected: one row per node of the level, with the class sums of both sides."""
    long = unroll(rows, layout)
    if count_first:
        long = long.groupBy(*KEYS, "fi", "num", "yi").agg(F.sum("w").alias("w"))
    soft = [f"{layout.masses} AS m"] if layout.soft else []
    long = long.selectExpr(*KEYS, "fi", "num", "yi", "w", *soft)
    dealt = long.repartition(*KEYS, "fi").sortWithinPartitions(*KEYS, "fi", F.col("num").desc_nulls_last())
    sums = ", ".join(f"{p}_{s} double" for p in ("a", "h", "r") for s in layout.crisp_stats)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            cut = len(table)
            if not everything:  # the last segment may go on
                same = np.ones(len(table), bool)
                for c in (*KEYS, "fi"):
                    found = table[c].to_numpy()
                    same &= found == found[-1]
                cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
                held.append(table.slice(cut))
            if cut:
                best = _scan(layout, table.slice(0, cut))
                if best is not None:
                    yield best

        for batch in batches:
            if len(batch):
                held.append(pa.Table.from_batches([batch]))
                if sum(map(len, held)) >= SCAN_ROWS * (1 + len(held[0]) // SCAN_ROWS):
                    yield from flush(False)
        if held:
            yield from flush(True)

    found = dealt.mapInArrow(scan, f"model int, node bigint, fi int, vmin double, gain double, {sums}")
    kept = [c for c in found.columns if c not in KEYS]
    best = found.groupBy(*KEYS).agg(F.expr(
        f"min_by(struct({', '.join(kept)}), struct(-round(gain, {TIE_DIGITS}), fi, vmin)) AS b")).select(*KEYS, "b.*")
    return best.withColumn("cat", F.lit(None).cast("string")).collect()
