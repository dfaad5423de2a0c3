"""Counts of the larger child by subtraction: parent minus the smaller child.

The counts of the open nodes are kept as a table from level to level. Of two
children only the one with less weight is counted from rows, so at most half the
rows of a level are read into counts; the other's counts are those of the parent
less its sibling's, value by value. Class weights are whole numbers, so the
difference is exact, and memberships are weighed after it. Sums of real targets
would lose digits and value buckets their smallest value; both are counted anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.splits import KEYS, Layout, RowCounts, crisp_counts, weighed
from softgrove.session import stored

#: Parents up to which their table is broadcast.
BROADCAST_PAIRS = 200_000


def applies(layout: Layout) -> bool:
    return layout.task == "class" and not layout.bucketed


@dataclass(frozen=True)
class Pair:
    """Children of a split node: the smaller one is counted, the other derived if it is needed."""

    model: int
    parent: int
    counted: int
    derived: int
    use_counted: bool
    use_derived: bool


class KeptCounts:
    """A stored table of crisp counts as a source of candidates."""

    def __init__(self, counts: DataFrame, layout: Layout):
        self.counts, self.layout = counts, layout

    def sums(self) -> DataFrame:
        return weighed(self.counts, self.layout)


def _columns(layout: Layout) -> list[str]:
    return ["fi", "ord", *(["cat"] if layout.categorical else []), *layout.crisp_stats]


def root_counts(source, layout: Layout) -> KeptCounts:
    """Counts of the roots, from rows or another source of candidates."""
    counts = crisp_counts(source.long, layout) if isinstance(source, RowCounts) else source.sums().select(*KEYS, *_columns(layout))
    return KeptCounts(stored(counts, "counts"), layout)


def child_counts(kept: KeptCounts, rows: DataFrame, pairs: Sequence[Pair], layout: Layout) -> KeptCounts:
    """Counts of the children that are needed; ``rows`` are those of the counted children."""
    values = _columns(layout)
    counted = stored(crisp_counts(RowCounts(rows, layout).long, layout), "counted")
    table = rows.sparkSession.createDataFrame(
        [(p.model, p.parent, p.counted, p.derived, p.use_counted, p.use_derived) for p in pairs],
        "model int, node bigint, counted bigint, derived bigint, use_counted boolean, use_derived boolean")
    if len(pairs) <= BROADCAST_PAIRS:
        table = F.broadcast(table)
    used = table.filter("use_counted").select("model", F.col("counted").alias("node"))
    own = counted.join(used, list(KEYS), "left_semi")
    parents = kept.counts.join(table.filter("use_derived").select("model", "node", "counted", "derived"), list(KEYS))
    other = counted.select(F.col("model").alias("o_model"), F.col("node").alias("o_node"), *[F.col(v).alias(f"o_{v}") for v in values])
    same = [F.col("model") == F.col("o_model"), F.col("counted") == F.col("o_node"), F.col("fi") == F.col("o_fi"),
            F.col("ord").eqNullSafe(F.col("o_ord"))]
    if layout.categorical:
        same.append(F.col("cat").eqNullSafe(F.col("o_cat")))
    left = parents.join(other, same, "left").selectExpr(
        "model", "derived AS node", *[v for v in values if v not in layout.crisp_stats],
        *[f"{c} - coalesce(o_{c}, 0D) AS {c}" for c in layout.crisp_stats])
    left = left.filter(" OR ".join(f"{c} > 0" for c in layout.crisp_stats))
    return KeptCounts(stored(own.select(*KEYS, *values).unionByName(left.select(*KEYS, *values)), "counts"), layout)
