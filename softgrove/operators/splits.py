"""Best split of every feature of every node of every model, as one aggregation.

Rows are unrolled to (model, node, feature, value), counted per distinct value
with map-side combining, and a running sum over descending values gives the sums
on the passing side of each candidate. Features with many distinct values are
counted per value bucket first: the smallest value of a bucket is an exact
candidate already, and only buckets whose gain bound beats the best candidate are
scanned value by value. The answer is exact either way, and no task ever holds
more than one bounded group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from softgrove.functions.bounds import gain_bound
from softgrove.functions.criteria import GainSpec, Side, impurity, plus, rest_of
from softgrove.session import stored

# Distinct values per feature up to which every value is its own bucket.
DIRECT_LIMIT = 65_536
# Up to this many buckets to scan, their few sums are sent along with the next job;
# more stay a distributed table that is joined by shuffle.
LISTED_BUCKETS = 20_000
# Open nodes up to which the gains found so far are broadcast.
BROADCAST_FOUND = 200_000
TIE_DIGITS = 12
KEYS = ("model", "node")


@dataclass(frozen=True)
class Layout:
    """Column layout of unrolled rows.

    ``width`` is the number of classes, or of outputs when ``task`` is "value".
    """

    features: tuple[str, ...]
    task: str
    width: int
    gain: GainSpec
    categorical: frozenset[int] = frozenset()
    bucketed: frozenset[int] = frozenset()
    masses: str = "0D"  # membership mass as SQL over ``model``, ``fi`` and ``num``

    @property
    def soft(self) -> bool:
        return self.gain.soft

    def _named(self, stem: str, prefix: str = "") -> tuple[str, ...]:
        return tuple(f"{prefix}{stem}{i}" for i in range(self.width))

    @property
    def crisp_stats(self) -> list[str]:
        """``c0..`` class weights, or ``n, s0.., q0..``."""
        if self.task == "class":
            return list(self._named("c"))
        return ["n", *self._named("s"), *self._named("q")]

    @property
    def stats(self) -> list[str]:
        """Crisp sums, then memberships: ``g0..`` per class, or ``g``."""
        if not self.soft:
            return self.crisp_stats
        return self.crisp_stats + (list(self._named("g")) if self.task == "class" else ["g"])

    @property
    def targets(self) -> list[str]:
        return ["yi"] if self.task == "class" else list(self._named("t"))

    def sums(self, soft: bool | None = None, negatives: bool = False) -> list:
        """Aggregates that fill :attr:`stats`."""
        soft = self.soft if soft is None else soft
        if self.task == "class":
            out = [f"sum(if(yi = {i}, w, 0D)) AS c{i}" for i in range(self.width)]
            if soft:
                out += [f"sum(if(yi = {i}, w * m, 0D)) AS g{i}" for i in range(self.width)]
        else:
            out = ["sum(w) AS n", *[f"sum(w * t{i}) AS s{i}" for i in range(self.width)],
                   *[f"sum(w * t{i} * t{i}) AS q{i}" for i in range(self.width)]]
            if soft:
                out.append("sum(w * m) AS g")
            if negatives:
                out += [f"sum(w * least(t{i}, 0D)) AS d{i}" for i in range(self.width)]
        return [F.expr(e) for e in out]

    def side(self, p: str) -> Side:
        if self.task == "class":
            return Side(n=f"{p}n", g=f"{p}g", classes=self._named("c", p),
                        soft_classes=self._named("g", p) if self.soft else ())
        return Side(n=f"{p}n", g=f"{p}g", sums=self._named("s", p), squares=self._named("q", p))

    def totals(self, *prefixes: str) -> list[str]:
        """Total weight and membership of class sides (regression has them already)."""
        if self.task != "class":
            return []
        out = [f"{plus(self._named('c', p))} AS {p}n" for p in prefixes]
        return out + ([f"{plus(self._named('g', p))} AS {p}g" for p in prefixes] if self.soft else [])


def unroll(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row per (row, feature of its model): ``fi, num [, cat, bkt, m]``."""
    picked = ["get(x, fi) AS num"]
    if layout.categorical:
        picked.append("get(xc, fi) AS cat")
    if layout.bucketed:
        picked.append("get(xb, fi) AS bkt")
    long = rows.selectExpr("*", "explode(fs) AS fi").selectExpr(*KEYS, "w", *layout.targets, "fi", *picked)
    return long.selectExpr("*", f"{layout.masses} AS m") if layout.soft and layout.bucketed else long


def crisp_counts(long: DataFrame, layout: Layout) -> DataFrame:
    """Crisp sums of the distinct values of every node and feature: ``KEYS, fi, ord [, cat]`` and the sums."""
    cats = ["cat"] if layout.categorical else []
    return long.groupBy(*KEYS, "fi", F.col("num").alias("ord"), *cats).agg(*layout.sums(soft=False))


def weighed(counts: DataFrame, layout: Layout) -> DataFrame:
    """Crisp counts as candidates; equal values have equal memberships, so the counts are weighed."""
    extra = ["ord AS vmin", "ord AS vmax", *([] if layout.categorical else ["cast(NULL AS string) AS cat"])]
    out = counts.selectExpr("*", *extra)
    if not layout.soft:
        return out
    crisp = layout.crisp_stats if layout.task == "class" else ["n"]
    return out.withColumn("num", F.col("ord")).selectExpr("*", f"{layout.masses} AS m").selectExpr(
        "*", *[f"{c} * m AS g{c[1:]}" for c in crisp]).drop("m", "num")


def candidate_sums(long: DataFrame, layout: Layout) -> DataFrame:
    """Distinct values (or buckets) per node and feature with their sums.

    ``vmin``/``vmax`` span the values of the row; ``ord`` is their order.
    """
    if not layout.bucketed:
        return weighed(crisp_counts(long, layout), layout)
    cats = ["cat"] if layout.categorical else []
    out = long.groupBy(*KEYS, "fi", F.expr("coalesce(cast(bkt AS double), num) AS ord"), *cats).agg(
        F.min("num").alias("vmin"), F.max("num").alias("vmax"),
        *layout.sums(soft=layout.soft, negatives=layout.task == "value"))
    return out if cats else out.selectExpr("*", "cast(NULL AS string) AS cat")


def _with_rest(df: DataFrame, layout: Layout) -> DataFrame:
    rest = [f"{rest_of(f'h_{s}', f'a_{s}', s.startswith('g'))} AS r_{s}" for s in layout.stats]
    df = df.selectExpr("*", *rest)
    totals = layout.totals("a_", "h_", "r_")
    return df.selectExpr("*", *totals) if totals else df


def prefix_sums(sums: DataFrame, layout: Layout) -> DataFrame:
    """Add sums of the passing side (``h_``), of the node (``a_``) and of the rest (``r_``).

    Numeric features: all rows with a value >= the candidate; categorical ones:
    the rows equal to it. Missing values never pass.
    """
    part = f"PARTITION BY {', '.join(KEYS)}, fi"
    added = []
    for s in layout.stats:
        run = f"sum({s}) OVER ({part} ORDER BY ord DESC NULLS LAST ROWS UNBOUNDED PRECEDING)"
        added.append((f"if(cat IS NOT NULL, {s}, {run})" if layout.categorical else run) + f" AS h_{s}")
        added.append(f"sum({s}) OVER ({part}) AS a_{s}")
    return _with_rest(sums.selectExpr("*", *added), layout)


def score(prefixed: DataFrame, layout: Layout) -> DataFrame:
    """Add ``gain``, NULL where the candidate is not valid (a side is empty, gain undefined).

    Invalid candidates are not filtered here: a filter would be pushed below the
    projections and repeat their long expressions.
    """
    gain = layout.gain.score(layout.side("a_"), layout.side("h_"), layout.side("r_"))
    return prefixed.selectExpr("*", f"if((vmin IS NOT NULL OR cat IS NOT NULL) AND r_n > 0, {gain}, NULL) AS gain")


def rank_key(layout: Layout) -> str:
    """Orders candidates: higher gain, then lower feature, then lower value.

    Gains are compared after rounding, relative to the node impurity for
    regression, so that the order of float additions cannot decide.
    """
    gain = "gain"
    if layout.task == "value":
        gain = f"coalesce(try_divide(gain, {impurity(layout.side('a_'), layout.gain.criterion)}), 0D)"
    return f"if(gain IS NULL, NULL, struct(-round({gain}, {TIE_DIGITS}) AS k, fi, vmin, cat))"


def best_per_node(scored: DataFrame, layout: Layout) -> DataFrame:
    kept = ["gain", "fi", "vmin", "cat", *[f"{p}_{s}" for s in layout.crisp_stats for p in ("a", "h", "r")]]
    return (
        scored.selectExpr(*KEYS, f"struct({', '.join(kept)}) AS b", f"{rank_key(layout)} AS k")
        .groupBy(*KEYS).agg(F.expr("min_by(b, k) AS b"), F.expr("min(k) AS k")).filter("k IS NOT NULL")
        .selectExpr(*KEYS, "k", "b.*")
    )


def _order_of(row) -> tuple:
    k = row["k"]
    return (k["k"], k["fi"], k["vmin"] if k["vmin"] is not None else float("-inf"), k["cat"] or "")


def alive_buckets(prefixed: DataFrame, found: DataFrame, layout: Layout) -> DataFrame:
    """Buckets with several values that may hold a better split than ``found``."""
    offsets = [f"a_{s}" for s in layout.stats] + [f"h_{s} - {s} AS o_{s}" for s in layout.stats]
    keys = [*KEYS, "fi", "cast(ord AS int) AS bkt", *offsets]
    inside = prefixed.filter("vmin < vmax")
    bound = gain_bound(layout.side("a_"), layout.side("lo_"), layout.side("hi_"), layout.gain)
    if bound is None:
        return inside.selectExpr(*keys)
    box = []
    for s in layout.stats:
        if s.startswith("s"):
            box += [f"h_{s} - {s} + d{s[1:]} AS lo_{s}", f"h_{s} - d{s[1:]} AS hi_{s}"]
        else:
            box += [f"h_{s} - {s} AS lo_{s}", f"h_{s} AS hi_{s}"]
    return (
        inside.selectExpr("*", *box).selectExpr("*", f"{bound} AS bound")
        .join(found, list(KEYS), "left")
        .filter("floor_gain IS NULL OR bound IS NULL OR bound >= floor_gain - 1e-9D * (1 + abs(floor_gain))")
        .selectExpr(*keys)
    )


class RowCounts:
    """Sums of the training rows of every (model, node), counted from rows that have both."""

    def __init__(self, rows: DataFrame, layout: Layout):
        self.long, self.layout = unroll(rows, layout), layout

    def sums(self) -> DataFrame:
        """As :func:`candidate_sums`."""
        return candidate_sums(self.long, self.layout)

    def inside(self, alive: DataFrame, listed: bool) -> DataFrame:
        """Sums of every value inside the given buckets: ``KEYS, fi, bkt, vmin`` and the sums.

        Listed buckets filter the rows before they are counted; a long table of buckets
        is joined after the count, so that a frequent value is one row by then.
        """
        keys = [*KEYS, "fi", "bkt"]
        wanted = F.broadcast(alive.select(*keys)) if listed else None
        inside = self.long.join(wanted, keys, "left_semi") if listed else self.long.filter("bkt IS NOT NULL")
        return inside.groupBy(*keys, F.col("num").alias("vmin")).agg(*self.layout.sums())


def scan_buckets(values: DataFrame, alive: DataFrame, listed: bool, layout: Layout) -> DataFrame:
    """Every value inside the given buckets as a scored candidate."""
    keys = [*KEYS, "fi", "bkt"]
    if listed:
        alive = F.broadcast(alive)
    run = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY vmin DESC ROWS UNBOUNDED PRECEDING)"
    inner = values.selectExpr(*keys, "vmin", *[f"sum({s}) {run} AS i_{s}" for s in layout.stats])
    joined = inner.join(alive, keys).selectExpr(
        *KEYS, "fi", "vmin", "cast(NULL AS string) AS cat", *[f"a_{s}" for s in layout.stats],
        *[f"o_{s} + i_{s} AS h_{s}" for s in layout.stats])
    return score(_with_rest(joined, layout), layout)


def best_table(rows: DataFrame, layout: Layout) -> DataFrame:
    """Best split per (model, node) as a table; nothing about nodes comes to the driver but a count of buckets."""
    counts = RowCounts(rows, layout)
    prefixed = prefix_sums(counts.sums(), layout)
    if not layout.bucketed:
        return best_per_node(score(prefixed, layout), layout)
    prefixed = stored(prefixed, "bucket-sums")
    best = stored(best_per_node(score(prefixed, layout), layout), "bucket-best")
    found = best.selectExpr(*KEYS, "gain AS floor_gain")
    alive = stored(alive_buckets(prefixed, found, layout), "buckets")
    listed = alive.limit(LISTED_BUCKETS + 1).count() <= LISTED_BUCKETS
    scanned = scan_buckets(counts.inside(alive, listed), alive, listed, layout)
    both = best.unionByName(best_per_node(scanned, layout))
    rest = [c for c in both.columns if c not in KEYS]
    return both.groupBy(*KEYS).agg(F.expr(f"min_by(struct({', '.join(rest)}), k) AS b")).selectExpr(*KEYS, "b.*")


def best_splits(rows: DataFrame, layout: Layout) -> list:
    """Best split per (model, node), collected: one row per node of the level."""
    return best_of_counts(RowCounts(rows, layout), layout)


def best_of_counts(counts, layout: Layout) -> list:
    """Best split per (model, node) from a source of counts like :class:`RowCounts`."""
    prefixed = prefix_sums(counts.sums(), layout)
    spark = prefixed.sparkSession
    if not layout.bucketed:
        return best_per_node(score(prefixed, layout), layout).collect()
    prefixed = prefixed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = {tuple(r[k] for k in KEYS): r for r in best_per_node(score(prefixed, layout), layout).collect()}
        found = spark.createDataFrame([(*key, float(r["gain"])) for key, r in best.items()],
                                      "model int, node bigint, floor_gain double")
        alive = alive_buckets(prefixed, F.broadcast(found) if len(best) <= BROADCAST_FOUND else found, layout)
        few = alive.limit(LISTED_BUCKETS + 1).collect()
        if few:
            listed = len(few) <= LISTED_BUCKETS
            if listed:
                alive = spark.createDataFrame(few, alive.schema)
            scanned = scan_buckets(counts.inside(alive, listed), alive, listed, layout)
            for r in best_per_node(scanned, layout).collect():
                key = tuple(r[k] for k in KEYS)
                if key not in best or _order_of(r) < _order_of(best[key]):
                    best[key] = r
        return list(best.values())
    finally:
        prefixed.unpersist()
