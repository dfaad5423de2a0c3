"""Split counts of all folds of repeated cross-validations from one count by fold.

In every repeat a row is in one fold, and the training set of a model is all
folds but its own. So rows are counted once by (repeat, fold, feature, value),
whatever the number of models, and the sums of a model are those of the other
folds of its repeat, added up per value. Models that differ in the usable
features or in the fuzzy sets share the counts. This holds while a model's rows
are whole folds, that is at the roots.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.splits import KEYS, Layout

#: Rows of (model, feature) up to which their table is broadcast.
BROADCAST_MODELS = 200_000


@dataclass(frozen=True)
class FoldModel:
    """A model trained on all folds of ``repeat`` but ``fold``; ``variant`` is the place of its fuzzy sets, if any."""

    model: int
    repeat: int
    fold: int
    features: tuple[int, ...]
    variant: int | None = None


class FoldCounts:
    """Counts at the roots of :class:`FoldModel` models, from rows with ``folds`` (the fold by repeat).

    ``variant_masses`` has, for each place of fuzzy sets, the membership mass as SQL over ``fi`` and ``num``.
    """

    def __init__(self, base: DataFrame, layout: Layout, models: Sequence[FoldModel], folds: str,
                 variant_masses: Sequence[str] = ()):
        self.layout, self.masses = layout, tuple(variant_masses) if layout.soft else ()
        self.by_row = bool(layout.bucketed) and bool(self.masses)
        picked = ["get(x, fi) AS num"]
        if layout.categorical:
            picked.append("get(xc, fi) AS cat")
        if layout.bucketed:
            picked.append("get(xb, fi) AS bkt")
        used = sorted({i for m in models for i in m.features})
        repeated = base.selectExpr("*", f"posexplode({folds}) AS (rep, fold)")
        long = repeated.selectExpr("*", f"explode(array({', '.join(map(str, used))})) AS fi").selectExpr(
            "rep", "fold", "1D AS w", *layout.targets, "fi", *picked)
        self.long = long.selectExpr("*", *[f"{m} AS m{v}" for v, m in enumerate(self.masses)]) if self.by_row else long
        rows = [(m.repeat, i, m.model, m.fold, m.variant) for m in models for i in m.features]
        table = base.sparkSession.createDataFrame(rows, "rep int, fi int, model int, own int, variant int")
        self.models = F.broadcast(table) if len(rows) <= BROADCAST_MODELS else table

    def _sums(self, soft: bool, negatives: bool = False) -> list:
        """Crisp sums, and for each place of fuzzy sets the memberships."""
        out = self.layout.sums(soft=False, negatives=negatives)
        if soft:
            for v in range(len(self.masses)):
                if self.layout.task == "class":
                    out += [F.expr(f"sum(if(yi = {i}, w * m{v}, 0D)) AS g{i}_{v}") for i in range(self.layout.width)]
                else:
                    out.append(F.expr(f"sum(w * m{v}) AS g_{v}"))
        return out

    def _of_models(self, counted: DataFrame, keys: list[str], soft: bool, negatives: bool, span: bool,
                   models: DataFrame) -> DataFrame:
        """Sums of every model from those by fold; values that no training row has are left out."""
        given = [c for c in counted.columns if c not in (*keys, "rep", "fold", "fi")]
        parts = counted.groupBy("rep", "fi", *keys).agg(F.collect_list(F.struct("fold", *given)).alias("parts"))
        others = parts.join(models, ["rep", "fi"] if "bkt" not in models.columns else ["rep", "fi", "bkt"]).withColumn(
            "others", F.expr("filter(parts, p -> p.fold != own)")).filter("size(others) > 0")

        def total(stat: str) -> str:
            return f"aggregate(others, 0D, (a, p) -> a + p.{stat})"

        out = [f"{total(s)} AS {s}" for s in self.layout.crisp_stats]
        if negatives:
            out += [f"{total(f'd{i}')} AS d{i}" for i in range(self.layout.width)]
        if soft:
            for g in self.layout.stats[len(self.layout.crisp_stats):]:
                places = " ".join(f"WHEN {v} THEN {total(f'{g}_{v}')}" for v in range(len(self.masses)))
                out.append(f"CASE variant {places} ELSE 0D END AS {g}" if self.masses else f"0D AS {g}")
        if span:
            out += ["array_min(transform(others, p -> p.vmin)) AS vmin", "array_max(transform(others, p -> p.vmax)) AS vmax"]
        return others.selectExpr("model", "1L AS node", "fi", *keys, *out)

    def _weighed(self, sums: DataFrame, number: str) -> DataFrame:
        """Memberships of equal values from their counts."""
        layout = self.layout
        if not layout.soft or self.by_row:
            return sums
        counts = layout.crisp_stats if layout.task == "class" else ["n"]
        return sums.withColumn("num", F.col(number)).selectExpr("*", f"{layout.masses} AS m").selectExpr(
            "*", *[f"{c} * m AS g{c[1:]}" for c in counts]).drop("m", "num")

    def sums(self) -> DataFrame:
        """As :func:`softgrove.operators.splits.candidate_sums`, for the root of every model."""
        layout = self.layout
        order = "coalesce(cast(bkt AS double), num)" if layout.bucketed else "num"
        cats = ["cat"] if layout.categorical else []
        span = [F.min("num").alias("vmin"), F.max("num").alias("vmax")] if layout.bucketed else []
        negatives = bool(layout.bucketed) and layout.task == "value"
        counted = self.long.groupBy("rep", "fold", "fi", F.expr(f"{order} AS ord"), *cats).agg(
            *span, *self._sums(self.by_row, negatives))
        out = self._of_models(counted, ["ord", *cats], self.by_row, negatives, bool(layout.bucketed), self.models)
        extra = [] if layout.bucketed else ["ord AS vmin", "ord AS vmax"]
        if not layout.categorical:
            extra.append("cast(NULL AS string) AS cat")
        return self._weighed(out.selectExpr("*", *extra), "ord")

    def inside(self, alive: DataFrame, listed: bool) -> DataFrame:
        """Sums of every value inside the given buckets, for the models that want the bucket."""
        wanted = alive.join(self.models, ["model", "fi"]).select("rep", "fi", "bkt", "model", "own", "variant")
        if listed:
            wanted = F.broadcast(wanted)
        inside = self.long.filter("bkt IS NOT NULL")
        if listed:
            inside = inside.join(F.broadcast(alive.select("fi", "bkt").distinct()), ["fi", "bkt"], "left_semi")
        counted = inside.groupBy("rep", "fold", "fi", "bkt", F.col("num").alias("vmin")).agg(*self._sums(self.by_row))
        out = self._of_models(counted, ["bkt", "vmin"], self.by_row, False, False, wanted)
        return self._weighed(out, "vmin").select(*KEYS, "fi", "bkt", "vmin", *self.layout.stats)
