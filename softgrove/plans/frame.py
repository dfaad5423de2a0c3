"""Turn an input table into the rows the tree builder trains on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.functions.sqltext import clean_number, name, num
from softgrove.operators.splits import DIRECT_LIMIT

# feature -> [(centroid, width), ...]
FuzzySetMap = Mapping[str, Sequence[tuple[float, float]]]
MAX_BUCKETS = 4096
MIN_BUCKETS = 256


@dataclass(frozen=True)
class ModelSpec:
    """One of many models trained in the same jobs.

    ``variant`` picks the fuzzy sets (None: crisp), ``features`` the usable
    feature positions (None: all).
    """

    model: int
    variant: int | None = None
    features: tuple[int, ...] | None = None


def feature_arrays(features: Sequence[str], categorical: Sequence[str]) -> dict[str, Column]:
    """``x`` (numbers) and, if needed, ``xc`` (texts), both by feature position."""
    cats = set(categorical)
    numbers = ["cast(NULL AS double)" if f in cats else clean_number(f) for f in features]
    out = {"x": F.expr(f"array({', '.join(numbers)})")}
    if cats:
        texts = [f"cast({name(f)} AS string)" if f in cats else "cast(NULL AS string)" for f in features]
        out["xc"] = F.expr(f"array({', '.join(texts)})")
    return out


def per_model(models: Sequence[ModelSpec], value_of) -> str:
    """SQL constant of a model; a plain literal when all models share it."""
    values = {m.model: value_of(m) for m in models}
    if len(set(values.values())) == 1:
        return next(iter(values.values()))
    return f"get(array({', '.join(values.get(i, 'NULL') for i in range(max(values) + 1))}), model)"


def masses_sql(features: Sequence[str], variants: Sequence[FuzzySetMap], models: Sequence[ModelSpec]) -> str:
    """Membership mass of value ``num`` of feature ``fi`` for ``model``, 0 without fuzzy sets.

    Centroids and widths sit in array literals addressed by variant and feature,
    so the expression is as short for many features as for one.
    """
    offset = per_model(models, lambda m: "cast(NULL AS int)" if m.variant is None else str(m.variant * len(features)))
    size = max(len(s) for v in variants for s in v.values())

    def table(part: int, j: int) -> str:
        cells = [num(v[f][j][part]) if f in v and j < len(v[f]) else "cast(NULL AS double)"
                 for v in variants for f in features]
        return f"get(array({', '.join(cells)}), {offset} + fi)"

    terms = [f"coalesce(greatest(0D, 1D - abs(num - {table(0, j)}) / {table(1, j)}), 0D)" for j in range(size)]
    return f"if(num IS NULL OR {offset} IS NULL, 0D, {' + '.join(terms)})"


def value_counts(df: DataFrame, features: Sequence[str], categorical: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Values and (nearly) distinct values of each feature."""
    if not features:
        return {}
    numeric = [f for f in features if f not in set(categorical)]
    values = ", ".join(clean_number(f) for f in numeric)
    seen = df.selectExpr(f"posexplode(array({values})) AS (fi, v)").groupBy("fi").agg(
        F.count("v").alias("n"), F.approx_count_distinct("v").alias("d")).collect() if numeric else []
    return {numeric[r["fi"]]: (r["n"], r["d"]) for r in seen}


def value_edges(df: DataFrame, features: Sequence[str], categorical: Sequence[str], direct_limit: int = DIRECT_LIMIT,
                counts: Mapping[str, tuple[int, int]] | None = None) -> dict[str, list[float]]:
    """Bucket edges for features with more distinct values than ``direct_limit``.

    The edges only decide how work is grouped, never the result, so sketches are
    enough to find them.
    """
    counts = value_counts(df, features, categorical) if counts is None else counts
    n_buckets = {f: int(min(MAX_BUCKETS, max(MIN_BUCKETS, 4 * d // direct_limit)))
                 for f, (_, d) in counts.items() if d > direct_limit}
    if not n_buckets:
        return {}
    sketch = df.selectExpr(*[
        f"percentile_approx({clean_number(f)}, array({', '.join(num(j / b) for j in range(1, b))}), {10 * b}) AS v{i}"
        for i, (f, b) in enumerate(n_buckets.items())]).first()
    inf = float("inf")
    return {f: [-inf, *sorted({v for v in sketch[f"v{i}"] if -inf < v < inf}), inf] for i, f in enumerate(n_buckets)}


def add_buckets(df: DataFrame, features: Sequence[str], edges: Mapping[str, list[float]]) -> DataFrame:
    """Array ``xb``: value bucket by feature position, NULL for unbucketed or missing values."""
    cols = {f: f"__b{i}" for i, f in enumerate(features) if f in edges}
    staged = df.withColumns({f"__v{c}": F.expr(f"coalesce({clean_number(f)}, double('NaN'))") for f, c in cols.items()})
    staged = Bucketizer(splitsArray=[edges[f] for f in cols], inputCols=[f"__v{c}" for c in cols.values()],
                        outputCols=list(cols.values()), handleInvalid="keep").transform(staged)
    xb = F.array(*[
        F.when(~F.isnan(f"__v{cols[f]}"), F.col(cols[f]).cast("int")) if f in cols else F.lit(None).cast("int")
        for f in features])
    return staged.withColumn("xb", xb).drop(*cols.values(), *[f"__v{c}" for c in cols.values()])


def training_rows(df: DataFrame, features: Sequence[str], categorical: Sequence[str], targets: Mapping[str, Column],
                  models: Sequence[ModelSpec], weights: str | None = None, edges: Mapping[str, list[float]] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Rows with ``model, w, x [, xc, xb], fs`` and the targets.

    ``weights`` names an ``array<struct<model int, w bigint>>`` column giving the
    models each row takes part in; without it every row feeds model 0 once.
    """
    return expand_models(base_rows(df, features, categorical, targets, weights, edges, keep), features, models)


def base_rows(df: DataFrame, features: Sequence[str], categorical: Sequence[str], targets: Mapping[str, Column],
              weights: str | None = None, edges: Mapping[str, list[float]] | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: features, targets and the array ``mw`` of the models it takes part in, if any."""
    cols = {**feature_arrays(features, categorical), **targets}
    base = add_buckets(df, features, edges) if edges else df
    extra = (["xb"] if edges else []) + list(keep)
    picked = [c.alias(name) for name, c in cols.items()]
    return base.select(*extra, *picked, *([F.col(weights).alias("mw")] if weights else []))


def expand_models(base: DataFrame, features: Sequence[str], models: Sequence[ModelSpec]) -> DataFrame:
    """A row per (row, model); done inside each job, so that a cached base holds every row once."""
    # w is DOUBLE: class weights are squared later, which would overflow BIGINT on huge tables
    if "mw" not in base.columns:
        rows = base.withColumns({"model": F.lit(models[0].model), "w": F.lit(1.0)})
    else:
        rest = [c for c in base.columns if c != "mw"]
        rows = base.select(*rest, F.inline(F.filter("mw", lambda s: s["w"] > 0))).withColumn("w", F.col("w").cast("double"))
    every = list(range(len(features)))
    sets = per_model(models, lambda m: f"array({', '.join(map(str, m.features or every))})")
    return rows.selectExpr("*", f"{sets} AS fs")
