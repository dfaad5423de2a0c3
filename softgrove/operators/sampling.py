"""Samples, folds and splits, all from seeded hashes of a unique row key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softgrove.functions.draws import DRAW_DIGITS, draw_hash, draw_int, draw_unit, poisson, poisson_one
from softgrove.operators.joins import null_safe_join
from softgrove.operators.ranks import BROADCAST_CUTS, hash_thresholds, radix_thresholds

# Mean of one Poisson draw; larger means are sums of several.
MAX_POISSON = 8.0


def row_key(columns: Sequence[str]) -> Column:
    """Key for tables without one: md5 over all columns and their names; NULL differs from every text."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns])).cast("binary"))


def _literal_cuts(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def sample_without_replacement(df: DataFrame, key: Sequence[str], n_subsets: int, n_rows: int,
                               seed: int = 0) -> DataFrame:
    """``n_subsets`` independent samples of ``n_rows`` distinct rows, numbered ``subset``.

    A sample is the rows up to a threshold of its own hash; the table is not shuffled.
    """
    size = df.count()
    if n_rows > size:
        raise ValueError(f"a sample of {n_rows} rows needs as many rows, the table has {size}")
    spread = df.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    hashed = spread.withColumn("__h", draw_hash(key, F.col("subset"), seed))
    cuts = _literal_cuts(df, [(s, n_rows) for s in range(n_subsets)], "subset int, position bigint")
    last = hash_thresholds(hashed, "__h", cuts, ["subset"], size).select("subset", "threshold")
    return hashed.join(F.broadcast(last), "subset").filter("__h <= threshold").drop("__h", "threshold")  # a row per subset


def surplus_mean(n_rows: int, size: int) -> float:
    """Poisson mean of a row with which a whole table of ``size`` rows almost never draws fewer than ``n_rows``."""
    return (n_rows + 6 * math.sqrt(n_rows) + 12) / size


def _surplus_counts(key: Sequence[str], mean: float, n_subsets: int, seed: int, attempt: int) -> Column:
    """``array<bigint>``: Poisson draws of the row by subset; a large mean is a sum of several draws."""
    parts = max(1, math.ceil(mean / MAX_POISSON))
    salts = F.sequence(F.lit(0), F.lit(n_subsets * parts - 1))
    units = F.transform(salts, lambda i: draw_unit(draw_hash(key, F.concat(F.lit(f"{attempt}."), i.cast("string")), seed)))
    counts = F.transform(units, lambda u: poisson(u, mean / parts))
    if parts == 1:
        return counts
    return F.transform(F.sequence(F.lit(0), F.lit(n_subsets - 1)), lambda s: F.aggregate(
        F.slice(counts, s * parts + 1, parts), F.lit(0).cast("bigint"), lambda total, x: total + x))


def _copy_hash(key: Sequence[str], subset: Column, copy: Column, seed: int, attempt: int) -> Column:
    return draw_hash(key, F.concat_ws(".", F.lit(attempt).cast("string"), subset.cast("string"), copy.cast("string")), seed)


def bootstrap_array(df: DataFrame, key: Sequence[str], n_subsets: int, seed: int = 0,
                    method: str = "exact", out: str = "mw", n_rows: int | None = None) -> DataFrame:
    """Add ``array<struct<model int, w bigint>>``: the weight of the row in each bootstrap subset.

    "exact" draws ``n_rows`` rows (default: the table's size) with replacement; subsets that did not draw the row are
    left out. "poisson" gives every row independent Poisson(1) weights. Neither shuffles the table or its draws.

    Exact weights are Poisson weights with a surplus: given their total, such draws are that many independent uniform
    ones, and they stay so when the surplus, a random set of drawn copies, is taken out. The copies with the smallest
    hashes go; the threshold of each subset is found by radix selection, so only counts leave the tasks. Should a
    subset draw too few (one time in a billion), all are drawn anew. Subsets differ only by their salt.
    """
    if method == "poisson":
        weights = F.transform(
            F.sequence(F.lit(0), F.lit(n_subsets - 1)),
            lambda t: F.struct(t.cast("int").alias("model"),
                               poisson_one(draw_unit(draw_hash(key, t, seed))).alias("w")))
        return df.withColumn(out, weights)
    size = df.count()
    n_rows = size if n_rows is None else n_rows
    if not size or not n_rows or not n_subsets:
        return df.withColumn(out, F.expr("cast(array() AS array<struct<model: int, w: bigint>>)"))
    mean = surplus_mean(n_rows, size)
    for attempt in count():
        counts = _surplus_counts(key, mean, n_subsets, seed, attempt)
        totals = df.select(F.posexplode(counts).alias("subset", "w")).groupBy("subset").agg(F.sum("w").alias("w"))
        surplus = {r["subset"]: int(r["w"]) - n_rows for r in totals.collect()}  # a row per subset
        if min(surplus.values()) >= 0:
            break
    copies = df.select(*key, F.posexplode(counts).alias("__subset", "__w")) \
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__w"))).alias("__copy")).filter("__copy > 0") \
        .select("__subset", _copy_hash(key, F.col("__subset"), F.col("__copy"), seed, attempt).alias("__h"))
    found = radix_thresholds(copies, "__h", "__subset", {s: [e] for s, e in surplus.items() if e})
    cuts = F.array(*[F.lit(found.get((s, surplus[s]), "")) for s in range(n_subsets)])

    def left(s: Column, w: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0).cast("bigint"), w),
                               lambda j: (j > 0) & (_copy_hash(key, s, j, seed, attempt) > F.get(cuts, s)))).cast("bigint")

    weights = F.transform(counts, lambda w, s: F.struct(s.cast("int").alias("model"), left(s, w).alias("w")))
    return df.withColumn(out, F.filter(weights, lambda x: x["w"] > 0))


def bootstrap_weights(df: DataFrame, key: Sequence[str], n_subsets: int, n_rows: int | None = None,
                      seed: int = 0) -> DataFrame:
    """Exact bootstrap: ``key, subset, w`` with ``sum(w) = n_rows`` per subset.

    Rows that a subset did not draw are absent; rows are never copied.
    """
    drawn = bootstrap_array(df.select(*key), key, n_subsets, seed, "exact", "__mw", n_rows)
    return drawn.select(*key, F.inline("__mw").alias("subset", "w"))


def kfold(df: DataFrame, key: Sequence[str], n_folds: int, n_repeats: int = 1, seed: int = 0,
          exact: bool = True) -> DataFrame:
    """Shuffled k-fold per repeat: columns ``repeat`` and ``fold``.

    Exact folds differ in size by at most one row; they are cut at thresholds of
    the hash. Otherwise folds come from the hash alone. The table is not shuffled.
    """
    folds = fold_array(df, key, n_folds, n_repeats, seed, "__folds", exact)
    return folds.select(*df.columns, F.posexplode("__folds").alias("repeat", "fold"))


def fold_sizes(size: int, parts: int) -> list[int]:
    """Rows of ``parts`` equal runs that ``size`` rows fill, larger ones first."""
    small, extra = divmod(size, parts)
    return [small + (k < extra) for k in range(parts)]


def fold_array(df: DataFrame, key: Sequence[str], n_folds: int, n_repeats: int, seed: int = 0,
               out: str = "folds", exact: bool = False) -> DataFrame:
    """Add ``array<int>``: the row's fold in every repeat, from hashes and without a shuffle of the table."""
    repeats = F.sequence(F.lit(0), F.lit(n_repeats - 1))
    if not exact:
        return df.withColumn(out, F.transform(repeats, lambda r: draw_int(draw_hash(key, r, seed), n_folds).cast("int")))
    size = df.count()
    hashed = df.select(*key).withColumn("repeat", F.explode(repeats)).withColumn("__h", draw_hash(key, F.col("repeat"), seed))
    edges = list(accumulate(fold_sizes(size, n_folds)))[:-1]
    found = radix_thresholds(hashed, "__h", "repeat", {r: sorted({e for e in edges if e}) for r in range(n_repeats)})
    by_repeat: list[list[str]] = [[] for _ in range(n_repeats)]
    for (r, position), threshold in found.items():
        by_repeat[r] += [threshold] * edges.count(position)
    last = F.array(*[F.array(*[F.lit(t) for t in sorted(x)]).cast("array<string>") for x in by_repeat])
    return df.withColumn(out, F.zip_with(repeats, last, lambda r, cut: F.size(
        F.filter(cut, lambda t: t < draw_hash(key, r, seed))).cast("int")))


def holdout(df: DataFrame, key: Sequence[str], test_fraction: float, seed: int = 0) -> DataFrame:
    """Add ``is_test``; exactly ceil(fraction * rows) rows are test rows."""
    size = df.count()
    n_test = math.ceil(test_fraction * size)
    hashed = df.withColumn("__h", draw_hash(key, "holdout", seed))
    narrow = df.select(draw_hash(key, "holdout", seed).alias("__h"), F.lit(0).alias("__all"))
    found = radix_thresholds(narrow, "__h", "__all", {0: [n_test]}) if n_test else {}
    return hashed.withColumn("is_test", F.col("__h") <= F.lit(found.get((0, n_test), ""))).drop("__h")


def strata_thresholds(df: DataFrame, key: Sequence[str], label: str, n_rows: int, salt: str, seed: int) -> DataFrame:
    """(label, threshold): the last hash of each class in a sample of ``n_rows`` rows with the class shares of the
    table (largest remainders, then smaller label); a table of at most ``n_rows`` rows is taken whole."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(F.lit(1))
    quota = sizes.withColumn("__size", F.sum("__n").over(whole))
    ideal = F.lit(n_rows) * F.col("__n") / F.col("__size")
    quota = quota.withColumn("__base", F.floor(ideal)).withColumn("__frac", F.round(ideal - F.floor(ideal), 9))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("__frac").desc(), F.col(label))
    quota = quota.withColumn("__left", F.lit(n_rows) - F.sum("__base").over(whole)) \
        .withColumn("__take", F.when(F.col("__size") <= n_rows, F.col("__n"))
                    .otherwise(F.col("__base") + F.when(F.row_number().over(order) <= F.col("__left"), 1).otherwise(0)))
    quota = quota.select(label, F.col("__take").cast("bigint").alias("position")).filter("position > 0")
    hashed = df.withColumn("__h", draw_hash(key, salt, seed))
    last = hash_thresholds(hashed, "__h", quota, [label], df.count()).select(label, "threshold")
    return F.broadcast(last) if last.count() <= BROADCAST_CUTS else last


def stratified_sample(df: DataFrame, key: Sequence[str], label: str, n_rows: int, seed: int = 0) -> DataFrame:
    """``n_rows`` rows with the class shares of the table (largest remainders, then smaller label).

    A table of at most ``n_rows`` rows is returned whole; NULL is a class like the others.
    """
    last = strata_thresholds(df, key, label, n_rows, "strata", seed)
    hashed = df.withColumn("__h", draw_hash(key, "strata", seed))
    return null_safe_join(hashed, last, [label]).filter("__h <= threshold").drop("__h", "threshold")


def stratified_holdout(df: DataFrame, key: Sequence[str], label: str, fraction: float, salt: str = "validation",
                       seed: int = 0, out: str = "is_test") -> DataFrame:
    """Add ``out``: ceil(fraction * rows) rows are held out, with the class shares of the table."""
    last = strata_thresholds(df, key, label, math.ceil(fraction * df.count()), salt, seed)
    hashed = df.withColumn("__h", draw_hash(key, salt, seed))
    return null_safe_join(hashed, last, [label], "left").withColumn(
        out, F.coalesce(F.col("__h") <= F.col("threshold"), F.lit(False))).drop("__h", "threshold")


def feature_subspace(n_trees: int, n_features: int, max_features: int | None = None,
                     seed: int = 0) -> list[tuple[int, ...]]:
    """Features of every tree, drawn with replacement; ``int(sqrt(n))`` draws unless given.

    Model configuration of a few numbers per tree, hence made on the driver; the
    draws equal :func:`softgrove.functions.draws.draw_int`.
    """
    draws = max_features or max(1, int(math.sqrt(n_features)))
    out = []
    for t in range(n_trees):
        picked = {int(hashlib.md5(f"{t}-{d}-{seed}".encode()).hexdigest()[:DRAW_DIGITS], 16) % n_features
                  for d in range(draws)}
        out.append(tuple(sorted(picked)))
    return out
