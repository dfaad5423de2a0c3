"""Repeated cross-validation, parameter grids and comparisons.

All folds, repeats, parameter values and modes are models of one level-wise
training run, told apart by the grouping key ``model``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.functions.sqltext import name
from softgrove.operators.fuzzify import FuzzySets
from softgrove.operators.sampling import fold_array
from softgrove.plans.boost import BoostSpec, fit_boosted_models
from softgrove.plans.frame import FuzzySetMap, ModelSpec, feature_arrays
from softgrove.plans.route import Forest, leaf_values
from softgrove.plans.tree import Coding, TreeSpec, fit_forest, leaf_label, leaf_mean, target_columns

# Names of the comparison modes in result tables. The first one is
# used with 3, 4 and 5 sets.
FEATURE_MODE = "f{size}_ds_vs_orig_ds"
SOFT_TREE_MODE = "fdt_vs_nfdt"
BOOSTING_MODE = "fgbdt_vs_nfgbdt"

TRIAL_SCHEMA = "model int, config int, repeat int, fold int"


@dataclass(frozen=True)
class Config:
    """One setting to cross-validate: fuzzy sets (position in the list, or None) and usable features."""

    variant: int | None = None
    features: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Trial:
    model: int
    config: int
    repeat: int
    fold: int


def trials(n_configs: int, n_repeats: int, n_folds: int) -> list[Trial]:
    return [Trial((c * n_repeats + r) * n_folds + f, c, r, f)
            for c in range(n_configs) for r in range(n_repeats) for f in range(n_folds)]


def with_folds(df: DataFrame, key: Sequence[str], n_folds: int, n_repeats: int, seed: int, exact: bool) -> DataFrame:
    """Add ``__folds``, the fold of the row in each repeat."""
    return fold_array(df, key, n_folds, n_repeats, seed, "__folds", exact)


def trial_weights(todo: Sequence[Trial], n_repeats: int, n_folds: int, n_configs: int, test: bool) -> str:
    """SQL of ``array<struct<model, w>>``: the models a row trains (or tests)."""
    op = "=" if test else "!="
    per = n_repeats * n_folds
    return (f"filter(transform(sequence(0, {len(todo) - 1}), i -> struct(i AS model, "
            f"if(get(__folds, cast((i % {per}) DIV {n_folds} AS int)) {op} i % {n_folds}, 1L, 0L) AS w)), s -> s.w > 0)")


def trial_flags(todo: Sequence[Trial], n_repeats: int, n_folds: int) -> str:
    """SQL of ``array<struct<model, is_test>>``: whether each model holds the row out."""
    return (f"transform(sequence(0, {len(todo) - 1}), i -> struct(i AS model, "
            f"get(__folds, cast((i % {n_repeats * n_folds}) DIV {n_folds} AS int)) = i % {n_folds} AS is_test))")


def _score(df: DataFrame, spec: TreeSpec, forest: Forest, coding: Coding, todo: Sequence[Trial], n_repeats: int,
           n_folds: int, n_configs: int, values, target_sql: str, measure: str) -> DataFrame:
    """Measure of every model on its training and on its test rows."""
    rows = df.withColumns({**feature_arrays(spec.features, spec.categorical), "__y": F.expr(target_sql)})
    both = rows.selectExpr(*[c for c in ("x", "xc") if c in rows.columns], "__y",
                           f"inline({trial_flags(todo, n_repeats, n_folds)})")
    predicted = leaf_values(both, forest, values, "__p")
    grouped = predicted.groupBy("model").agg(
        F.expr(f"avg(if(is_test, NULL, {measure})) AS train"), F.expr(f"avg(if(is_test, {measure}, NULL)) AS test"),
        F.expr("count_if(is_test) AS n_test"))
    keys = df.sparkSession.createDataFrame([(t.model, t.config, t.repeat, t.fold) for t in todo], TRIAL_SCHEMA)
    return keys.join(grouped, "model").drop("model")


def cross_validate(df: DataFrame, spec: TreeSpec, key: Sequence[str], configs: Sequence[Config],
                   variants: Sequence[FuzzySetMap] = (), n_folds: int = 10, n_repeats: int = 1, seed: int = 0,
                   exact_folds: bool = True) -> DataFrame:
    """Repeated k-fold of every config in one training run.

    Result: ``config, repeat, fold, acc_train, acc_test, n_test, elapsed_time``
    (regression: ``mse_train, mse_test``). ``elapsed_time`` is the share of one
    model in the whole training time.
    """
    started = time.time()
    folded = with_folds(df, key, n_folds, n_repeats, seed, exact_folds)
    todo = trials(len(configs), n_repeats, n_folds)
    models = [ModelSpec(t.model, configs[t.config].variant, configs[t.config].features) for t in todo]
    weighted = folded.withColumn("mw", F.expr(trial_weights(todo, n_repeats, n_folds, len(configs), False)))
    forest, coding = fit_forest(weighted, spec, models, variants, "mw", df, "__folds", [(t.repeat, t.fold) for t in todo])
    elapsed = (time.time() - started) / len(todo)
    if spec.task == "class":
        target = "yi"
        scored = folded.withColumns(target_columns(coding, spec.targets))
        out = _score(scored, spec, forest, coding, todo, n_repeats, n_folds, len(configs),
                     lambda n: [float(coding.labels.index(leaf_label(n, coding)))], target,
                     "if(get(__p, 0) = __y, 1D, 0D)")
        names = ("acc_train", "acc_test")
    else:
        out = _score(folded, spec, forest, coding, todo, n_repeats, n_folds, len(configs),
                     lambda n: leaf_mean(n, coding), f"cast({name(spec.targets[0])} AS double)",
                     "(get(__p, 0) - __y) * (get(__p, 0) - __y)")
        names = ("mse_train", "mse_test")
    return out.withColumnsRenamed({"train": names[0], "test": names[1]}).withColumn("elapsed_time", F.lit(elapsed))


def cross_validate_boosted(df: DataFrame, spec: BoostSpec, key: Sequence[str], configs: Sequence[Config],
                           variants: Sequence[FuzzySetMap] = (), n_folds: int = 10, n_repeats: int = 1,
                           seed: int = 0, exact_folds: bool = True) -> DataFrame:
    """Repeated k-fold of boosted classifiers; all models advance one round together."""
    started = time.time()
    folded = with_folds(df, key, n_folds, n_repeats, seed, exact_folds)
    todo = trials(len(configs), n_repeats, n_folds)
    models = [ModelSpec(t.model, configs[t.config].variant, configs[t.config].features) for t in todo]
    weighted = folded.withColumn("mw", F.expr(trial_weights(todo, n_repeats, n_folds, len(configs), False)))
    rounds, width = fit_boosted_models(weighted, spec, models, variants, "mw")
    elapsed = (time.time() - started) / len(todo)
    target = name(spec.tree.targets[0])
    rows = folded.withColumns({**feature_arrays(spec.tree.features, spec.tree.categorical),
                               "__y": F.expr(f"cast({target} AS int)")})
    out = rows.selectExpr(*[c for c in ("x", "xc") if c in rows.columns], "__y", f"inline({trial_flags(todo, n_repeats, n_folds)})")
    for i, (forest, coding) in enumerate(rounds):
        out = leaf_values(out, forest, lambda n, c=coding: leaf_mean(n, c), "__p")
        grown = ", ".join(map(str, sorted(forest)))  # the others have stopped before this round
        add = "__p" if i == 0 else f"if(model IN ({grown}), zip_with(__f, __p, (f, p) -> f - {spec.learning_rate!r}D * p), __f)"
        out = out.withColumn("__f", F.expr(add)).drop("__p")
    hit = "if(array_position(__f, array_max(__f)) - 1 = __y, 1D, 0D)"
    grouped = out.groupBy("model").agg(
        F.expr(f"avg(if(is_test, NULL, {hit})) AS acc_train"), F.expr(f"avg(if(is_test, {hit}, NULL)) AS acc_test"),
        F.expr("count_if(is_test) AS n_test"))
    keys = df.sparkSession.createDataFrame([(t.model, t.config, t.repeat, t.fold) for t in todo], TRIAL_SCHEMA)
    return keys.join(grouped, "model").drop("model").withColumn("elapsed_time", F.lit(elapsed))


def grid_search(df: DataFrame, spec: TreeSpec, key: Sequence[str], sets_by_size: dict[int, FuzzySetMap],
                fuzzy_regs: Sequence[float], ds_name: str, n_repeats: int = 10, n_folds: int = 2,
                seed: int = 0) -> DataFrame:
    """Accuracy of every (number of sets, regulation) and the error statistics over its fits.

    A regulation of 0 or 1 switches softness off; other values leave the
    memberships as they are, so equal settings are trained once.
    """
    sizes = sorted(sets_by_size)
    configs = [Config(variant=i) for i in range(len(sizes))] + [Config()]
    fits = cross_validate(df, spec, key, configs, [sets_by_size[s] for s in sizes], n_folds, n_repeats, seed)
    grid = [(ds_name, s, float(reg), len(sizes) if reg in (0.0, 1.0) else i)
            for i, s in enumerate(sizes) for reg in fuzzy_regs]
    points = df.sparkSession.createDataFrame(grid, "ds_name string, n_conv int, fuzzy_reg double, config int")
    return points.join(fits, "config").drop("config")


def membership_modes(df: DataFrame, spec: TreeSpec, sizes: Sequence[int] = (3, 4, 5), soft_size: int = 5,
                     sets: dict[int, FuzzySets] | None = None):
    """Inputs of the comparison: memberships as extra columns, and one config per mode.

    Returns the widened table, the widened spec, fuzzy sets for the soft mode and
    ``[(mode, with_fuzzy_rules, config), ...]``. The crisp partner of all tree modes
    is the same model, trained once.
    """
    base = list(spec.features)
    fitted = sets or {s: FuzzySets.fit(df, base, s) for s in sorted({*sizes, soft_size})}
    wide, features, modes = df, list(base), []
    configs: list[Config] = [Config(features=tuple(range(len(base))))]
    for s in sizes:
        start = len(features)
        for f, sets_of in fitted[s].sets.items():
            renamed = FuzzySets({f: sets_of}).flatten(wide)
            wide = renamed.withColumnsRenamed({f"dm_{f}_{j}": f"ff{s}_{f}_{j}" for j in range(len(sets_of))})
            features += [f"ff{s}_{f}_{j}" for j in range(len(sets_of))]
        configs.append(Config(features=(*range(len(base)), *range(start, len(features)))))
        modes.append((FEATURE_MODE.format(size=s), len(configs) - 1))
    configs.append(Config(variant=0, features=tuple(range(len(base)))))
    modes.append((SOFT_TREE_MODE, len(configs) - 1))
    rows = [(m, fuzzy, c if fuzzy else 0) for m, c in modes for fuzzy in (True, False)]
    return wide, replace(spec, features=tuple(features), fuzzy_sets=None), [fitted[soft_size].sets], configs, rows


def compare_modes(df: DataFrame, spec: TreeSpec, key: Sequence[str], ds_name: str, n_folds: int = 10,
                  n_repeats: int = 10, seed: int = 0, sets: dict[int, FuzzySets] | None = None,
                  boosting: BoostSpec | None = None, soft_size: int = 5) -> DataFrame:
    """Soft against crisp for every mode: membership features (3, 4, 5 sets), soft
    tree and, with ``boosting``, the boosted classifier.

    Result: ``comparison_mode, ds_name, with_fuzzy_rules, sn, fold, acc_test, acc_train, elapsed_time``.
    """
    wide, wide_spec, variants, configs, rows = membership_modes(df, spec, soft_size=soft_size, sets=sets)
    fits = cross_validate(wide, wide_spec, key, configs, variants, n_folds, n_repeats, seed)
    modes = df.sparkSession.createDataFrame(rows, "comparison_mode string, with_fuzzy_rules boolean, config int")
    out = modes.join(fits, "config").drop("config")
    if boosting is not None:
        fits = cross_validate_boosted(df, boosting, key, [Config(variant=0), Config()], variants, n_folds, n_repeats, seed)
        out = out.unionByName(
            fits.withColumn("comparison_mode", F.lit(BOOSTING_MODE))
            .withColumn("with_fuzzy_rules", F.col("config") == 0).drop("config"))
    return out.withColumnRenamed("repeat", "sn").withColumn("ds_name", F.lit(ds_name)).select(
        "comparison_mode", "ds_name", "with_fuzzy_rules", "sn", "fold", "acc_test", "acc_train", "elapsed_time")
