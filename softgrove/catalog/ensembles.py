"""Boosted and bagged trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from softgrove.catalog.common import ORDERS_SQL, orders_tier, r, read, set_map
from softgrove.catalog.sampling import sql_bits, sql_bootstrap
from softgrove.catalog.sqlgen import TreeSql
from softgrove.catalog.trees import _AMOUNT, FEATURES, _priced, orders_base
from softgrove.functions import encode
from softgrove.functions.membership import widths
from softgrove.operators.fuzzify import FuzzySets
from softgrove.plans.baselines import compare_baselines as run_baselines
from softgrove.plans.boost import BoostedModel, BoostSpec, fit_boosted
from softgrove.plans.experiments import (Config, compare_modes as run_modes, cross_validate, cross_validate_boosted,
                                         grid_search)
from softgrove.plans.forest import ForestModel, ForestSpec, fit_bagged
from softgrove.plans.grow import StopRules
from softgrove.plans.reports import mean_error
from softgrove.plans.tree import TreeSpec
from softgrove.session import scratch_path

STUMP, TWO = StopRules(max_depth=0), StopRules(max_depth=1)


def _boost(df, task, n, rules, soft=False, **kw):
    target = "amount" if task == "value" else "tier"
    tree = TreeSpec(FEATURES, (target,), task, criterion="variance", rules=rules,
                    fuzzy_sets=set_map(*FEATURES) if soft else None)
    return fit_boosted(df, BoostSpec(tree, n_estimators=n, **kw))


def gbdt_regressor(spark, sf):
    df = _priced(spark, sf)
    return _boost(df, "value", 3, STUMP).transform(df).select("o_orderkey", r("prediction").alias("prediction"))


def gbdt_regressor_soft(spark, sf):
    df = _priced(spark, sf)
    return _boost(df, "value", 2, TWO, soft=True).transform(df).select("o_orderkey", r("prediction").alias("prediction"))


def gbdt_loss_curve(spark, sf):
    df = _priced(spark, sf)
    return _boost(df, "value", 3, STUMP).loss_curve(df).select("round", r("loss", 4).alias("loss"))


def gbdt_classifier(spark, sf):
    df = _priced(spark, sf)
    return _boost(df, "class", 3, TWO).transform(df).select("o_orderkey", "prediction")


def gbdt_predict(spark, sf):
    """Class probabilities after boosting with the softmax gradient."""
    df = _priced(spark, sf)
    out = _boost(df, "class", 2, TWO, loss="softmax").transform(df)
    return out.select("o_orderkey", F.posexplode("probability").alias("k", "p")).select(
        "o_orderkey", "k", r("p").alias("p"))


WIDE = ("o_totalprice", "o_month", "o_day", "o_year")
TREES = 5


def _wide(spark, sf):
    days = read(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", F.dayofmonth("o_orderdate").cast("double").alias("o_day"),
        F.year("o_orderdate").cast("double").alias("o_year"))
    return _priced(spark, sf).join(days, "o_orderkey")


def forest_classifier(spark, sf):
    df = _wide(spark, sf)
    model = fit_bagged(df, ForestSpec(TreeSpec(WIDE, ("tier",), rules=TWO), ("o_orderkey",), TREES, seed=5))
    return model.transform(df).select("o_orderkey", "prediction")


def forest_regressor(spark, sf):
    df = _wide(spark, sf)
    model = fit_bagged(df, ForestSpec(TreeSpec(WIDE, ("amount",), "value", rules=TWO), ("o_orderkey",), TREES, seed=5))
    return model.transform(df).select("o_orderkey", r("prediction").alias("prediction"))


EMB = tuple(f"e{i}" for i in range(64))
EMB_TREES = 20


def embeddings_wide(spark, sf):
    return read(spark, sf, "embeddings", "vec_id", "label", "embedding").select(
        "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])


def forest_predict(spark, sf):
    """A forest of many trees on many features; scoring walks the trees a batch at a time."""
    df = embeddings_wide(spark, sf)
    model = fit_bagged(df, ForestSpec(TreeSpec(EMB, ("label",), rules=TWO), ("vec_id",), EMB_TREES, seed=5))
    return model.transform(df).select("vec_id", "prediction")


def forest_big(spark, sf):
    """More nodes than one nested condition holds: rows are routed by joins, scored by the batch walk."""
    df = embeddings_wide(spark, sf)
    rules = StopRules(max_depth=3)
    model = fit_bagged(df, ForestSpec(TreeSpec(EMB, ("label",), rules=rules), ("vec_id",), EMB_TREES, seed=5))
    return model.transform(df).select("vec_id", "prediction")


def forest_saved(spark, sf):
    """Train, save, load and score."""
    df, path = _wide(spark, sf), scratch_path(spark, "forest")
    fit_bagged(df, ForestSpec(TreeSpec(WIDE, ("tier",), rules=TWO), ("o_orderkey",), TREES, seed=5)).save(spark, path)
    return ForestModel.load(spark, path).transform(df).select("o_orderkey", "prediction")


def gbdt_saved(spark, sf):
    """Train, save, load and score."""
    df, path = _priced(spark, sf), scratch_path(spark, "boosting")
    _boost(df, "class", 2, TWO, loss="softmax").save(spark, path)
    return BoostedModel.load(spark, path).transform(df).select(
        "o_orderkey", F.posexplode("probability").alias("k", "p")).select("o_orderkey", "k", r("p").alias("p"))


def gbdt_rounds(spark, sf):
    """Twelve rounds; the scores are checkpointed every five."""
    df = _priced(spark, sf)
    return _boost(df, "value", 12, STUMP, checkpoint_every=5).transform(df).select(
        "o_orderkey", r("prediction", 3).alias("prediction"))


def _stumps(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return read(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax").select(
        F.when(q >= 25, 2).otherwise(0).alias("a"), F.when(d >= 0.05, 2).otherwise(1).alias("b"),
        F.when(t >= 0.04, 0).otherwise(1).alias("c"))


def forest_vote(spark, sf):
    votes = encode.majority_of([F.col("a"), F.col("b"), F.col("c")])
    return _stumps(spark, sf).groupBy("a", "b", "c", votes.alias("vote")).agg(F.count(F.lit(1)).alias("n"))


def forest_mean(spark, sf):
    mean = encode.mean_of([F.col("a"), F.col("b"), F.col("c")])
    return _stumps(spark, sf).groupBy("a", "b", "c", r(mean).alias("mean")).agg(F.count(F.lit(1)).alias("n"))


# ---- experiments ----

def _score_view(df, measures, extra=()):
    return df.select(*extra, "config", "repeat", "fold", *[r(m).alias(m) for m in measures], "n_test")


def cv_stump_accuracy(spark, sf):
    out = cross_validate(_priced(spark, sf), TreeSpec(FEATURES, ("tier",), rules=STUMP), ["o_orderkey"], [Config()],
                         n_folds=5, n_repeats=1, seed=7)
    return _score_view(out, ["acc_train", "acc_test"])


def cv_regressor_mse(spark, sf):
    out = cross_validate(_priced(spark, sf), TreeSpec(FEATURES, ("amount",), "value", rules=STUMP), ["o_orderkey"],
                         [Config()], n_folds=5, n_repeats=1, seed=7)
    return _score_view(out, ["mse_train", "mse_test"])


def _even_sets(k: int) -> FuzzySets:
    """Evenly spaced sets over the order prices and months."""
    return FuzzySets.from_centroids({
        "o_totalprice": [(j + 0.5) * 500000.0 / k for j in range(k)], "o_month": [1.0 + (j + 0.5) * 11.0 / k for j in range(k)]})


REGS = (0.0, 0.5, 1.0)
SIZES = (3, 4, 5)


def grid_mean_error(spark, sf):
    fits = grid_search(_priced(spark, sf), TreeSpec(FEATURES, ("tier",), rules=STUMP), ["o_orderkey"],
                       {k: _even_sets(k).sets for k in SIZES}, REGS, "orders", n_repeats=2, n_folds=2, seed=7)
    out = mean_error(fits, ["ds_name", "n_conv", "fuzzy_reg"])
    return out.select("ds_name", "n_conv", "fuzzy_reg", *[r(c).alias(c) for c in (
        "err_train_mean", "std_train", "err_test_mean", "std_test")])


def compare_modes(spark, sf):
    """Membership features, soft and crisp trees over repeats and folds, in one training run."""
    out = run_modes(_priced(spark, sf), TreeSpec(FEATURES, ("tier",), rules=STUMP), ["o_orderkey"], "orders", n_folds=3,
                    n_repeats=2, seed=7, sets={k: _even_sets(k) for k in SIZES})
    return out.select("comparison_mode", "ds_name", "with_fuzzy_rules", "sn", "fold", r("acc_test").alias("acc_test"),
                      r("acc_train").alias("acc_train"))


def compare_boosting(spark, sf):
    """Soft and crisp boosted classifiers over folds; all models advance together."""
    tree = TreeSpec(FEATURES, ("tier",), criterion="variance", rules=STUMP)
    out = cross_validate_boosted(_priced(spark, sf), BoostSpec(tree, n_estimators=2, n_classes=3), ["o_orderkey"],
                                 [Config(variant=0), Config()], [set_map(*FEATURES)], 2, 1, seed=7)
    return _score_view(out, ["acc_train", "acc_test"])


def compare_baselines(spark, sf):
    """Soft and crisp tree against Spark's own tree learners on a stratified sample of the orders."""
    spec = TreeSpec(FEATURES, ("tier",), fuzzy_sets=set_map(*FEATURES), rules=TWO)
    out = run_baselines(orders_tier(spark, sf), spec, ["o_orderkey"], "orders", 1000, n_folds=2, n_repeats=1, seed=7)
    return out.select("model_name", "ds_name", "with_fuzzy_rules", "sn", "fold", r("acc_test").alias("acc_test"))


QUERIES = {f.__name__: f for f in (
    compare_baselines, forest_big, forest_saved, gbdt_saved, gbdt_rounds, gbdt_regressor, gbdt_regressor_soft, gbdt_loss_curve, gbdt_classifier, gbdt_predict, forest_classifier,
    forest_regressor, forest_predict, forest_vote, forest_mean, cv_stump_accuracy, cv_regressor_mse, grid_mean_error,
    compare_modes, compare_boosting)}


# ---- SQL ----

def boost_sql(state: str, outputs: int, rounds: int, levels: int, gradient: str, rate: str = "0.1", soft: bool = False,
              n_features: int = 2) -> tuple[str, str]:
    """CTEs of all rounds over ``state(model, rid, w, y0.., f0.., [m0..])``; returns text and the last relation.

    ``gradient`` uses {y} and {s} (score) per output, or {sm} for the softmax share.
    """
    text, ks = [], range(outputs)
    cols = ", ".join(["model", "rid", "w", *[f"f{i}" for i in range(n_features)]]
                     + ([f"m{i}" for i in range(n_features)] if soft else []))
    for i in range(rounds):
        if i == 0:
            t = [f"y{k} AS t{k}" for k in ks]
        else:
            raised = " + ".join(f"exp(s{k})" for k in ks)
            t = [gradient.format(y=f"y{k}", s=f"s{k}", sm=f"exp(s{k}) / ({raised})") + f" AS t{k}" for k in ks]
        src = state if i == 0 else f"st{i}"
        text.append(f"bb{i} AS (SELECT {cols}, {', '.join(t)} FROM {src} WHERE w > 0)")
        tree = TreeSql(n_features, "value", outputs, soft=soft, prefix=f"b{i}", base=f"bb{i}")
        for _ in range(levels):
            tree.level()
        tree.leaves().route(src, f"ra{i}")
        text.append(tree.text())
        new = [f"l.mean{k} AS s{k}" if i == 0 else f"r.s{k} - {rate} * l.mean{k} AS s{k}" for k in ks]
        drop = "node" if i == 0 else ", ".join(["node", *[f"s{k}" for k in ks]])
        text.append(f"st{i + 1} AS (SELECT r.* EXCLUDE ({drop}), {', '.join(new)} FROM ra{i} r JOIN b{i}_leaf l USING (model, node))")
    return ", ".join(text), f"st{rounds}"


def _boost_query(task: str, rounds: int, levels: int, body: str, gradient: str = "{y} - {s}", soft: bool = False) -> str:
    ys = (f"{_AMOUNT} AS y0" if task == "value"
          else ", ".join(f"CASE WHEN tier = {k} THEN 1.0::DOUBLE ELSE 0 END AS y{k}" for k in range(3)))
    base = orders_base("tier", soft).replace("tier AS y,", f"{ys},")
    text, last = boost_sql("state", 1 if task == "value" else 3, rounds, levels,
                           "{s} - {y}" if task == "value" else gradient, soft=soft)
    return f"WITH {ORDERS_SQL}, state AS ({base}), {text} {body.replace('LAST', last)}"


_ARGMAX = "CAST(list_position([s0, s1, s2], greatest(s0, s1, s2)) - 1 AS INTEGER)"
_SUM = "(exp(s0) + exp(s1) + exp(s2))"


def _forest_sql(n_trees: int, n_features: int, draws: int, source: str, key: str, base_cols: str, task: str, width: int,
                body: str, prelude: str, levels: int = 2, seed: int = 5) -> str:
    """Bootstrap weights and feature draws from md5, then all trees by level."""
    tree = TreeSql(n_features, task, width, base="base", subset="subset")
    for _ in range(levels):
        tree.level()
    tree.leaves().route("everyone", "every")
    return f"""
WITH {prelude}
{sql_bootstrap(source, key, n_trees, seed)},
subset AS (SELECT DISTINCT CAST(t AS INTEGER) AS model,
           CAST({sql_bits(f"md5(concat_ws('-', t, d, '{seed}'))")} % {n_features} AS INTEGER) AS fi
           FROM range({n_trees}) a(t), range({draws}) b(d)),
data AS (SELECT {key} AS rid, {base_cols} FROM {source}),
base AS (SELECT model, w::DOUBLE AS w, data.* FROM wts JOIN data USING (rid)),
everyone AS (SELECT CAST(s AS INTEGER) AS model, data.* FROM data, range({n_trees}) t(s)),
{tree.text()} {body}"""


_WIDE_PRE = (f"{ORDERS_SQL}, wide AS (SELECT t.*, {_AMOUNT.replace('o_totalprice', 't.o_totalprice')} AS amount, "
             f"CAST(day(o.o_orderdate) AS DOUBLE) AS o_day, CAST(year(o.o_orderdate) AS DOUBLE) AS o_year "
             f"FROM orders_t t JOIN orders o USING (o_orderkey)),")
_WIDE_F = ", ".join(f"{f} AS f{i}" for i, f in enumerate(WIDE))
_VOTE = ("SELECT rid AS {key}, arg_min(label, (-c, label)) AS prediction FROM (SELECT rid, label, count(*) AS c FROM every "
         "JOIN t_leaf USING (model, node) GROUP BY 1, 2) GROUP BY 1")


def _cv_sql(folds: int, repeats: int, configs: int, base_of: str, tree: TreeSql, measure: str, body: str,
            prelude: str = "") -> str:
    """Models (config, repeat, fold) over all orders; ``w`` is 1 on the training folds."""
    tree.level().leaves().route("cvall", "every")
    return f"""
WITH {ORDERS_SQL}{prelude},
folds AS (SELECT o_orderkey, CAST(s AS INTEGER) AS rep, ntile({folds}) OVER (PARTITION BY s ORDER BY
          md5(concat_ws('-', o_orderkey, s, '7'))) - 1 AS fold FROM orders, range({repeats}) t(s)),
cvall AS (SELECT CAST((c * {repeats} + rep) * {folds} + k AS INTEGER) AS model, CAST(c AS INTEGER) AS config, rep AS repeat,
          CAST(k AS INTEGER) AS tfold, o.o_orderkey AS rid, CASE WHEN fold <> k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w, {base_of}
          FROM orders_t o JOIN folds USING (o_orderkey), range({configs}) a(c), range({folds}) b(k)),
base AS (SELECT * FROM cvall WHERE w > 0), {tree.text()},
scored AS (SELECT config, repeat, tfold AS fold, avg({measure}) FILTER (w > 0) AS train, avg({measure}) FILTER (w = 0) AS test,
           count(*) FILTER (w = 0) AS n_test FROM every JOIN t_leaf USING (model, node) GROUP BY 1, 2, 3)
{body}"""


_TWO_F = "o_totalprice AS f0, o_month AS f1"
_HIT = "CASE WHEN y = label THEN 1.0 ELSE 0.0 END"


def _even_terms(k: int, feature: str) -> list[str]:
    sets = _even_sets(k).sets[feature]
    assert [w for _, w in sets] == widths([c for c, _ in sets])
    return [f"greatest(0.0, 1.0 - abs({feature} - {c!r}) / {t!r})" for c, t in sets]


def _even_mass(i: int) -> str:
    """Membership mass of a feature by config: 3, 4 or 5 sets, none for the crisp config."""
    f = FEATURES[i]
    return "CASE c " + " ".join(f"WHEN {j} THEN {' + '.join(_even_terms(k, f))}" for j, k in enumerate(SIZES)) + " ELSE 0 END"


def _grid_sql() -> str:
    base = f"tier AS y, {_TWO_F}, {_even_mass(0)} AS m0, {_even_mass(1)} AS m1"
    n = len(SIZES)
    body = (f"SELECT 'orders' AS ds_name, CAST(size AS INTEGER) AS n_conv, CAST(reg AS DOUBLE) AS fuzzy_reg, "
            f"round(1 - abs(avg(train)), 6) AS err_train_mean, round(stddev_pop(train), 6) AS std_train, "
            f"round(1 - abs(avg(test)), 6) AS err_test_mean, round(stddev_pop(test), 6) AS std_test FROM "
            f"(SELECT i, size, reg, CASE WHEN reg IN (0, 1) THEN {n} ELSE i END AS config FROM "
            f"(VALUES {', '.join(f'({i}, {s})' for i, s in enumerate(SIZES))}) a(i, size), "
            f"(VALUES {', '.join(f'({g})' for g in REGS)}) b(reg)) JOIN scored USING (config) GROUP BY size, reg")
    return _cv_sql(2, 2, n + 1, base, TreeSql(2, soft=True), _HIT, body)


def _modes_sql() -> str:
    features, subset = ["o_totalprice AS f0", "o_month AS f1"], [(0, 0), (0, 1)]
    at = 2
    for c, k in enumerate(SIZES, start=1):
        subset += [(c, 0), (c, 1)]
        for f in FEATURES:
            for e in _even_terms(k, f):
                features.append(f"{e} AS f{at}")
                subset.append((c, at))
                at += 1
    soft = len(SIZES) + 1
    subset += [(soft, 0), (soft, 1)]
    masses = [f"CASE c WHEN {soft} THEN {' + '.join(_even_terms(5, f))} ELSE 0 END AS m{i}" for i, f in enumerate(FEATURES)]
    masses += [f"0.0::DOUBLE AS m{i}" for i in range(2, at)]
    pre = (f", sub AS (SELECT * FROM (VALUES {', '.join(map(str, subset))}) v(config, fi)), subset AS (SELECT CAST((config * 2 + r) "
           f"* 3 + k AS INTEGER) AS model, fi FROM sub, range(2) a(r), range(3) b(k))")
    modes = [(f"f{k}_ds_vs_orig_ds", c) for c, k in enumerate(SIZES, start=1)] + [("fdt_vs_nfdt", soft)]
    rows = ", ".join(f"('{m}', {c}, TRUE), ('{m}', 0, FALSE)" for m, c in modes)
    body = (f"SELECT mode AS comparison_mode, 'orders' AS ds_name, fuzzy AS with_fuzzy_rules, repeat AS sn, fold, "
            f"round(test, 6) AS acc_test, round(train, 6) AS acc_train FROM (VALUES {rows}) v(mode, config, fuzzy) "
            f"JOIN scored USING (config)")
    return _cv_sql(3, 2, soft + 1, f"tier AS y, {', '.join(features + masses)}", TreeSql(at, soft=True, subset="subset"),
                   _HIT, body, pre)


def _compare_boosting_sql() -> str:
    from softgrove.catalog.common import sql_mass

    ys = ", ".join(f"CASE WHEN tier = {k} THEN 1.0::DOUBLE ELSE 0 END AS y{k}" for k in range(3))
    masses = ", ".join(f"CASE c WHEN 0 THEN {sql_mass(f, f)} ELSE 0 END AS m{i}" for i, f in enumerate(FEATURES))
    text, last = boost_sql("cvall", 3, 2, 1, "{y} - {s}", soft=True)
    hit = f"CASE WHEN tier = {_ARGMAX} THEN 1.0 ELSE 0.0 END"
    return f"""
WITH {ORDERS_SQL},
folds AS (SELECT o_orderkey, ntile(2) OVER (ORDER BY md5(concat_ws('-', o_orderkey, '0', '7'))) - 1 AS fold FROM orders),
cvall AS (SELECT CAST(c * 2 + k AS INTEGER) AS model, CAST(c AS INTEGER) AS config, CAST(k AS INTEGER) AS tfold, tier,
          o.o_orderkey AS rid, CASE WHEN fold <> k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w, {ys}, {_TWO_F}, {masses}
          FROM orders_t o JOIN folds USING (o_orderkey), range(2) a(c), range(2) b(k)),
{text}
SELECT config, 0 AS repeat, tfold AS fold, round(avg({hit}) FILTER (w > 0), 6) AS acc_train,
       round(avg({hit}) FILTER (w = 0), 6) AS acc_test, count(*) FILTER (w = 0) AS n_test FROM {last} GROUP BY 1, 2, 3"""


_STUMPS = ("SELECT a, b, c, {e}, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= 25 THEN 2 ELSE 0 END AS a, CASE WHEN "
           "l_discount >= 0.05 THEN 2 ELSE 1 END AS b, CASE WHEN l_tax >= 0.04 THEN 0 ELSE 1 END AS c FROM lineitem) GROUP BY a, b, c")
_VIEW = "SELECT config, repeat, fold, round(train, 6) AS {m}_train, round(test, 6) AS {m}_test, n_test FROM scored"

ORACLES = {
    "gbdt_regressor": _boost_query("value", 3, 1, "SELECT rid AS o_orderkey, round(s0, 6) AS prediction FROM LAST"),
    "gbdt_regressor_soft": _boost_query("value", 2, 2, "SELECT rid AS o_orderkey, round(s0, 6) AS prediction FROM LAST", soft=True),
    "gbdt_loss_curve": _boost_query("value", 3, 1, " UNION ALL ".join(
        f"SELECT {i} AS round, round(avg(0.5 * (y0 - s0) * (y0 - s0)), 4) AS loss FROM st{i + 1}" for i in range(3))),
    "gbdt_classifier": _boost_query("class", 3, 2, f"SELECT rid AS o_orderkey, {_ARGMAX} AS prediction FROM LAST"),
    "gbdt_predict": _boost_query("class", 2, 2, f"SELECT rid AS o_orderkey, k, round(CASE k WHEN 0 THEN exp(s0) WHEN 1 THEN "
                                                f"exp(s1) ELSE exp(s2) END / {_SUM}, 6) AS p FROM LAST, (VALUES (0), (1), (2)) t(k)",
                                 gradient="{sm} - {y}"),
    "forest_classifier": _forest_sql(TREES, 4, 2, "wide", "o_orderkey", f"tier AS y, {_WIDE_F}", "class", 3,
                                     _VOTE.format(key="o_orderkey"), _WIDE_PRE),
    "forest_regressor": _forest_sql(TREES, 4, 2, "wide", "o_orderkey", f"amount AS t0, {_WIDE_F}", "value", 1,
                                    "SELECT rid AS o_orderkey, round(avg(mean0), 6) AS prediction FROM every JOIN t_leaf USING "
                                    "(model, node) GROUP BY 1", _WIDE_PRE),
    "forest_predict": _forest_sql(EMB_TREES, 64, 8, "embeddings", "vec_id",
                                  "label AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64)),
                                  "class", 10, _VOTE.format(key="vec_id"), ""),
    "forest_big": _forest_sql(EMB_TREES, 64, 8, "embeddings", "vec_id",
                              "label AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64)),
                              "class", 10, _VOTE.format(key="vec_id"), "", levels=4),
    "gbdt_rounds": _boost_query("value", 12, 1, "SELECT rid AS o_orderkey, round(s0, 3) AS prediction FROM LAST"),
    "forest_vote": _STUMPS.replace("{e}", "CASE WHEN b = c THEN b WHEN a = b OR a = c THEN a ELSE least(a, b, c) END AS vote"),
    "forest_mean": _STUMPS.replace("{e}", "round((a + b + c) / 3.0, 6)::DOUBLE AS mean"),
    "cv_stump_accuracy": _cv_sql(5, 1, 1, f"tier AS y, {_TWO_F}", TreeSql(2), _HIT, _VIEW.replace("{m}", "acc")),
    "cv_regressor_mse": _cv_sql(5, 1, 1, f"{_AMOUNT} AS t0, {_TWO_F}", TreeSql(2, "value", 1), "(t0 - mean0) * (t0 - mean0)",
                                _VIEW.replace("{m}", "mse")),
    "grid_mean_error": _grid_sql(),
    "compare_modes": _modes_sql(),
    "compare_boosting": _compare_boosting_sql(),
}
ORACLES["forest_saved"] = ORACLES["forest_classifier"]
ORACLES["gbdt_saved"] = ORACLES["gbdt_predict"]
