"""Hand-computed answers and corner cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from softgrove.functions import encode
from softgrove.functions.criteria import GainSpec, crisp_gain, register_class_criterion
from softgrove.functions.membership import memberships, widths
from softgrove.operators.fuzzify import FuzzySets, lloyd_on_counts, lloyd_step
from softgrove.operators.impurity import binary_gain, label_shares, majority_label
from softgrove.operators.multiway import discrete_counts, feature_scores
from softgrove.operators.quantiles import describe
from softgrove.operators.splits import Layout, candidate_sums, prefix_sums, score, unroll
from softgrove.plans.boost import BoostSpec, fit_boosted
from softgrove.plans.forest import ForestSpec, fit_bagged
from softgrove.plans.frame import ModelSpec, masses_sql, training_rows
from softgrove.plans.grow import StopRules
from softgrove.plans.tree import TreeModel, TreeSpec, fit_tree, label_coding, target_columns, value_coding

SETS = {"x": tuple(zip((1.5, 3.5), widths((1.5, 3.5))))}


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(1, 1.0, 0, 1.0), (2, 2.0, 0, 2.0), (3, 3.0, 1, 3.0), (4, 4.0, 1, 4.0)],
                                 "id int, x double, label int, y double")


def candidates(df, target, task, criterion, sets=None):
    coding = label_coding(df, target) if task == "class" else value_coding(df, [target])
    models = [ModelSpec(0, 0 if sets else None)]
    layout = Layout(("x",), task, coding.width, GainSpec(criterion, soft=sets is not None),
                    masses=masses_sql(("x",), [sets], models) if sets else "0D")
    rows = training_rows(df, ("x",), (), target_columns(coding, [target]), models).withColumn(
        "node", F.lit(1).cast("bigint"))
    found = score(prefix_sums(candidate_sums(unroll(rows, layout), layout), layout), layout)
    return {r["vmin"]: r["gain"] for r in found.collect() if r["vmin"] is not None}


def test_membership(spark):
    sets = list(zip((1.0, 5.0, 9.0), widths((1.0, 5.0, 9.0))))
    row = spark.range(1).selectExpr(f"array({', '.join(memberships('4D', sets))}) AS m").first()
    assert row["m"] == [0.25, 0.75, 0.0]


def test_widths():
    assert widths((0.0, 20000.0, 50000.0)) == [9999.0] * 3
    assert widths((1.0, 1.0, 4.0)) == [3.0] * 3
    assert widths((7.0,)) == [9999.0]


@pytest.mark.parametrize("target,task,criterion,soft,expected", [
    ("label", "class", "gini", False, (0.166667, 0.5, 0.166667)),
    ("label", "class", "gini", True, (0.136364, 0.5, 0.136364)),
    ("label", "class", "entropy", False, (0.311278, 1.0, 0.311278)),
    ("label", "class", "entropy", True, (0.256981, 1.0, 0.256981)),
    ("y", "value", "variance", False, (0.75, 1.0, 0.75)),
    ("y", "value", "variance", True, (0.72619, 1.0, 0.72619)),
    ("y", "value", "stddev", False, (0.505662, 0.618034, 0.505662)),
    ("y", "value", "stddev", True, (0.476501, 0.618034, 0.476501)),
])
def test_split_gains(four, target, task, criterion, soft, expected):
    got = candidates(four, target, task, criterion, SETS if soft else None)
    assert got[1.0] is None  # no row on the other side
    assert [round(got[v], 6) for v in (2.0, 3.0, 4.0)] == list(expected)


def test_boosting_tie_takes_lowest_value(four):
    tree = TreeSpec(("x",), ("y",), "value", rules=StopRules(max_depth=0))
    model = fit_boosted(four, BoostSpec(tree, n_estimators=2, learning_rate=0.1))
    assert model.trees[1][1].num == 2.0
    got = [round(r["prediction"], 6) for r in model.transform(four).orderBy("id").collect()]
    assert got == [1.45, 1.516667, 3.516667, 3.516667]


def test_early_stopping_and_checkpoints(four):
    tree = TreeSpec(("x",), ("y",), "value", rules=StopRules(max_depth=0))
    df = four
    for _ in range(4):
        df = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    df = df.withColumn("id", F.monotonically_increasing_id())
    spec = BoostSpec(tree, n_estimators=8, learning_rate=0.5, n_iter_no_change=3, validation_fraction=0.3, key=("id",),
                     checkpoint_every=3)
    model = fit_boosted(df, spec)
    assert 1 < len(model.trees) <= 8
    curve = [r["loss"] for r in model.loss_curve(df).orderBy("round").collect()]
    assert curve[-1] < curve[0]


def test_leaf_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2), ("b", 2), ("b", 5)], "g string, y int")
    assert {r["g"]: r["label"] for r in majority_label(df, ["g"], "y").collect()} == {"a": 0, "b": 2}
    shares = {r["g"]: (r["leaf_labels"], [round(p, 6) for p in r["leaf_proba"]])
              for r in label_shares(df, ["g"], "y").collect()}
    assert shares["b"] == ([2, 5], [0.666667, 0.333333])
    vote = spark.range(1).select(encode.majority_of([F.lit(2), F.lit(0), F.lit(2), F.lit(0)]).alias("v")).first()
    assert vote["v"] == 0


def test_multiway(spark):
    df = spark.createDataFrame([("r", 0), ("r", 0), ("g", 1), ("b", 0)], "colour string, y int")
    row = feature_scores(discrete_counts(df, [], ["colour"], "y"), []).first()
    assert [round(row[c], 6) for c in ("gain", "split_info", "gain_ratio")] == [0.811278, 1.5, 0.540852]
    gain = binary_gain(df.withColumn("g", F.lit(1)), ["g"], "y", F.col("colour") == "r", "gini").first()["gain"]
    assert round(gain, 6) == 0.125


def test_one_hot(spark):
    df = spark.createDataFrame([(1,), (2,)], "y int").select("y", encode.one_hot(F.col("y"), 3).alias("v"))
    rows = df.select("y", "v", encode.argmax_decode(F.col("v")).alias("back")).orderBy("y").collect()
    assert [(r["v"], r["back"]) for r in rows] == [([0.0, 1.0, 0.0], 1), ([0.0, 0.0, 1.0], 2)]


def test_describe(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    r = describe(df, ["g"], "v").first()
    assert (r["count"], r["mean"], round(r["std"], 6), r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (
        4, 2.5, 1.290994, 1.0, 1.75, 2.5, 3.25, 4.0)


def test_missing_values_fail_the_test(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (None, 0), (float("nan"), 0)], "x double, label int")
    model = fit_tree(df, TreeSpec(("x",), ("label",)))
    assert model.tree[1].num == 3.0
    got = [r["prediction"] for r in model.transform(df).collect()]
    assert got == [0, 0, 1, 1, 0, 0]
    assert sum(model.tree[1].stats) == 6


def test_zero_membership(four):
    nowhere = {"x": ((1000.0, 1.0),)}
    assert candidates(four, "label", "class", "gini", nowhere) == candidates(four, "label", "class", "gini")
    low_only = {"x": ((1.0, 0.5),)}  # only x = 1 has any membership
    assert set(candidates(four, "label", "class", "gini", low_only).values()) == {None}
    assert candidates(four, "y", "value", "variance", low_only)[3.0] is not None


def test_one_class_and_constant_target(spark):
    df = spark.createDataFrame([(1.0, "a", 5.0), (2.0, "a", 5.0)], "x double, label string, y double")
    assert len(fit_tree(df, TreeSpec(("x",), ("label",))).tree) == 1
    model = fit_tree(df, TreeSpec(("x",), ("y",), "value"))
    assert [r["prediction"] for r in model.transform(df).collect()] == [5.0, 5.0]
    same = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, label int")  # no candidate at all
    model = fit_tree(same, TreeSpec(("x",), ("label",)))
    assert [r["prediction"] for r in model.transform(same).collect()] == [0, 0]


def random_rows(spark, n=400, seed=3, classes=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = round(rng.gauss(0, 2), 2), float(rng.randint(0, 9)), rng.choice("uvw")
        y = (a > 0.5) + (b > 5) + (c == "u")
        rows.append((i, a, b, c, min(y, classes - 1) if rng.random() > 0.1 else rng.randrange(classes),
                     a * 2 + b + rng.random()))
    return spark.createDataFrame(rows, "id int, a double, b double, c string, label int, y double"), rows


def gini(labels):
    n = len(labels)
    return 1 - sum((labels.count(v) / n) ** 2 for v in set(labels))


def brute_best(rows, impurity, target, tests):
    best = (0.0, None)
    whole = [r[target] for r in rows]
    for f, kind in tests:
        for v in sorted({r[f] for r in rows}):
            hit = [r[target] for r in rows if (r[f] >= v if kind == ">=" else r[f] == v)]
            rest = [r[target] for r in rows if not (r[f] >= v if kind == ">=" else r[f] == v)]
            if hit and rest:
                g = impurity(whole) - len(hit) / len(rows) * impurity(hit) - len(rest) / len(rows) * impurity(rest)
                if round(g, 12) > round(best[0], 12):
                    best = (g, (f, v))
    return best


def var(values):
    m = sum(values) / len(values)
    return sum((v - m) ** 2 for v in values) / len(values)


def check_tree(model, rows, impurity, target, tests, depth, node=1):
    """Every split of a fitted tree is the one found by trying all candidates."""
    at = model.tree[node]
    gain, split = brute_best(rows, impurity, target, tests) if at.depth <= depth else (0.0, None)
    if gain <= 1e-7:
        assert at.is_leaf
        return
    names = {1: "a", 2: "b", 3: "c"}
    assert model.spec.features[at.fi] == names[split[0]]
    assert (at.cat if at.cat is not None else at.num) == split[1]
    assert math.isclose(at.gain, gain, rel_tol=1e-9, abs_tol=1e-12)
    ok = [r for r in rows if (r[split[0]] == split[1] if at.cat is not None else r[split[0]] >= split[1])]
    ids = {r[0] for r in ok}
    check_tree(model, ok, impurity, target, tests, depth, 2 * node)
    check_tree(model, [r for r in rows if r[0] not in ids], impurity, target, tests, depth, 2 * node + 1)


def test_tree_against_all_candidates(spark):
    df, rows = random_rows(spark)
    tests = [(1, ">="), (2, ">="), (3, "==")]
    spec = TreeSpec(("a", "b", "c"), ("label",), categorical=("c",), rules=StopRules(max_depth=2))
    check_tree(fit_tree(df, spec), rows, gini, 4, tests, 2)
    spec = TreeSpec(("a", "b", "c"), ("y",), "value", categorical=("c",), rules=StopRules(max_depth=2))
    check_tree(fit_tree(df, spec), rows, var, 5, tests, 2)


@pytest.mark.parametrize("task,criterion,soft", [
    ("class", "gini", False), ("class", "entropy", True), ("value", "variance", False), ("value", "variance", True),
    ("value", "stddev", False), ("value", "stddev", True)])
def test_bucketed_search_is_exact(spark, task, criterion, soft):
    df, _ = random_rows(spark, 3000, seed=11)
    sets = {"a": tuple(zip((-2.0, 0.0, 2.0), widths((-2.0, 0.0, 2.0))))} if soft else None
    base = dict(features=("a", "b"), targets=("label" if task == "class" else "y",), task=task, criterion=criterion,
                fuzzy_sets=sets, rules=StopRules(max_depth=1))
    plain = fit_tree(df, TreeSpec(**base)).tree
    bucketed = fit_tree(df, TreeSpec(**base, direct_limit=50)).tree
    assert set(plain) == set(bucketed)
    for i, n in plain.items():
        assert (n.fi, n.num) == (bucketed[i].fi, bucketed[i].num)
        assert n.gain is None or math.isclose(n.gain, bucketed[i].gain, rel_tol=1e-9)


@pytest.mark.parametrize("criterion,soft", [("gini", False), ("gini", True), ("entropy", False), ("entropy", True)])
def test_many_classes_search_equals_wide_search(spark, monkeypatch, criterion, soft):
    from softgrove.operators import manyclass

    df, _ = random_rows(spark, 500, seed=5, classes=3)
    df = df.withColumn("label", (F.col("label") * 3 + F.col("b") % 3).cast("int"))
    sets = {"a": tuple(zip((-2.0, 0.0, 2.0), widths((-2.0, 0.0, 2.0))))} if soft else None
    spec = TreeSpec(("a", "b"), ("label",), criterion=criterion, fuzzy_sets=sets, rules=StopRules(max_depth=2))
    many = fit_tree(df, spec)
    monkeypatch.setattr(manyclass, "WIDE_CLASSES", 100)
    wide = fit_tree(df, spec)
    assert set(many.tree) == set(wide.tree)
    for i, n in wide.tree.items():
        assert (n.fi, n.num) == (many.tree[i].fi, many.tree[i].num)
        assert list(n.stats) == list(many.tree[i].stats)


def test_equal_memberships_equal_crisp(spark):
    df, _ = random_rows(spark)
    flat = {"a": ((0.0, 1e12),), "b": ((0.0, 1e12),)}
    soft = fit_tree(df, TreeSpec(("a", "b"), ("label",), fuzzy_sets=flat, rules=StopRules(max_depth=2))).tree
    crisp = fit_tree(df, TreeSpec(("a", "b"), ("label",), rules=StopRules(max_depth=2))).tree
    assert {i: (n.fi, n.num) for i, n in soft.items()} == {i: (n.fi, n.num) for i, n in crisp.items()}


def test_single_tree_forest_equals_tree(spark):
    df, _ = random_rows(spark)
    spec = TreeSpec(("a", "b"), ("label",), rules=StopRules(max_depth=2))
    forest = fit_bagged(df, ForestSpec(spec, ("id",), 1, max_features=64, bootstrap="none"))
    assert {i: (n.fi, n.num) for i, n in forest.trees[0].items()} == {
        i: (n.fi, n.num) for i, n in fit_tree(df, spec).tree.items()}


def test_big_models_score_like_small_ones(spark, monkeypatch):
    from softgrove.plans import route, score as scoring

    df, _ = random_rows(spark)
    df = df.withColumn("a", F.when(F.col("id") % 17 == 0, None).otherwise(F.col("a")))
    spec = TreeSpec(("a", "b", "c"), ("label",), categorical=("c",), rules=StopRules(max_depth=3))
    forest = fit_bagged(df, ForestSpec(spec, ("id",), 4, max_features=9, seed=2))
    small = [r["prediction"] for r in forest.transform(df).orderBy("id").collect()]
    monkeypatch.setattr(scoring, "INLINE_NODES", 0)
    monkeypatch.setattr(route, "INLINE_NODES", 0)
    big = [r["prediction"] for r in forest.transform(df).orderBy("id").collect()]
    assert small == big
    again = fit_bagged(df, ForestSpec(spec, ("id",), 4, max_features=9, seed=2))
    assert [{i: (n.fi, n.num, n.cat) for i, n in t.items()} for t in again.trees] == [
        {i: (n.fi, n.num, n.cat) for i, n in t.items()} for t in forest.trees]
    single = fit_tree(df, spec)
    leaf = {r["leaf"]: r["n"] for r in df.withColumn("leaf", single.leaf_id()).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert leaf == {i: sum(n.stats) for i, n in single.tree.items() if n.is_leaf}


def test_full_depth_fits_training_rows(spark):
    df, rows = random_rows(spark, 150)
    clean = df.dropDuplicates(["a", "b", "c"])
    model = fit_tree(clean, TreeSpec(("a", "b", "c"), ("label",), categorical=("c",), rules=StopRules(min_gain=-1.0)))
    wrong = model.transform(clean).filter("prediction <> label").count()
    leaves = [n for n in model.tree.values() if n.is_leaf]
    assert sum(sum(n.stats) for n in leaves) == clean.count()
    assert wrong <= sum(sum(n.stats) - max(n.stats) for n in leaves)


def test_own_criterion_and_gain(four):
    register_class_criterion("miss", lambda masses, n: f"(1D - greatest({', '.join(masses)}) / {n})")
    assert candidates(four, "label", "class", "miss")[3.0] == 0.5

    def halved(node, hit, rest, criterion):
        return f"({crisp_gain(node, hit, rest, criterion)} / 2)"

    spec = TreeSpec(("x",), ("label",), gain=GainSpec("gini", gain=halved), rules=StopRules(max_depth=0))
    assert fit_tree(four, spec).tree[1].gain == 0.25


def test_save_and_load(four, spark, tmp_path):
    model = fit_tree(four, TreeSpec(("x",), ("label",), fuzzy_sets=SETS))
    model.save(spark, str(tmp_path / "m"))
    back = TreeModel.load(spark, str(tmp_path / "m"))
    assert [r["prediction"] for r in back.transform(four).collect()] == [r["prediction"] for r in model.transform(four).collect()]
    assert back.spec.fuzzy_sets["x"] == [tuple(s) for s in SETS["x"]]


def test_kmeans_paths_agree(spark):
    df, _ = random_rows(spark)
    start = {"a": [-3.0, 0.0, 3.0], "b": [1.0, 4.0, 8.0]}
    scanned = start
    for _ in range(4):
        scanned = lloyd_step(df, scanned)
    counted = lloyd_on_counts(df, start, {"a": 1.0, "b": 1.0}, 4, -1.0)
    for f in start:
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(scanned[f], counted[f]))
    sets = FuzzySets.fit(df, ["a", "b"], 3)
    back = FuzzySets.from_table(sets.table(spark))
    assert back.sets == sets.sets
    bad = sets.transform(df).filter("exists(dm_a, v -> v < 0 OR v > 1)").count()
    assert bad == 0
