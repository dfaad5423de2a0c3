"""Rules for scale: no caps on labels or depth, NULL keys, hot values, bucketed searches equal plain ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from softgrove.functions.draws import draw_hash
from softgrove.functions.membership import widths
from softgrove.operators import manyclass, ranks
from softgrove.operators.quantiles import describe
from softgrove.operators.sampling import bootstrap_array, kfold, row_key, sample_without_replacement, stratified_sample
from softgrove.plans.boost import BoostSpec, fit_boosted
from softgrove.plans.grow import StopRules
from softgrove.plans.multiway import MultiwaySpec, fit_multiway
from softgrove.plans.reports import with_group_mean
from softgrove.plans.tree import TreeModel, TreeSpec, fit_tree
from softgrove.sources import readers, results


def test_tree_deeper_than_a_bigint(spark, tmp_path):
    n = 70
    df = spark.createDataFrame([(float(k), k % 2) for k in range(n)], "x double, label int").coalesce(1)
    model = fit_tree(df, TreeSpec(("x",), ("label",)))
    assert max(node.depth for node in model.tree.values()) > 62
    scored = df.withColumns({"p": model.prediction(), "leaf": model.leaf_id()}).collect()
    assert all(r["p"] == r["label"] for r in scored)
    leaves = {r["leaf_id"] for r in model.rules(spark).collect()}
    assert {r["leaf"] for r in scored} == leaves and len(leaves) == n
    model.save(spark, str(tmp_path / "m"))
    again = TreeModel.load(spark, str(tmp_path / "m"))
    assert set(again.tree) == set(model.tree)
    assert df.withColumn("leaf", again.leaf_id()).filter("leaf IS NULL").count() == 0


def random_rows(spark, n=600, labels=9):
    rng = random.Random(4)
    rows = [(round(rng.gauss(0, 1), 2) if rng.random() > 0.05 else None, round(rng.gauss(0, 1), 1),
             rng.choice("pqrstu") if rng.random() > 0.1 else None) for _ in range(n)]
    rows = [(a, b, c, (int((a or 0) * 3 + b * 2) + ord(c or "v")) % labels) for a, b, c in rows]
    return spark.createDataFrame(rows, "a double, b double, c string, label int")


@pytest.mark.parametrize("criterion,soft", [("gini", False), ("entropy", False), ("gini", True)])
def test_many_classes_with_buckets_and_texts(spark, monkeypatch, criterion, soft):
    df = random_rows(spark)
    sets = {"a": tuple(zip((-2.0, 0.0, 2.0), widths((-2.0, 0.0, 2.0))))} if soft else None
    trees = []
    for limit, wide in ((10, 4), (100_000, 4), (100_000, 100)):
        monkeypatch.setattr(manyclass, "WIDE_CLASSES", wide)
        spec = TreeSpec(("a", "b", "c"), ("label",), criterion=criterion, categorical=("c",), fuzzy_sets=sets,
                        rules=StopRules(max_depth=2), direct_limit=limit)
        trees.append(fit_tree(df, spec).tree)
    for other in trees[1:]:
        assert set(other) == set(trees[0])
        for i, n in trees[0].items():
            assert (n.fi, n.num, n.cat) == (other[i].fi, other[i].num, other[i].cat)
            assert list(n.stats) == list(other[i].stats)


def test_many_labels(spark):
    df = spark.createDataFrame([(float(k), k % 400, "x") for k in range(1200)], "x double, label int, t string")
    model = fit_multiway(df, MultiwaySpec((), "label", "c45", max_depth=0, numeric=("x",)))
    root = model.nodes.filter("depth = 0").first()
    assert root["feature"] == "x" and root["n"] == 1200
    assert model.transform(df).filter("prediction IS NULL").count() == 0
    tree = fit_tree(df, TreeSpec(("x",), ("label",), rules=StopRules(max_depth=0)))
    assert len(tree.tree) == 3


def test_null_keys_stay(spark):
    rows = [(k, "a" if k % 3 == 0 else None, float(k) if k % 2 else None) for k in range(30)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    assert with_group_mean(df, ["v"], ["g"]).count() == 30
    gone = df.withColumn("v", F.expr("if(g IS NULL, NULL, v)"))
    out = {r["g"]: r for r in describe(gone, ["g"], "v").collect()}
    assert out[None]["count"] == 0 and out[None]["q50"] is None and out["a"]["count"] == 5
    assert stratified_sample(df, ["k"], "g", 100).count() == 30
    assert stratified_sample(df, ["k"], "g", 10).count() == 10
    keyed = df.withColumn("k", F.expr("if(k = 3, NULL, k)"))
    arrays = bootstrap_array(keyed, ["k"], 3, seed=1).select(F.inline("mw")).groupBy("model").agg(F.sum("w").alias("s"))
    assert {r["s"] for r in arrays.collect()} == {30}
    assert kfold(keyed, ["k"], 3, 2).count() == 60


@pytest.mark.parametrize("bucket", [5, 65_536])
def test_describe_with_nan_hot_values_and_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", bucket)
    values = [1.0] * 50 + [float(k) for k in range(60)] + [float("inf"), float("-inf")]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", float("nan")), ("h", 1.0), ("h", 2.0)], "g string, v double")
    out = {r["g"]: r for r in describe(df, ["g"], "v").collect()}
    ordered = sorted(values)

    def quantile(p):
        h = (len(ordered) - 1) * p
        low = math.floor(h)
        return ordered[low] + (ordered[low + 1] - ordered[low]) * (h - low)

    assert [out["g"][c] for c in ("q25", "q50", "q75")] == [quantile(p) for p in (0.25, 0.5, 0.75)]
    assert out["h"]["q50"] == 2.0 and math.isnan(out["h"]["max"])


@pytest.mark.parametrize("bucket", [3, 65_536])
def test_samples_do_not_depend_on_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", bucket)
    df = spark.range(503).withColumnRenamed("id", "k")
    for s, rows in ((s, [r["k"] for r in sample_without_replacement(df, ["k"], 2, 100, seed=3).filter(F.col("subset") == s).collect()])
                    for s in (0, 1)):
        hashed = df.select("k", draw_hash(["k"], F.lit(s), 3).alias("h")).orderBy("h").limit(100).collect()
        assert sorted(rows) == sorted(r["k"] for r in hashed)
    sizes = kfold(df, ["k"], 5, 2, seed=1).groupBy("repeat", "fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [100] * 4 + [101] * 6


def test_keys_of_several_columns_differ(spark):
    df = spark.createDataFrame([("1-2", "3"), ("1", "2-3"), (None, "x"), ("x", None), ("", "x")], "a string, b string")
    assert df.select(draw_hash(["a", "b"], 0, 1).alias("h")).distinct().count() == 5
    assert df.select(row_key(["a", "b"]).alias("h")).distinct().count() == 5


def test_early_stopping_needs_a_key(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        fit_boosted(df, BoostSpec(TreeSpec(("x",), ("y",), "value"), n_estimators=2, n_iter_no_change=1))


def test_boosting_over_a_checkpoint(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(0, 10),) for _ in range(200)]
    df = spark.createDataFrame([(x, math.sin(x) * 5) for x, in rows], "x double, y double")
    tree = TreeSpec(("x",), ("y",), "value", rules=StopRules(max_depth=0))
    cut = fit_boosted(df, BoostSpec(tree, n_estimators=7, checkpoint_every=2))
    plain = fit_boosted(df, BoostSpec(tree, n_estimators=7, checkpoint_every=100))
    curve = [r["loss"] for r in cut.loss_curve(df).orderBy("round").collect()]
    assert len(curve) == 7 and curve == sorted(curve, reverse=True)
    a, b = ([r["prediction"] for r in m.transform(df).collect()] for m in (cut, plain))
    assert a == pytest.approx(b)


def test_run_names_stay_text(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", 1.0)], "mode string, acc double")
    for run in ("007", "7"):
        results.write_results(df, path, run_ts=run)
    assert results.read_results(spark, path, run_ts="007").count() == 1
    assert {r["run_ts"] for r in results.read_results(spark, path, run_ts="7").collect()} == {"7"}


def test_files_in_order(spark, tmp_path):
    for name, lines in (("a.csv", ["x,u"] * 50 + ["y,v"]), ("b.csv", ["z,u"]), ("c.csv", ["w,t"] * 2000)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    out = readers.read_categorical_csv(spark, str(tmp_path / "*.csv"), ["f", "t"], "t")
    assert out.columns == ["f", "t"]
    assert {(r["f"], r["t"]) for r in out.distinct().collect()} == {(0, 0), (1, 1), (2, 0), (3, 2)}


def test_arff_files_share_a_header(spark, tmp_path):
    head = "@relation r\n@attribute x real\n@attribute y {a,b}\n@data\n"
    (tmp_path / "1.arff").write_text(head + "1.5,a\n")
    (tmp_path / "2.arff").write_text(head + "2.5,b\n")
    assert sorted(tuple(r) for r in readers.read_arff(spark, str(tmp_path / "*.arff")).collect()) == [(1.5, "a"), (2.5, "b")]
    (tmp_path / "3.arff").write_text(head.replace("x real", "z real") + "2.5,b\n")
    with pytest.raises(ValueError):
        readers.read_arff(spark, str(tmp_path / "*.arff"))


def test_forest_scored_in_parts(spark, monkeypatch):
    from softgrove.plans import score
    from softgrove.plans.forest import ForestSpec, fit_bagged

    df = random_rows(spark, 300, 4).withColumn("id", F.monotonically_increasing_id())
    spec = TreeSpec(("a", "b", "c"), ("label",), categorical=("c",), rules=StopRules(max_depth=4))
    model = fit_bagged(df, ForestSpec(spec, ("id",), 40, seed=2))
    whole = model.transform(df.select("*", model.votes().alias("v"))).collect()
    monkeypatch.setattr(score, "PART_NODES", max(map(len, model.trees)) + 1)
    parts = model.transform(df.select("*", model.votes().alias("v"))).collect()
    assert sum(map(len, model.trees)) > 3 * score.PART_NODES
    assert {r["id"]: (r["v"], r["prediction"]) for r in whole} == {r["id"]: (r["v"], r["prediction"]) for r in parts}
