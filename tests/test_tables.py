"""Sources, sinks, sampling invariants, ranks, multiway trees and streams."""

import random

from pyspark.sql import functions as F

from softgrove.operators import ranks
from softgrove.operators.sampling import bootstrap_array, bootstrap_weights, holdout, kfold, stratified_sample
from softgrove.plans.experiments import Config, compare_modes, cross_validate
from softgrove.plans.grow import StopRules
from softgrove.plans.multiway import MultiwaySpec, fit_multiway
from softgrove.plans.tree import TreeSpec, fit_tree
from softgrove.sources import readers, results
from softgrove.sources.registry import load_source, register_source
from softgrove.streaming.score import score_stream


def test_csv_readers(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b,y\n1,2,0\n3,,1\n5,6,1\n")
    df = readers.read_csv_header(spark, str(tmp_path / "h.csv"), "a int, b int, y int")
    assert sorted(map(tuple, df.collect())) == [(1, 2, 0), (5, 6, 1)]
    (tmp_path / "p.csv").write_text("2,1.5,x\n3,2.5,z\n")
    df = readers.read_csv_plain(spark, str(tmp_path / "p.csv"), "y int, a double, b string", "y")
    assert df.columns == ["a", "b", "y"] and df.count() == 2


def test_blank_separated(spark, tmp_path):
    (tmp_path / "one.dat").write_text("1 2 van \n3 4 bus \n")
    (tmp_path / "two.dat").write_text("   5   6   van   \n")
    paths = [str(tmp_path / "one.dat"), str(tmp_path / "two.dat")]
    df = readers.read_blank_separated(spark, paths, ["a", "b", "cls"], {"bus": 0, "van": 1})
    assert sorted(map(tuple, df.collect())) == [(1, 2, 1), (3, 4, 0), (5, 6, 1)]
    assert df.dtypes == [("a", "int"), ("b", "int"), ("cls", "int")]


def test_arff(spark, tmp_path):
    (tmp_path / "t.arff").write_text(
        "% note\n@relation t\n@attribute width real\n@attribute 'a name' numeric\n@attribute class {neg, pos}\n@data\n"
        "1.5,2,neg\n% gap\n2.5,3,pos\n")
    df = readers.read_arff(spark, str(tmp_path / "t.arff"), {"neg": 0, "pos": 1})
    assert df.columns == ["width", "a name", "class"]
    assert sorted(map(tuple, df.collect())) == [(1.5, 2.0, 0), (2.5, 3.0, 1)]


def test_categorical_csv_and_registry(spark, tmp_path):
    (tmp_path / "c.csv").write_text("p,x,k\ne,x,m\np,y,k\n")
    register_source("letters", lambda s: readers.read_categorical_csv(s, str(tmp_path / "c.csv"), ["cls", "f", "g"], "cls"))
    df = load_source(spark, "letters")
    assert df.columns == ["f", "g", "cls"]
    assert sorted(map(tuple, df.collect())) == [(0, 0, 0), (0, 1, 1), (1, 0, 0)]
    assert load_source(spark, "nowhere") is None


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "mode string, acc double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        first = results.write_results(df, path, fmt, "20200101000000")
        results.write_results(df.withColumn("acc", F.col("acc") + 1), path, fmt, "20210101000000")
        back = results.read_results(spark, path, fmt, schema="mode string, acc double")
        assert sorted((r["mode"], r["acc"]) for r in back.collect()) == [("a", 2.0), ("b", 3.0)]
        old = results.read_results(spark, path, fmt, first, schema="mode string, acc double")
        assert sorted((r["mode"], r["acc"]) for r in old.collect()) == [("a", 1.0), ("b", 2.0)]


def test_sampling_invariants(spark):
    df = spark.range(503).withColumnRenamed("id", "k").withColumn("g", (F.col("k") % 3 == 0).cast("int"))
    sums = bootstrap_weights(df, ["k"], 4, seed=1).groupBy("subset").agg(F.sum("w").alias("s")).collect()
    assert [r["s"] for r in sums] == [503] * 4
    arrays = bootstrap_array(df, ["k"], 4, seed=1).select(F.inline("mw")).groupBy("model").agg(F.sum("w").alias("s"))
    assert [r["s"] for r in arrays.collect()] == [503] * 4
    folds = kfold(df, ["k"], 5, 2, seed=1).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(folds) == 10 and {r["n"] for r in folds} == {100, 101}
    assert holdout(df, ["k"], 0.4).filter("is_test").count() == 202
    strata = {r["g"]: r["n"] for r in stratified_sample(df, ["k"], "g", 100).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(strata.values()) == 100 and strata[1] == 33
    assert stratified_sample(df, ["k"], "g", 1000).count() == 503


def test_ranks_in_buckets(spark, monkeypatch):
    rng = random.Random(1)
    values = [(i % 2, v) for i, v in enumerate(rng.sample(range(10000), 700))]
    df = spark.createDataFrame(values, "g int, v int")
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 10)
    got = {(r["g"], r["v"]): r["rank"] for r in ranks.value_rank(df, "v", ["g"]).collect()}
    for g in (0, 1):
        for i, v in enumerate(sorted(v for h, v in values if h == g)):
            assert got[(g, v)] == i + 1


def test_multiway_with_numbers(spark):
    rows = [("r", 1.0, 0), ("r", 2.0, 0), ("g", 1.0, 1), ("g", 8.0, 0), ("b", 9.0, 1), ("b", 3.0, 1)] * 3
    df = spark.createDataFrame(rows, "colour string, x double, label int")
    model = fit_multiway(df, MultiwaySpec(("colour",), "label", "c45", numeric=("x",)))
    assert model.transform(df).filter("prediction <> label").count() == 0
    unseen = spark.createDataFrame([("violet", 1.0)], "colour string, x double")
    assert model.transform(unseen).first()["prediction"] is not None


def test_stream_scores_like_a_table(spark, tmp_path):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "x double, label int")
    model = fit_tree(df, TreeSpec(("x",), ("label",)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in model.transform(df).collect())


def test_cross_validation_and_modes(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, int(a + b > 0)) for i, a, b in rows], "id int, a double, b double, label int")
    spec = TreeSpec(("a", "b"), ("label",), rules=StopRules(max_depth=2))
    out = cross_validate(df, spec, ["id"], [Config()], n_folds=3, n_repeats=2).collect()
    assert len(out) == 6 and sum(r["n_test"] for r in out) == 600
    assert all(r["acc_train"] > 0.7 and r["acc_test"] > 0.6 for r in out)
    modes = compare_modes(df, spec, ["id"], "toy", n_folds=2, n_repeats=1).collect()
    assert len(modes) == 4 * 2 * 2
