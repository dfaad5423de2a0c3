"""Trees whose nodes are tables, against the same trees grown on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from softgrove.plans.frontier import TableTree
from softgrove.plans.grow import StopRules
from softgrove.plans.route import HEAP_DEPTH
from softgrove.plans.tree import TreeSpec, fit_table_tree, fit_tree


def rows_of(spark, n=400, classes=3, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.choice([None, *range(12)]), rng.randrange(300), rng.choice(["x", "y", "z", None])
        y = (int((a or 0) > 5) + (b > 140) + (c == "y") + rng.randrange(2)) % classes
        rows.append((a, b, c, y, 3.0 * y + (b % 7)))
    return spark.createDataFrame(rows, "a int, b int, c string, y int, v double")


def node_view(model, spark):
    if isinstance(model, TableTree):
        found = model.nodes()
    else:
        found = model.nodes(spark)
    return sorted((r["path"], r["depth"], r["is_leaf"], r["feature"], r["split_num"], r["split_cat"],
                   None if r["gain"] is None else round(r["gain"], 9), r["n"]) for r in found.collect())


SPECS = {
    "classes": TreeSpec(("a", "b", "c"), ("y",), categorical=("c",), rules=StopRules(max_depth=4)),
    "soft": TreeSpec(("a", "b"), ("y",), fuzzy_sets={"a": [(2.0, 5.0), (9.0, 5.0)], "b": [(80.0, 150.0), (220.0, 150.0)]},
                     rules=StopRules(max_depth=3, min_samples_split=20)),
    "values": TreeSpec(("a", "b"), ("v",), "value", rules=StopRules(max_depth=5, min_gain=0.05)),
    "buckets": TreeSpec(("a", "b"), ("y",), rules=StopRules(max_depth=3), direct_limit=40),
}


@pytest.mark.parametrize("kind", sorted(SPECS))
@pytest.mark.parametrize("driver_nodes", [0, 3])
def test_same_nodes_as_on_the_driver(spark, kind, driver_nodes):
    df, spec = rows_of(spark), SPECS[kind]
    big, small = fit_table_tree(df, spec, driver_nodes), fit_tree(df, spec)
    assert node_view(big, spark) == node_view(small, spark)
    numbered = df.withColumn("id", F.monotonically_increasing_id())
    want = {r["id"]: r["prediction"] for r in small.transform(numbered).collect()}
    out = big.transform(numbered)
    assert out.columns == [*numbered.columns, "prediction"]
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_many_classes(spark):
    df = rows_of(spark, classes=9, seed=3)
    spec = TreeSpec(("a", "b", "c"), ("y",), categorical=("c",), rules=StopRules(max_depth=3))
    for nodes in (0, 3):
        assert node_view(fit_table_tree(df, spec, nodes), spark) == node_view(fit_tree(df, spec), spark)


def test_rules_and_saving(spark, tmp_path):
    df, spec = rows_of(spark), SPECS["classes"]
    big = fit_table_tree(df, spec, 0)
    said = {r["leaf_id"]: (r["rule"], str(r["prediction"])) for r in big.rules().collect()}
    want = {r["leaf_id"]: (r["rule"], r["label"]) for r in fit_tree(df, spec).rules(spark).collect()}
    assert said == want
    big.save(str(tmp_path))
    again = TableTree.load(spark, str(tmp_path))
    assert node_view(again, spark) == node_view(big, spark)
    assert again.transform(df).groupBy("prediction").count().collect()


def test_chain_deeper_than_heap_numbers(spark):
    """Each level splits one value off: ids leave the heap numbers, and scoring is cut by tables."""
    n = 70
    df = spark.createDataFrame([(float(k), k % 2) for k in range(n)], "x double, label int").coalesce(1)
    spec = TreeSpec(("x",), ("label",))
    model = fit_table_tree(df, spec, 2 * (HEAP_DEPTH - 3))
    nodes = model.nodes().collect()
    assert max(r["depth"] for r in nodes) > HEAP_DEPTH + 1
    assert len({(r["depth"], r["node_id"]) for r in nodes}) == len(nodes)
    assert node_view(model, spark) == node_view(fit_tree(df, spec), spark)
    scored = model.transform(df).collect()
    assert len(scored) == n and all(r["prediction"] == r["label"] for r in scored)


def test_single_leaf_and_empty(spark):
    one = spark.createDataFrame([(1, 2.0)] * 3, "x int, y double")
    model = fit_table_tree(one, TreeSpec(("x",), ("y",), "value"), 0)
    assert model.table.depth == 0 and [r["prediction"] for r in model.transform(one).collect()] == [2.0] * 3
    assert [r["rule"] for r in model.rules().collect()] == ["TRUE"]
    none = fit_table_tree(one.limit(0), TreeSpec(("x",), ("y",), "value"), 0)
    assert none.nodes().count() == 0 and none.transform(one).filter("prediction IS NULL").count() == 3
