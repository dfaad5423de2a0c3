"""Readers on files written from the test tables, stored runs, and registered criteria, losses and leaf rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from softgrove.catalog.common import ORDERS_SQL, r, read
from softgrove.catalog.ensembles import STUMP, TWO, _boost_query, boost_sql
from softgrove.catalog.sqlgen import TreeSql
from softgrove.catalog.trees import _AMOUNT, FEATURES, _priced, _with, orders_base
from softgrove.functions.criteria import plus, register_class_criterion
from softgrove.functions.losses import Loss, register_loss
from softgrove.plans.boost import BoostSpec, fit_boosted
from softgrove.plans.leaves import register_leaf_rule, with_leaf_rule
from softgrove.plans.tree import TreeSpec, fit_tree
from softgrove.session import scratch_path
from softgrove.sources import readers, registry, results

PARTS = "p_partkey BIGINT, p_size DOUBLE, p_retailprice DOUBLE, p_brand STRING"


def _parts(spark, sf):
    return read(spark, sf, "part", "p_partkey", "p_size", "p_retailprice", "p_brand").withColumns(
        {"p_size": F.col("p_size").cast("double"), "p_retailprice": F.round("p_retailprice", 2)})


def src_csv_plain(spark, sf):
    """Headerless files, the target moved last."""
    path = scratch_path(spark, "csv")
    _parts(spark, sf).repartition(3).write.csv(path)
    df = readers.read_csv_plain(spark, path, PARTS, target="p_size")
    assert readers.split_target(df)[1] == "p_size"
    return df.groupBy("p_size").agg(F.count("p_brand").alias("n"), r(F.sum("p_retailprice"), 2).alias("price"))


def src_csv_header(spark, sf):
    """Files with a header; rows with missing values are dropped."""
    path = scratch_path(spark, "csv")
    sized = F.when(F.col("p_size") > 10, F.col("p_size"))
    _parts(spark, sf).withColumn("p_size", sized).repartition(3).write.option("header", True).csv(path)
    return readers.read_csv_header(spark, path, PARTS).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


def src_blank_separated(spark, sf):
    """Two folders of lines with any number of blanks, the labels recoded."""
    paths = [scratch_path(spark, "text") for _ in range(2)]
    line = F.concat_ws("  ", F.lit(""), F.col("p_partkey").cast("string"), F.col("p_size").cast("int").cast("string"), "p_brand", F.lit(""))
    lines = _parts(spark, sf).select("p_partkey", F.regexp_replace(line, "#", "").alias("value"))
    for k, path in enumerate(paths):
        lines.filter(F.col("p_partkey") % 2 == k).select("value").write.text(path)
    brands = {f"Brand{k}": k for k in range(100)}
    df = readers.read_blank_separated(spark, paths, ["key", "size", "brand"], brands)
    return df.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"), F.sum("size").alias("sizes"))


def src_arff(spark, sf):
    """Attribute lines in one file, rows in others."""
    path = scratch_path(spark, "arff")
    head = ["% parts", "@relation parts", "@ATTRIBUTE key numeric", "@attribute 'the size' real", "@attribute price REAL",
            "@attribute brand {x, y}", "@data"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(path)
    line = F.concat_ws(", ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"),
                       F.col("p_retailprice").cast("string"), F.concat(F.lit("'"), "p_brand", F.lit("'")))
    _parts(spark, sf).select(line.alias("value")).repartition(3).write.mode("append").text(path)
    df = readers.features_as_double(readers.read_arff(spark, path))
    return df.groupBy("brand").agg(F.count("the size").alias("n"), r(F.sum("price"), 2).alias("price"), F.sum("key").alias("keys"))


def src_categorical_csv(spark, sf):
    """Every column coded by first appearance in the files, target last."""
    path = scratch_path(spark, "csv")
    table = read(spark, sf, "part", "p_partkey", "p_brand", "p_type").orderBy("p_partkey").coalesce(1)
    table.sortWithinPartitions("p_partkey").select("p_brand", "p_type").write.csv(path)
    df = readers.read_categorical_csv(spark, path, ["brand", "container"], "brand")
    assert df.columns == ["container", "brand"]
    return df.groupBy("brand", "container").agg(F.count(F.lit(1)).alias("n"))


def src_registered(spark, sf):
    """A source by its registered name, and a table of the session's catalog by its own."""
    registry.register_source("parts", lambda s: _parts(s, sf))
    read(spark, sf, "supplier", "s_suppkey", "s_nationkey").createOrReplaceTempView("some_suppliers")
    one, two = registry.load_source(spark, "parts"), registry.load_source(spark, "some_suppliers")
    assert registry.load_source(spark, "no_such_source") is None and "parts" in registry.source_names()
    return one.groupBy(F.lit("parts").alias("source")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        two.groupBy(F.lit("suppliers").alias("source")).agg(F.count(F.lit(1)).alias("n")))


def results_runs(spark, sf):
    """Two runs of results in Parquet and in CSV; the latest run, and the first by its name."""
    rows = read(spark, sf, "part", "p_partkey", "p_size").withColumn("p_size", F.col("p_size").cast("double"))
    out = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, "runs")
        first = results.write_results(rows.filter("p_size <= 20"), path, fmt, "007")
        results.write_results(rows.filter("p_size > 5"), path, fmt)
        for name, run in (("latest", None), ("first", first)):
            found = results.read_results(spark, path, fmt, run, "p_partkey BIGINT, p_size DOUBLE" if fmt == "csv" else None)
            out.append(found.agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys")).select(
                F.lit(fmt).alias("fmt"), F.lit(name).alias("run"), "n", "keys"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def tree_custom_criterion(spark, sf):
    """A criterion of one's own: squared distance of the class shares from one another's mean, halved."""
    register_class_criterion("half_gini", lambda masses, whole: (
        f"(1D - {plus([f'({m} / {whole}) * ({m} / {whole})' for m in masses])}) / 2D"))
    df = _priced(spark, sf)
    model = fit_tree(df, TreeSpec(FEATURES, ("tier",), criterion="half_gini", rules=TWO))
    return model.nodes(spark).select("node_id", "is_leaf", "feature", "split_num", r(F.col("gain") * 2).alias("gain"),
                                     F.col("n").cast("bigint").alias("n"))


def gbdt_custom_loss(spark, sf):
    """A loss of one's own: twice the squared error, so half the learning rate gives the same steps."""
    register_loss("twice_squared", Loss(lambda ys, fs: [F.lit(2.0) * (f - y) for y, f in zip(ys, fs)]))
    df = _priced(spark, sf)
    tree = TreeSpec(FEATURES, ("amount",), "value", criterion="variance", rules=STUMP)
    model = fit_boosted(df, BoostSpec(tree, n_estimators=3, loss="twice_squared", learning_rate=0.05))
    return model.transform(df).select("o_orderkey", r("prediction").alias("prediction"))


def gbdt_early_stop(spark, sf):
    """Held-out losses until two rounds in a row bring no smaller one."""
    tree = TreeSpec(FEATURES, ("tier",), "class", criterion="variance", rules=STUMP)
    spec = BoostSpec(tree, n_estimators=8, n_classes=3, n_iter_no_change=2, key=("o_orderkey",), seed=3)
    model = fit_boosted(_priced(spark, sf), spec)
    rows = [(i, len(model.trees), e) for i, e in model.validation]
    return spark.createDataFrame(rows, "round int, n_trees int, loss double").select("round", "n_trees", r("loss").alias("loss"))


def tree_custom_leaf(spark, sf):
    """Leaves that predict the median, and a registered rule of one's own: the middle of the range."""
    register_leaf_rule("midrange", lambda rows: rows.groupBy("leaf").agg(((F.min("y") + F.max("y")) / 2).alias("value")))
    df = _priced(spark, sf)
    model = fit_tree(df, TreeSpec(FEATURES, ("amount",), "value", rules=TWO))
    out = with_leaf_rule(model, df, "median").transform(df, "median")
    return with_leaf_rule(model, df, "midrange").transform(out, "middle").select(
        "o_orderkey", r("median").alias("median"), r("middle").alias("middle"))


QUERIES = {f.__name__: f for f in (
    src_csv_plain, src_csv_header, src_blank_separated, src_arff, src_categorical_csv, src_registered, results_runs,
    tree_custom_criterion, gbdt_custom_loss, gbdt_early_stop, tree_custom_leaf)}


# ---- SQL ----

def _criterion_sql() -> str:
    tree = TreeSql(2)
    tree.level().level().leaves()
    n = " + ".join(f"a_c{k}" for k in range(tree.k))
    names = "CASE fi WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'o_month' END"
    inner = [f"SELECT node AS node_id, FALSE AS is_leaf, {names} AS feature, v AS split_num, round(gain, 6) AS gain, "
             f"CAST({n} AS BIGINT) AS n FROM t_best{L}" for L in range(2)]
    return _with(tree, " UNION ALL ".join([*inner, "SELECT node, TRUE, NULL, NULL, NULL, CAST(n AS BIGINT) FROM t_leaf"]))


def _leaf_sql() -> str:
    tree = TreeSql(2, "value", 1)
    tree.level().level()
    base = orders_base(_AMOUNT, False, "TRUE", True)
    return (f"WITH {ORDERS_SQL}, base AS ({base}), {tree.text()}, l AS (SELECT node, quantile_cont(t0, 0.5) AS median, "
            f"(min(t0) + max(t0)) / 2 AS middle FROM t_rows2 GROUP BY node) SELECT rid AS o_orderkey, round(median, 6) AS median, "
            f"round(middle, 6) AS middle FROM t_rows2 JOIN l USING (node)")


def _early_stop_sql(rounds: int = 4) -> str:
    """Losses of the held-out rows after each of some rounds, cut where two in a row bring no smaller one."""
    ys = ", ".join(f"CASE WHEN tier = {k} THEN 1.0::DOUBLE ELSE 0 END AS y{k}" for k in range(3))
    text, _ = boost_sql("state", 3, rounds, 1, "{y} - {s}")
    part = "0.5 * (" + " + ".join(f"(y{k} - s{k}) * (y{k} - s{k})" for k in range(3)) + ")"
    losses = " UNION ALL ".join(f"SELECT {i} AS round, avg({part}) AS loss FROM st{i + 1} WHERE w = 0" for i in range(rounds))
    return f"""
WITH {ORDERS_SQL},
q AS (SELECT *, floor(ideal) + CASE WHEN row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, tier) <=
        ceil(0.1 * size) - sum(floor(ideal)) OVER () THEN 1 ELSE 0 END AS take
      FROM (SELECT tier, sum(count(*)) OVER () AS size, ceil(0.1 * sum(count(*)) OVER ()) * count(*) / sum(count(*)) OVER () AS ideal
            FROM orders_t GROUP BY tier)),
h AS (SELECT o.*, row_number() OVER (PARTITION BY o.tier ORDER BY md5(concat_ws('-', o_orderkey, 'validation', '3'))) <= take AS held
      FROM orders_t o JOIN q USING (tier)),
state AS (SELECT 0 AS model, o_orderkey AS rid, CASE WHEN held THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS w, {ys},
                 o_totalprice AS f0, o_month AS f1 FROM h),
{text}, l AS ({losses}),
m AS (SELECT *, min(loss) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM l),
b AS (SELECT *, coalesce(loss >= least - 1e-12, FALSE) AS worse FROM m),
e AS (SELECT min(b.round) AS last FROM b JOIN b c ON c.round = b.round - 1 WHERE b.worse AND c.worse)
SELECT round, CAST(last + 1 AS INTEGER) AS n_trees, round(loss, 6) AS loss FROM l, e WHERE round <= last"""


_RUNS = " UNION ALL ".join(
    f"SELECT '{fmt}' AS fmt, '{run}' AS run, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part WHERE {where}"
    for fmt in ("parquet", "csv") for run, where in (("latest", "p_size > 5"), ("first", "p_size <= 20")))

ORACLES = {
    "src_csv_plain": "SELECT CAST(p_size AS DOUBLE) AS p_size, count(*) AS n, round(sum(round(p_retailprice, 2)), 2) AS price "
                     "FROM part GROUP BY 1",
    "src_csv_header": "SELECT CAST(p_size AS DOUBLE) AS p_size, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1",
    "src_blank_separated": "SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS "
                           "keys, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY 1",
    "src_arff": "SELECT p_brand AS brand, count(*) AS n, round(sum(round(p_retailprice, 2)), 2) AS price, "
                "CAST(sum(p_partkey) AS DOUBLE) AS keys FROM part GROUP BY 1",
    "src_categorical_csv": """
        WITH b AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS brand FROM part GROUP BY 1),
        c AS (SELECT p_type, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS container FROM part GROUP BY 1)
        SELECT brand, container, count(*) AS n FROM part JOIN b USING (p_brand) JOIN c USING (p_type) GROUP BY 1, 2""",
    "src_registered": "SELECT 'parts' AS source, count(*) AS n FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier",
    "results_runs": _RUNS,
    "tree_custom_criterion": _criterion_sql(),
    "gbdt_custom_loss": _boost_query("value", 3, 1, "SELECT rid AS o_orderkey, round(s0, 6) AS prediction FROM LAST"),
    "tree_custom_leaf": _leaf_sql(),
    "gbdt_early_stop": _early_stop_sql(),
}
