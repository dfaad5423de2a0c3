"""Samples, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from softgrove.catalog.common import r, read
from softgrove.operators import sampling as S

TREES, FEATURES = 100, 64


def sample_wor(spark, sf):
    return S.sample_without_replacement(read(spark, sf, "customer", "c_custkey"), ["c_custkey"], 3, 100, seed=7)


def bootstrap_wr(spark, sf):
    return S.bootstrap_weights(read(spark, sf, "customer", "c_custkey"), ["c_custkey"], 3, seed=7)


def bootstrap_poisson(spark, sf):
    df = S.bootstrap_array(read(spark, sf, "customer", "c_custkey"), ["c_custkey"], 3, seed=7, method="poisson")
    return df.select("c_custkey", F.inline("mw")).filter("w > 0")


def kfold_assign(spark, sf):
    return S.kfold(read(spark, sf, "customer", "c_custkey"), ["c_custkey"], 7, 2, seed=7)


def kfold_hash(spark, sf):
    return S.kfold(read(spark, sf, "orders", "o_orderkey"), ["o_orderkey"], 5, 2, seed=7, exact=False)


def holdout_split(spark, sf):
    return S.holdout(read(spark, sf, "orders", "o_orderkey"), ["o_orderkey"], 0.4, seed=22)


def stratified_sample(spark, sf):
    return S.stratified_sample(read(spark, sf, "orders", "o_orderkey", "o_orderpriority"), ["o_orderkey"],
                               "o_orderpriority", 1000, seed=7)


def stratified_sample_nulls(spark, sf):
    """A class without a name counts like the others."""
    df = read(spark, sf, "customer", "c_custkey", "c_mktsegment").withColumn(
        "c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return S.stratified_sample(df, ["c_custkey"], "c_mktsegment", 100, seed=7)


def feature_subspace(spark, sf):
    """Mean of every feature a tree may use, over the whole table: one long table, semi-joined with the draws."""
    picks = S.feature_subspace(TREES, FEATURES, seed=3)
    draws = spark.createDataFrame([(t, f) for t, fs in enumerate(picks) for f in fs], "tree_id int, fi int")
    long = read(spark, sf, "embeddings", "embedding").select(F.posexplode("embedding").alias("fi", "v"))
    means = long.groupBy("fi").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.join(F.broadcast(draws), "fi").select("tree_id", "fi", "n", r("m").alias("mean"))


QUERIES = {f.__name__: f for f in (sample_wor, bootstrap_wr, bootstrap_poisson, kfold_assign, kfold_hash, holdout_split,
                                   stratified_sample, stratified_sample_nulls, feature_subspace)}


def _hash(key: str, salt: str, seed: int) -> str:
    return f"md5(concat_ws('-', {key}, {salt}, '{seed}'))"


def sql_bits(hashed: str) -> str:
    return f"CAST('0x' || substr({hashed}, 1, 15) AS BIGINT)"


def _poisson_sql() -> str:
    import math

    total, parts = 0.0, []
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        parts.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
    return " + ".join(parts)


def sql_bootstrap(source: str, key: str, n_subsets: int, seed: int) -> str:
    """Table ``wts`` (rid, model, w): Poisson draws with a surplus, the copies with the smallest hashes taken out."""
    return f"""
size AS (SELECT count(*) AS n, (count(*) + 6 * sqrt(count(*)) + 12) / count(*) AS mean FROM {source}),
upto AS (SELECT sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (ORDER BY k) AS p FROM size, range(40) t(k)),
units AS (SELECT {key} AS rid, s, {sql_bits(_hash(key, "'0.' || s", seed))} / {float(16**15)!r} AS u FROM {source}, range({n_subsets}) t(s)),
counts AS (SELECT rid, s, (SELECT count(*) FROM upto WHERE p < 1 AND p <= u) AS c FROM units),
copies AS (SELECT rid, s, row_number() OVER (PARTITION BY s ORDER BY {_hash('rid', "'0.' || s || '.' || j", seed)} DESC) AS place
           FROM (SELECT rid, s, unnest(range(1, c + 1)) AS j FROM counts)),
wts AS (SELECT rid, CAST(s AS INTEGER) AS model, count(*) AS w FROM copies WHERE place <= (SELECT n FROM size) GROUP BY 1, 2)"""


ORACLES = {
    "sample_wor": f"SELECT c_custkey, subset FROM (SELECT c_custkey, CAST(s AS INTEGER) AS subset, row_number() OVER "
                  f"(PARTITION BY s ORDER BY {_hash('c_custkey', 's', 7)}) AS k FROM customer, range(3) t(s)) WHERE k <= 100",
    "bootstrap_wr": f"WITH {sql_bootstrap('customer', 'c_custkey', 3, 7)} SELECT rid AS c_custkey, model AS subset, w FROM wts",
    "bootstrap_poisson": f"SELECT c_custkey, CAST(s AS INTEGER) AS model, CAST({_poisson_sql()} AS BIGINT) AS w FROM (SELECT "
                         f"c_custkey, s, {sql_bits(_hash('c_custkey', 's', 7))} / {float(16**15)!r} AS u FROM customer, "
                         f"range(3) t(s)) WHERE {_poisson_sql()} > 0",
    "kfold_assign": f"SELECT c_custkey, CAST(s AS INTEGER) AS repeat, CAST(ntile(7) OVER (PARTITION BY s ORDER BY "
                    f"{_hash('c_custkey', 's', 7)}) - 1 AS INTEGER) AS fold FROM customer, range(2) t(s)",
    "kfold_hash": f"SELECT o_orderkey, CAST(s AS INTEGER) AS repeat, CAST({sql_bits(_hash('o_orderkey', 's', 7))} % 5 AS "
                  f"INTEGER) AS fold FROM orders, range(2) t(s)",
    "holdout_split": f"SELECT o_orderkey, row_number() OVER (ORDER BY {_hash('o_orderkey', chr(39) + 'holdout' + chr(39), 22)}) "
                     f"<= ceil(0.4 * (SELECT count(*) FROM orders)) AS is_test FROM orders",
    "stratified_sample": f"""
WITH c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS size FROM orders GROUP BY 1),
q AS (SELECT *, floor(1000.0::DOUBLE * n / size) AS base, round(1000.0::DOUBLE * n / size - floor(1000.0::DOUBLE * n / size), 9) AS frac FROM c),
k AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, o_orderpriority) <= 1000 - sum(base) OVER ()
      THEN 1 ELSE 0 END AS take FROM q)
SELECT o_orderkey, o_orderpriority FROM (SELECT o.*, take, size, row_number() OVER (PARTITION BY o_orderpriority ORDER BY
  {_hash('o_orderkey', chr(39) + 'strata' + chr(39), 7)}) AS i FROM orders o JOIN k USING (o_orderpriority))
WHERE i <= take OR size <= 1000""",
    "stratified_sample_nulls": f"""
WITH t AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS y FROM customer),
c AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS size FROM t GROUP BY 1),
q AS (SELECT *, floor(100.0::DOUBLE * n / size) AS base, round(100.0::DOUBLE * n / size - floor(100.0::DOUBLE * n / size), 9) AS frac FROM c),
k AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, y NULLS FIRST) <= 100 - sum(base) OVER ()
      THEN 1 ELSE 0 END AS take FROM q)
SELECT c_custkey, c_mktsegment FROM (SELECT t.c_custkey, t.y AS c_mktsegment, take, size, row_number() OVER (PARTITION BY t.y ORDER BY
  {_hash('c_custkey', chr(39) + 'strata' + chr(39), 7)}) AS i FROM t JOIN k ON t.y IS NOT DISTINCT FROM k.y)
WHERE i <= take OR size <= 100""",
    "feature_subspace": f"""
WITH d AS (SELECT DISTINCT CAST(t AS INTEGER) AS tree_id, CAST({sql_bits("md5(concat_ws('-', t, d, '3'))")} % {FEATURES} AS INTEGER) AS fi
           FROM range({TREES}) a(t), range(8) b(d)),
l AS (SELECT CAST(i AS INTEGER) AS fi, v FROM (SELECT unnest(range({FEATURES})) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))
SELECT tree_id, fi, count(*) AS n, round(avg(v), 6) AS mean FROM d JOIN l USING (fi) GROUP BY 1, 2""",
}
