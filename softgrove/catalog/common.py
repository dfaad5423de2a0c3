"""Shared inputs of the registered queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.functions.membership import widths

DIGITS = 6


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def r(col: Column | str, digits: int = DIGITS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    # adding zero turns a negative zero into zero
    return F.round(c, digits) + F.lit(0.0)


# Fixed centroids for queries that must not depend on a k-means run.
CENTROIDS = {
    "l_quantity": (5.0, 15.0, 25.0, 35.0, 45.0),
    "l_discount": (0.01, 0.03, 0.05, 0.07, 0.09),
    "l_tax": (0.0, 0.02, 0.04, 0.06, 0.08),
    "o_totalprice": (40000.0, 120000.0, 200000.0, 300000.0, 420000.0),
    "o_month": (2.0, 4.0, 6.0, 8.0, 11.0),
    "p_size": (5.0, 15.0, 25.0, 35.0, 45.0),
}


def set_map(*features: str) -> dict[str, tuple[tuple[float, float], ...]]:
    return {f: tuple(zip(CENTROIDS[f], widths(CENTROIDS[f]))) for f in features}


def sql_widths(feature: str) -> list[str]:
    """Widths written out from the rule: nearest other centroid, zero distance = 9999."""
    c = CENTROIDS[feature]
    return ["least(" + ", ".join(f"CASE WHEN abs({a!r} - {b!r}) = 0 THEN 9999.0 ELSE abs({a!r} - {b!r}) END"
                                 for b in c) + ")" for a in c]


def sql_memberships(x: str, feature: str) -> list[str]:
    return [f"greatest(0.0, 1.0 - abs({x} - {c!r}) / {t})"
            for c, t in zip(CENTROIDS[feature], sql_widths(feature))]


def sql_mass(x: str, feature: str) -> str:
    return "(" + " + ".join(sql_memberships(x, feature)) + ")"


# Orders with a target that depends on price and month.
ORDER_TIER = ("CASE WHEN o_totalprice * (1 + o_month / 24.0D) > 330000 THEN 2 "
              "WHEN o_totalprice * (1 + o_month / 24.0D) > 150000 THEN 1 ELSE 0 END")
ORDERS_SQL = f"""
orders_t AS (
  SELECT o_orderkey, o_totalprice, o_month, o_orderpriority, o_orderstatus, {ORDER_TIER.replace('24.0D', '24.0::DOUBLE')} AS tier
  FROM (SELECT *, CAST(month(o_orderdate) AS DOUBLE) AS o_month FROM orders)
)"""


def orders_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
        .withColumn("o_month", F.month("o_orderdate").cast("double")).drop("o_orderdate")
        .withColumn("tier", F.expr(ORDER_TIER))
    )


# Line items with a target that depends on price and discount.
LINE_TIER = ("CASE WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 2 "
             "WHEN l_extendedprice * (1 - l_discount) > 20000 THEN 1 ELSE 0 END")


def lines_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag").withColumn("tier", F.expr(LINE_TIER))


def sql_entropy(masses: list[str]) -> str:
    n = "(" + " + ".join(masses) + ")"
    return "(" + " + ".join(f"CASE WHEN {m} > 0 THEN -({m} / {n}) * log2({m} / {n}) ELSE 0 END" for m in masses) + ")"


def sql_gini(masses: list[str]) -> str:
    n = "(" + " + ".join(masses) + ")"
    return "(" + " + ".join(f"({m} / nullif({n}, 0)) * (1 - {m} / nullif({n}, 0))" for m in masses) + ")"
