"""Result tables of experiments: order, group means, summaries, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.operators.joins import null_safe_join
from softgrove.operators.quantiles import describe

RESULT_KEYS = ("comparison_mode", "ds_name", "with_fuzzy_rules")


def results_sorted(df: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    return df.orderBy(*keys, "sn")


def with_group_mean(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Each row with the mean of its group: aggregate, then join the few group rows back,
    so that one big group does not end up in one task."""
    means = df.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])
    return null_safe_join(df, means, keys)


def results_mean(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def results_describe(df: DataFrame, measure: str, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    return describe(df, keys, measure)


def mean_error(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error (1 - |mean accuracy|) and population standard deviation over a group of fits."""
    return df.groupBy(*keys).agg(
        (F.lit(1.0) - F.abs(F.avg("acc_train"))).alias("err_train_mean"), F.stddev_pop("acc_train").alias("std_train"),
        (F.lit(1.0) - F.abs(F.avg("acc_test"))).alias("err_test_mean"), F.stddev_pop("acc_test").alias("std_test"))


def curve_points(df: DataFrame, ds_name: str, n_conv: int) -> DataFrame:
    """Error over regulation for one data set and number of sets, ascending."""
    return (
        df.filter((F.col("ds_name") == ds_name) & (F.col("n_conv") == n_conv))
        .select(F.col("fuzzy_reg").cast("double").alias("fuzzy_reg"),
                F.col("err_train_mean").cast("double").alias("err_train_mean"),
                F.col("err_test_mean").cast("double").alias("err_test_mean"))
        .orderBy("fuzzy_reg")
    )


def curve_extrema(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Lowest and highest point of each curve, the first one on ties."""
    return df.groupBy(*keys).agg(
        F.min_by(x, F.struct(y, x)).alias("x_min"), F.min(y).alias("y_min"),
        F.min_by(x, F.struct((-F.col(y)).alias("n"), F.col(x))).alias("x_max"), F.max(y).alias("y_max"))


def param_grid(datasets: DataFrame, ds_column: str, n_conv: tuple[int, int, int],
               fuzzy_reg: tuple[str, str, str]) -> DataFrame:
    """Data sets x numbers of sets x regulations; the regulation steps in exact decimals.

    ``fuzzy_reg`` gives start, stop and step as decimal texts.
    """
    from decimal import Decimal

    start, stop, step = (Decimal(t) for t in fuzzy_reg)
    last = int((stop - start) // step)
    reg = (F.lit(start).cast("decimal(18,9)") + F.col("__i").cast("decimal(18,0)") * F.lit(step).cast("decimal(18,9)"))
    return (
        datasets.withColumn("n_conv", F.explode(F.sequence(F.lit(n_conv[0]), F.lit(n_conv[1]), F.lit(n_conv[2]))))
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .withColumn("fuzzy_reg", reg.cast("double")).drop("__i")
        .withColumnRenamed(ds_column, "ds_name")
    )
