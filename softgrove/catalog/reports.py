"""Reports over result tables. Events stand in for result rows of many experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.catalog.common import r, read
from softgrove.operators.quantiles import describe
from softgrove.plans import reports as R

KEYS = list(R.RESULT_KEYS)


def _results(spark, sf) -> DataFrame:
    return read(spark, sf, "events", "event_id", "event_type", "user_id", "value").select(
        F.col("event_type").alias("comparison_mode"), (F.col("user_id") % 5).cast("string").alias("ds_name"),
        (F.col("event_id") % 2 == 1).alias("with_fuzzy_rules"), (F.col("event_id") % 10).alias("sn"),
        (F.col("value") / 100).alias("acc_test"), (F.col("value") / 200 + 0.5).alias("acc_train"), "event_id")


def results_sorted(spark, sf):
    return R.results_sorted(_results(spark, sf)).select(*KEYS, "sn", "event_id", r("acc_test").alias("acc_test"))


def results_with_group_mean(spark, sf):
    df = R.with_group_mean(_results(spark, sf), ["acc_test", "acc_train"])
    return df.select("event_id", *KEYS, r("mean_acc_test").alias("mean_acc_test"),
                     r("mean_acc_train").alias("mean_acc_train"))


def results_mean(spark, sf):
    return R.results_mean(_results(spark, sf), ["acc_test", "acc_train"]).select(
        *KEYS, r("acc_test").alias("acc_test"), r("acc_train").alias("acc_train"))


def results_describe(spark, sf):
    cols = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return R.results_describe(_results(spark, sf), "acc_test").select(*KEYS, "count", *[r(c).alias(c) for c in cols])


def results_mean_error(spark, sf):
    df = R.mean_error(_results(spark, sf), ["ds_name", "sn"])
    return df.select("ds_name", "sn", *[r(c).alias(c) for c in
                                        ("err_train_mean", "std_train", "err_test_mean", "std_test")])


def _curves(spark, sf) -> DataFrame:
    """Errors by day of month (as regulation) per event type and user group."""
    return read(spark, sf, "events", "event_type", "user_id", "ts", "value").groupBy(
        F.col("event_type").alias("ds_name"), (F.col("user_id") % 3 + 3).cast("int").alias("n_conv"),
        (F.dayofmonth("ts") / 31).alias("fuzzy_reg")).agg(
        F.round(F.avg("value"), 6).alias("err_train_mean"), F.round(F.max("value"), 6).alias("err_test_mean"))


def curve_points(spark, sf):
    df = R.curve_points(_curves(spark, sf), "click", 4)
    return df.select(r("fuzzy_reg").alias("fuzzy_reg"), "err_train_mean", "err_test_mean")


def curve_extrema(spark, sf):
    df = R.curve_extrema(_curves(spark, sf), ["ds_name", "n_conv"], "fuzzy_reg", "err_train_mean")
    return df.select("ds_name", "n_conv", r("x_min").alias("x_min"), "y_min", r("x_max").alias("x_max"), "y_max")


def param_grid(spark, sf):
    data = read(spark, sf, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    return R.param_grid(data, "event_type", (3, 6, 1), ("0.0", "1.0", "0.1"))


def _with_gaps(spark, sf) -> DataFrame:
    """Customers beside their dearest orders: keys and values with gaps, groups without any value."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice").filter("o_totalprice > 450000")
    customers = read(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        F.expr("nullif(c_nationkey, 7)").alias("nation"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price"))


def describe_nulls(spark, sf):
    cols = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return describe(_with_gaps(spark, sf), ["segment", "nation"], "price").select(
        "segment", "nation", "count", *[r(c).alias(c) for c in cols])


def describe_hot_value(spark, sf):
    """One value in most rows of every group."""
    df = read(spark, sf, "lineitem", "l_returnflag", "l_discount", "l_tax").select(
        "l_returnflag", F.expr("if(l_discount > 0.02, 0.5D, l_tax)").alias("x"))
    return describe(df, ["l_returnflag"], "x").select("l_returnflag", "count", *[
        r(c).alias(c) for c in ("mean", "min", "q25", "q50", "q75", "max")])


def group_mean_nulls(spark, sf):
    return R.with_group_mean(_with_gaps(spark, sf), ["price"], ["segment", "nation"]).select(
        "c_custkey", "o_orderkey", "segment", "nation", r("mean_price").alias("mean_price"))


QUERIES = {f.__name__: f for f in (describe_nulls, describe_hot_value, group_mean_nulls, results_sorted, results_with_group_mean, results_mean, results_describe,
                                   results_mean_error, curve_points, curve_extrema, param_grid)}

_R = ("WITH r AS (SELECT event_type AS comparison_mode, CAST(user_id % 5 AS VARCHAR) AS ds_name, event_id % 2 = 1 AS "
      "with_fuzzy_rules, event_id % 10 AS sn, value / 100 AS acc_test, value / 200 + 0.5 AS acc_train, event_id FROM events)")
_K = "comparison_mode, ds_name, with_fuzzy_rules"
_C = ("WITH c AS (SELECT event_type AS ds_name, CAST(user_id % 3 + 3 AS INTEGER) AS n_conv, day(ts) / 31 AS fuzzy_reg, "
      "round(avg(value), 6) AS err_train_mean, round(max(value), 6) AS err_test_mean FROM events GROUP BY 1, 2, 3)")

_G = ("WITH g AS (SELECT c_custkey, o_orderkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 7) AS nation, "
      "floor(o_totalprice / 1000) AS price FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) "
      "ON c_custkey = o_custkey)")


def _describe_sql(x: str, std: bool = True) -> str:
    parts = [f"count({x}) AS count", f"round(avg({x}), 6) AS mean", *([f"round(stddev_samp({x}), 6) AS std"] if std else []),
             f"round(min({x}), 6) AS min", *[f"round(quantile_cont({x}, {q / 100}), 6) AS q{q}" for q in (25, 50, 75)],
             f"round(max({x}), 6) AS max"]
    return ", ".join(parts)


ORACLES = {
    "describe_nulls": f"{_G} SELECT segment, nation, {_describe_sql('price')} FROM g GROUP BY 1, 2",
    "describe_hot_value": "SELECT l_returnflag, " + _describe_sql("x", std=False) + " FROM (SELECT l_returnflag, CASE WHEN "
                          "l_discount > 0.02 THEN 0.5::DOUBLE ELSE l_tax END AS x FROM lineitem) GROUP BY 1",
    "group_mean_nulls": f"{_G} SELECT c_custkey, o_orderkey, segment, nation, round(avg(price) OVER (PARTITION BY segment, "
                        f"nation), 6) AS mean_price FROM g",
    "results_sorted": f"{_R} SELECT {_K}, sn, event_id, round(acc_test, 6) AS acc_test FROM r ORDER BY {_K}, sn",
    "results_with_group_mean": f"{_R} SELECT event_id, {_K}, round(avg(acc_test) OVER w, 6) AS mean_acc_test, "
                               f"round(avg(acc_train) OVER w, 6) AS mean_acc_train FROM r WINDOW w AS (PARTITION BY {_K})",
    "results_mean": f"{_R} SELECT {_K}, round(avg(acc_test), 6) AS acc_test, round(avg(acc_train), 6) AS acc_train "
                    f"FROM r GROUP BY ALL",
    "results_describe": f"{_R} SELECT {_K}, count(acc_test) AS count, round(avg(acc_test), 6) AS mean, "
                        f"round(stddev_samp(acc_test), 6) AS std, round(min(acc_test), 6) AS min, "
                        f"round(quantile_cont(acc_test, 0.25), 6) AS q25, round(quantile_cont(acc_test, 0.5), 6) AS q50, "
                        f"round(quantile_cont(acc_test, 0.75), 6) AS q75, round(max(acc_test), 6) AS max FROM r GROUP BY {_K}",
    "results_mean_error": f"{_R} SELECT ds_name, sn, round(1 - abs(avg(acc_train)), 6) AS err_train_mean, "
                          f"round(stddev_pop(acc_train), 6) AS std_train, round(1 - abs(avg(acc_test)), 6) AS err_test_mean, "
                          f"round(stddev_pop(acc_test), 6) AS std_test FROM r GROUP BY 1, 2",
    "curve_points": f"{_C} SELECT round(fuzzy_reg, 6) AS fuzzy_reg, err_train_mean, err_test_mean FROM c "
                    f"WHERE ds_name = 'click' AND n_conv = 4 ORDER BY 1",
    "curve_extrema": f"{_C} SELECT ds_name, n_conv, round(arg_min(fuzzy_reg, (err_train_mean, fuzzy_reg)), 6) AS x_min, "
                     f"min(err_train_mean) AS y_min, round(arg_min(fuzzy_reg, (-err_train_mean, fuzzy_reg)), 6) AS x_max, "
                     f"max(err_train_mean) AS y_max FROM c GROUP BY 1, 2",
    "param_grid": "SELECT event_type AS ds_name, n AS n_rows, CAST(c AS INTEGER) AS n_conv, "
                  "CAST(CAST(i AS DECIMAL(18, 0)) * 0.1 AS DOUBLE) AS fuzzy_reg FROM (SELECT event_type, count(*) AS n "
                  "FROM events GROUP BY 1), range(3, 7) a(c), range(11) b(i)",
}
