"""Impurities, gains, leaf statistics, metrics and multiway rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.catalog.common import r, read, set_map, sql_mass
from softgrove.functions import metrics
from softgrove.functions.membership import membership_mass
from softgrove.operators import impurity as I
from softgrove.operators.multiway import discrete_counts, feature_scores

GROUP = ["l_linestatus"]
LABEL = "l_returnflag"


def _lines(spark, sf, *extra) -> DataFrame:
    return read(spark, sf, "lineitem", "l_linestatus", "l_returnflag", "l_quantity", *extra)


def _mass():
    return membership_mass("l_quantity", set_map("l_quantity")["l_quantity"])


def _test():
    return F.col("l_quantity") >= 25


def _impurity(criterion, soft):
    def run(spark, sf):
        return I.class_impurity(_lines(spark, sf), GROUP, LABEL, criterion, _mass() if soft else None).select(
            *GROUP, r("impurity").alias("impurity"))
    return run


def _gain(criterion, soft):
    def run(spark, sf):
        return I.binary_gain(_lines(spark, sf), GROUP, LABEL, _test(), criterion, _mass() if soft else None).select(
            *GROUP, r("gain", 9).alias("gain"))
    return run


def gain_ratio(spark, sf):
    return I.binary_gain_ratio(_lines(spark, sf), GROUP, LABEL, "l_quantity", _test()).select(
        *GROUP, r("gain_ratio", 9).alias("gain_ratio"))


def _priced(spark, sf):
    return _lines(spark, sf, "l_extendedprice", "l_discount").withColumn("price", F.col("l_extendedprice") / 1000)


def variance_by_group(spark, sf):
    return _priced(spark, sf).groupBy(LABEL).agg(r(F.var_pop("price")).alias("variance"))


def stddev_by_group(spark, sf):
    return _priced(spark, sf).groupBy(LABEL).agg(r(F.stddev_pop("price")).alias("stddev"))


def _reduction(criterion, soft, targets=("price",)):
    def run(spark, sf):
        return I.value_reduction(_priced(spark, sf), [LABEL], targets, _test(), criterion,
                                 _mass() if soft else None).select(LABEL, r("gain").alias("gain"))
    return run


def majority_label(spark, sf):
    return I.majority_label(read(spark, sf, "lineitem", "l_returnflag", "l_tax"), ["l_tax"], LABEL)


def leaf_proba(spark, sf):
    shares = I.label_shares(read(spark, sf, "events", "event_type", "user_id"), ["user_id"], "event_type")
    return shares.select("user_id", F.inline(F.arrays_zip("leaf_labels", "leaf_proba"))).select(
        "user_id", F.col("leaf_labels").alias("label"), r("leaf_proba").alias("p"))


def leaf_mean(spark, sf):
    means = I.mean_vector(read(spark, sf, "embeddings", "embedding", "label"), ["label"], "embedding")
    return means.select("label", F.posexplode("leaf_mean").alias("i", "v")).select("label", "i", r("v").alias("mean"))


def _predicted(spark, sf):
    return _priced(spark, sf).withColumn(
        "predicted", F.when(F.col("l_quantity") >= 25, 75.0).otherwise(25.0)).withColumn(
        "predicted_flag", F.when(F.col("l_discount") >= 0.05, "N").otherwise("R"))


def metric_mse_mae(spark, sf):
    return _predicted(spark, sf).groupBy(LABEL).agg(
        r(metrics.mean_squared_error(F.col("price"), F.col("predicted"))).alias("mse"),
        r(metrics.mean_absolute_error(F.col("price"), F.col("predicted"))).alias("mae"))


def metric_accuracy(spark, sf):
    return _predicted(spark, sf).groupBy("l_linestatus").agg(
        r(metrics.accuracy(F.col(LABEL), F.col("predicted_flag"))).alias("accuracy"))


MULTIWAY = ("o_orderstatus", "o_month", "o_year")


def orders_discrete(spark, sf) -> DataFrame:
    """Orders with discrete features only and the priority as label."""
    return read(spark, sf, "orders", "o_orderstatus", "o_orderpriority", "o_orderdate").select(
        "o_orderstatus", "o_orderpriority", F.month("o_orderdate").cast("string").alias("o_month"),
        F.year("o_orderdate").cast("string").alias("o_year"))


def _scores(spark, sf):
    names = F.array(*[F.lit(f) for f in MULTIWAY])
    return feature_scores(discrete_counts(orders_discrete(spark, sf), [], MULTIWAY, "o_orderpriority"), []).withColumn(
        "feature", F.get(names, F.col("fi")))


def id3_feature_rank(spark, sf):
    return _scores(spark, sf).select("feature", "n_values", r("gain", 9).alias("gain"))


def c45_feature_rank(spark, sf):
    return _scores(spark, sf).select("feature", r("gain", 9).alias("gain"), r("split_info", 9).alias("split_info"),
                                     r("gain_ratio", 9).alias("gain_ratio"))


QUERIES = {
    "entropy_by_group": _impurity("entropy", False), "entropy_weighted": _impurity("entropy", True),
    "gini_by_group": _impurity("gini", False), "gini_weighted": _impurity("gini", True),
    "gain_gini": _gain("gini", False), "gain_entropy": _gain("entropy", False),
    "gain_gini_fuzzy": _gain("gini", True), "gain_entropy_fuzzy": _gain("entropy", True),
    "gain_ratio": gain_ratio, "variance_by_group": variance_by_group, "stddev_by_group": stddev_by_group,
    "var_reduction": _reduction("variance", False), "var_reduction_fuzzy": _reduction("variance", True),
    "std_reduction": _reduction("stddev", False),
    "var_reduction_outputs": _reduction("variance", False, ("price", "l_discount")),
    "majority_label": majority_label, "leaf_proba": leaf_proba, "leaf_mean": leaf_mean,
    "metric_mse_mae": metric_mse_mae, "metric_accuracy": metric_accuracy,
    "id3_feature_rank": id3_feature_rank, "c45_feature_rank": c45_feature_rank,
}

# ---- SQL ----

_M = sql_mass("l_quantity", "l_quantity")
_TERM = {"entropy": "CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END", "gini": "p * (1 - p)"}


def _impurity_sql(criterion: str, soft: bool) -> str:
    w = f"sum({_M})" if soft else "count(*)"
    return (f"SELECT l_linestatus, round(sum({_TERM[criterion]}), 6) AS impurity FROM (SELECT l_linestatus, "
            f"c / sum(c) OVER (PARTITION BY l_linestatus) AS p FROM (SELECT l_linestatus, l_returnflag, {w} AS c "
            f"FROM lineitem GROUP BY 1, 2)) GROUP BY 1")


def _gain_sql(criterion: str, soft: bool, extra: str = "") -> str:
    w = _M if soft else "1.0"
    t = _TERM[criterion]

    def side(name: str, where: str, weight: str) -> str:
        return (f"{name} AS (SELECT l_linestatus, sum(c) AS n, sum({t}) AS i FROM (SELECT *, c / sum(c) OVER "
                f"(PARTITION BY l_linestatus) AS p FROM (SELECT l_linestatus, l_returnflag, sum({weight}) AS c "
                f"FROM lineitem WHERE {where} GROUP BY 1, 2)) GROUP BY 1)")

    return (f"WITH {side('a', 'TRUE', '1.0')}, {side('h', 'l_quantity >= 25', w)}, {side('q', 'l_quantity < 25', w)}{extra} "
            f"SELECT l_linestatus, {{value}} FROM a JOIN h USING (l_linestatus) JOIN q USING (l_linestatus)")


_GAIN = "a.i - h.n / (h.n + q.n) * h.i - q.n / (h.n + q.n) * q.i"
_OWN = (", o AS (SELECT l_linestatus, sum(-p * log2(p)) AS i FROM (SELECT l_linestatus, count(*) / sum(count(*)) OVER "
        "(PARTITION BY l_linestatus) AS p FROM lineitem GROUP BY l_linestatus, l_quantity) GROUP BY 1)")


def _gain_text(criterion: str, soft: bool) -> str:
    return _gain_sql(criterion, soft).replace("{value}", f"round({_GAIN}, 9) AS gain")


def _reduction_sql(fn: str, soft: bool, targets=("l_extendedprice / 1000",)) -> str:
    w = _M if soft else "1.0"
    p = f"sum({w}) FILTER (l_quantity >= 25) / sum({w})"
    parts = [f"{fn}({t}) - {p} * {fn}({t}) FILTER (l_quantity >= 25) - (1 - {p}) * {fn}({t}) FILTER (l_quantity < 25)"
             for t in targets]
    return f"SELECT l_returnflag, round({' + '.join(parts)}, 6) AS gain FROM lineitem GROUP BY 1"


def _rank_sql(columns: str) -> str:
    return f"""
WITH d AS (SELECT o_orderstatus, o_orderpriority AS y, CAST(month(o_orderdate) AS VARCHAR) AS o_month,
                  CAST(year(o_orderdate) AS VARCHAR) AS o_year FROM orders),
l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS v, y FROM d" for f in MULTIWAY)}),
h AS (SELECT feature, sum(-p * log2(p)) AS h FROM (SELECT feature, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p
      FROM l GROUP BY feature, y) GROUP BY 1),
c AS (SELECT feature, v, y, count(*) AS c FROM l GROUP BY ALL),
hv AS (SELECT feature, v, sum(c) AS n, sum(-p * log2(p)) AS h FROM
       (SELECT *, c / sum(c) OVER (PARTITION BY feature, v) AS p FROM c) GROUP BY 1, 2),
g AS (SELECT feature, count(*) AS n_values, sum(share * h) AS inside, sum(-share * log2(share)) AS info FROM
      (SELECT *, n / sum(n) OVER (PARTITION BY feature) AS share FROM hv) GROUP BY 1)
SELECT feature, {columns} FROM g JOIN h USING (feature)"""


ORACLES = {
    "entropy_by_group": _impurity_sql("entropy", False), "entropy_weighted": _impurity_sql("entropy", True),
    "gini_by_group": _impurity_sql("gini", False), "gini_weighted": _impurity_sql("gini", True),
    "gain_gini": _gain_text("gini", False), "gain_entropy": _gain_text("entropy", False),
    "gain_gini_fuzzy": _gain_text("gini", True), "gain_entropy_fuzzy": _gain_text("entropy", True),
    "gain_ratio": _gain_sql("entropy", False, _OWN).replace("{value}", f"round(({_GAIN}) / o.i, 9) AS gain_ratio")
    + " JOIN o USING (l_linestatus)",
    "variance_by_group": "SELECT l_returnflag, round(var_pop(l_extendedprice / 1000), 6) AS variance FROM lineitem GROUP BY 1",
    "stddev_by_group": "SELECT l_returnflag, round(stddev_pop(l_extendedprice / 1000), 6) AS stddev FROM lineitem GROUP BY 1",
    "var_reduction": _reduction_sql("var_pop", False), "var_reduction_fuzzy": _reduction_sql("var_pop", True),
    "std_reduction": _reduction_sql("stddev_pop", False),
    "var_reduction_outputs": _reduction_sql("var_pop", False, ("l_extendedprice / 1000", "l_discount")),
    "majority_label": "SELECT l_tax, l_returnflag AS label FROM (SELECT l_tax, l_returnflag, row_number() OVER (PARTITION BY "
                      "l_tax ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1",
    "leaf_proba": "SELECT user_id, event_type AS label, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS p "
                  "FROM events GROUP BY 1, 2",
    "leaf_mean": "SELECT label, CAST(i AS INTEGER) AS i, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, "
                 "unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2",
    "metric_mse_mae": "SELECT l_returnflag, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae FROM (SELECT "
                      "l_returnflag, l_extendedprice / 1000 - CASE WHEN l_quantity >= 25 THEN 75 ELSE 25 END AS d "
                      "FROM lineitem) GROUP BY 1",
    "metric_accuracy": "SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = CASE WHEN l_discount >= 0.05 THEN 'N' "
                       "ELSE 'R' END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem GROUP BY 1",
    "id3_feature_rank": _rank_sql("n_values, round(h - inside, 9) AS gain"),
    "c45_feature_rank": _rank_sql("round(h - inside, 9) AS gain, round(info, 9) AS split_info, "
                                  "round((h - inside) / info, 9) AS gain_ratio"),
}
