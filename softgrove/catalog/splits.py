"""Split predicates, candidates and best splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.catalog.common import ORDERS_SQL, orders_tier, r, read, set_map, sql_entropy, sql_gini, sql_mass
from softgrove.functions.criteria import GainSpec
from softgrove.operators.fuzzify import FuzzySets
from softgrove.operators.splits import Layout, best_per_node, candidate_sums, prefix_sums, score, unroll
from softgrove.plans.frame import ModelSpec, masses_sql, training_rows
from softgrove.plans.score import split_test
from softgrove.plans.tree import TreeSpec, fit_tree, label_coding, target_columns, value_coding

LINE_FEATURES = ("l_quantity", "l_discount", "l_tax")


def root_layout(df: DataFrame, features, target: str, task: str, criterion: str, sets=None, categorical=()):
    """Unrolled root rows and their layout."""
    coding = label_coding(df, target) if task == "class" else value_coding(df, [target])
    cats = frozenset(i for i, f in enumerate(features) if f in categorical)
    models = [ModelSpec(0, 0 if sets else None)]
    layout = Layout(tuple(features), task, coding.width, GainSpec(criterion, soft=sets is not None), cats,
                    masses=masses_sql(features, [sets], models) if sets else "0D")
    rows = training_rows(df, features, categorical, target_columns(coding, [target]), models)
    return rows.withColumn("node", F.lit(1).cast("bigint")), layout


def _best(df, features, target, task, criterion, sets=None, categorical=()):
    """Best split of the root as a one-row table."""
    rows, layout = root_layout(df, features, target, task, criterion, sets, categorical)
    scored = score(prefix_sums(candidate_sums(unroll(rows, layout), layout), layout), layout)
    names = F.array(*[F.lit(f) for f in features])
    return best_per_node(scored, layout).select(
        F.get(names, F.col("fi")).alias("feature"), F.col("vmin").alias("split_num"), F.col("cat").alias("split_cat"),
        r("gain").alias("gain"))


def _lines(spark, sf):
    return read(spark, sf, "lineitem", *LINE_FEATURES, "l_returnflag", "l_extendedprice").withColumn(
        "price", F.col("l_extendedprice") / 1000)


def split_numeric(spark: SparkSession, sf: str) -> DataFrame:
    hit = split_test("l_quantity", 25.0, None)
    return _lines(spark, sf).groupBy(hit.alias("passes"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def split_categorical(spark: SparkSession, sf: str) -> DataFrame:
    hit = split_test("o_orderpriority", None, "1-URGENT")
    return read(spark, sf, "orders", "o_orderpriority", "o_orderstatus").groupBy(
        hit.alias("passes"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows, layout = root_layout(_lines(spark, sf), LINE_FEATURES, "l_returnflag", "class", "gini")
    scored = score(prefix_sums(candidate_sums(unroll(rows, layout), layout), layout), layout)
    names = F.array(*[F.lit(f) for f in LINE_FEATURES])
    return scored.filter("gain IS NOT NULL").select(
        F.get(names, F.col("fi")).alias("feature"), F.col("vmin").alias("value"),
        F.col("h_n").cast("bigint").alias("n_true"),
        F.col("r_n").cast("bigint").alias("n_false"), r("gain").alias("gain"))


def best_split_gini(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "l_returnflag", "class", "gini")


def best_split_entropy(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "l_returnflag", "class", "entropy")


def best_split_gini_fuzzy(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "l_returnflag", "class", "gini", set_map(*LINE_FEATURES))


def best_split_entropy_fuzzy(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "l_returnflag", "class", "entropy", set_map(*LINE_FEATURES))


def best_split_var(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "price", "value", "variance")


def best_split_var_fuzzy(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "price", "value", "variance", set_map(*LINE_FEATURES))


def best_split_std(spark, sf):
    return _best(_lines(spark, sf), LINE_FEATURES, "price", "value", "stddev")


def best_split_mixed(spark, sf):
    """Numeric and categorical features in one search."""
    return _best(orders_tier(spark, sf), ("o_orderpriority", "o_month", "o_orderstatus"), "tier", "class", "gini",
                 categorical=("o_orderpriority", "o_orderstatus"))


def best_split_on_memberships(spark, sf):
    """Memberships as ordinary features beside the numbers they come from, crisp gain."""
    sets = FuzzySets(set_map("l_quantity", "l_discount"))
    df = sets.flatten(_lines(spark, sf))
    return _best(df, ("l_quantity", "l_discount", *sets.flat_names()), "l_returnflag", "class", "gini")


def best_split_bucketed(spark, sf):
    """Whole root search on a feature with very many values: buckets first, then only
    the buckets that may still hold the best split, value by value."""
    df = orders_tier(spark, sf)
    model = fit_tree(df, TreeSpec(("o_totalprice", "o_month"), ("tier",), direct_limit=64,
                                  rules=_stump()))
    return model.nodes(spark).where("node_id = 1").select(
        "feature", "split_num", r("gain").alias("gain"), F.col("n").cast("bigint").alias("n"))


def _stump():
    from softgrove.plans.grow import StopRules

    return StopRules(max_depth=0)


QUERIES = {f.__name__: f for f in (
    split_numeric, split_categorical, split_candidates, best_split_gini, best_split_entropy, best_split_gini_fuzzy,
    best_split_entropy_fuzzy, best_split_var, best_split_var_fuzzy, best_split_std, best_split_mixed,
    best_split_on_memberships, best_split_bucketed)}


# ---- SQL: every candidate is compared with every distinct value, no running sums ----

_FLAGS = ("A", "N", "R")


def _scan_class(features: list[tuple[str, str]], table: str, label: str, labels, fn, masses: dict[str, str] | None,
                prelude: str = "", categorical: tuple[str, ...] = ()) -> str:
    """Candidates x distinct values join per feature; features are (name, expression)."""
    parts = []
    for i, (name, expr) in enumerate(features):
        op = "=" if name in categorical else ">="
        mass = masses[name] if masses else "0.0"
        cs = ", ".join(f"count(*) FILTER ({label} = {lab!r})::DOUBLE AS c{k}" for k, lab in enumerate(labels))
        gs = ", ".join(f"coalesce(sum({mass}) FILTER ({label} = {lab!r}), 0) AS g{k}" for k, lab in enumerate(labels))
        side = []
        for k in range(len(labels)):
            for st in ("c", "g"):
                side += [f"sum(CASE WHEN x.v {op} c.v THEN x.{st}{k} ELSE 0 END) AS h_{st}{k}",
                         f"sum(CASE WHEN x.v {op} c.v THEN 0 ELSE x.{st}{k} END) AS r_{st}{k}",
                         f"sum(x.{st}{k}) AS a_{st}{k}"]
        num = "NULL::DOUBLE" if name in categorical else "c.v"
        cat = "c.v" if name in categorical else "NULL::VARCHAR"
        parts.append(
            f"SELECT {i} AS fi, '{name}' AS feature, {num} AS split_num, {cat} AS split_cat, {', '.join(side)} "
            f"FROM (SELECT {expr} AS v, {cs}, {gs} FROM {table} GROUP BY 1) x, "
            f"(SELECT DISTINCT {expr} AS v FROM {table}) c GROUP BY c.v")
    cols = lambda s, st: [f"{s}{st}{k}" for k in range(len(labels))]
    st = "g" if masses else "c"
    n = {s: "(" + " + ".join(cols(s, st)) + ")" for s in ("a_", "h_", "r_")}
    gain = (f"{fn(cols('a_', 'c'))} - {n['h_']} / {n['a_']} * {fn(cols('h_', st))} "
            f"- {n['r_']} / {n['a_']} * {fn(cols('r_', st))}")
    both = f"({' + '.join(cols('h_', 'c'))}) > 0 AND ({' + '.join(cols('r_', 'c'))}) > 0"
    pre = f"WITH {prelude} " if prelude else ""
    return (f"{pre}SELECT feature, split_num, split_cat, round(gain, 6) AS gain FROM "
            f"(SELECT *, {gain} AS gain FROM ({' UNION ALL '.join(parts)}) WHERE {both}) "
            f"ORDER BY round(gain, 12) DESC, fi, split_num, split_cat LIMIT 1")


def _scan_value(features, table: str, target: str, std: bool, masses: dict[str, str] | None) -> str:
    parts = []
    for i, f in enumerate(features):
        m = masses[f] if masses else "1.0"
        fn = "stddev_pop" if std else "var_pop"
        parts.append(
            f"SELECT {i} AS fi, '{f}' AS feature, c.v AS split_num, {fn}(x.y) AS a, "
            f"coalesce({fn}(x.y) FILTER (x.v >= c.v), 0) AS h, coalesce({fn}(x.y) FILTER (x.v < c.v), 0) AS r, "
            f"sum(x.m) FILTER (x.v >= c.v) / sum(x.m) AS p, count(*) FILTER (x.v < c.v) AS n_false "
            f"FROM (SELECT {f} AS v, {target} AS y, {m} AS m FROM {table}) x, (SELECT DISTINCT {f} AS v FROM {table}) c "
            f"GROUP BY c.v")
    return (f"SELECT feature, split_num, NULL::VARCHAR AS split_cat, round(gain, 6) AS gain FROM "
            f"(SELECT *, a - p * h - (1 - p) * r AS gain FROM ({' UNION ALL '.join(parts)}) WHERE n_false > 0) "
            f"ORDER BY round(gain / a, 12) DESC, fi, split_num LIMIT 1")


def _candidates_sql() -> str:
    parts = []
    for f in LINE_FEATURES:
        h = [f"(count(*) FILTER (x.v >= c.v AND x.y = '{k}'))::DOUBLE" for k in _FLAGS]
        q = [f"(count(*) FILTER (x.v < c.v AND x.y = '{k}'))::DOUBLE" for k in _FLAGS]
        a = [f"(count(*) FILTER (x.y = '{k}'))::DOUBLE" for k in _FLAGS]
        parts.append(
            f"SELECT '{f}' AS feature, c.v AS value, count(*) FILTER (x.v >= c.v) AS n_true, "
            f"count(*) FILTER (x.v < c.v) AS n_false, "
            f"round({sql_gini(a)} - count(*) FILTER (x.v >= c.v) / count(*) * {sql_gini(h)} "
            f"- count(*) FILTER (x.v < c.v) / count(*) * {sql_gini(q)}, 6) AS gain "
            f"FROM (SELECT {f} AS v, l_returnflag AS y FROM lineitem) x, (SELECT DISTINCT {f} AS v FROM lineitem) c GROUP BY c.v")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_false > 0"


def _bucketed_sql() -> str:
    parts = []
    for i, f in enumerate(("o_totalprice", "o_month")):
        run = ", ".join(f"sum(c{k}) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS h{k}, sum(c{k}) OVER () AS a{k}"
                        for k in range(3))
        cs = ", ".join(f"count(*) FILTER (tier = {k})::DOUBLE AS c{k}" for k in range(3))
        parts.append(f"SELECT {i} AS fi, '{f}' AS feature, v AS split_num, {run} FROM "
                     f"(SELECT {f} AS v, {cs} FROM orders_t GROUP BY 1)")
    a, h, q = ([f"a{k}" for k in range(3)], [f"h{k}" for k in range(3)], [f"(a{k} - h{k})" for k in range(3)])
    s = lambda c: "(" + " + ".join(c) + ")"
    gain = f"{sql_gini(a)} - {s(h)} / {s(a)} * {sql_gini(h)} - {s(q)} / {s(a)} * {sql_gini(q)}"
    return (f"WITH {ORDERS_SQL} SELECT feature, split_num, round(gain, 6) AS gain, CAST({s(a)} AS BIGINT) AS n FROM "
            f"(SELECT *, {gain} AS gain FROM ({' UNION ALL '.join(parts)}) WHERE {s(q)} > 0) "
            f"ORDER BY round(gain, 12) DESC, fi, split_num LIMIT 1")


_LF = [(f, f) for f in LINE_FEATURES]
_MASS = {f: sql_mass(f, f) for f in LINE_FEATURES}


def _membership_features() -> list[tuple[str, str]]:
    from softgrove.catalog.common import sql_memberships

    out = [("l_quantity", "l_quantity"), ("l_discount", "l_discount")]
    for f in ("l_quantity", "l_discount"):
        out += [(f"dm_{f}_{j}", e) for j, e in enumerate(sql_memberships(f, f))]
    return out


ORACLES = {
    "split_numeric": "SELECT l_quantity >= 25 AS passes, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "split_categorical": "SELECT o_orderpriority = '1-URGENT' AS passes, o_orderstatus, count(*) AS n "
                         "FROM orders GROUP BY 1, 2",
    "split_candidates": _candidates_sql(),
    "best_split_gini": _scan_class(_LF, "lineitem", "l_returnflag", _FLAGS, sql_gini, None),
    "best_split_entropy": _scan_class(_LF, "lineitem", "l_returnflag", _FLAGS, sql_entropy, None),
    "best_split_gini_fuzzy": _scan_class(_LF, "lineitem", "l_returnflag", _FLAGS, sql_gini, _MASS),
    "best_split_entropy_fuzzy": _scan_class(_LF, "lineitem", "l_returnflag", _FLAGS, sql_entropy, _MASS),
    "best_split_var": _scan_value(LINE_FEATURES, "lineitem", "l_extendedprice / 1000", False, None),
    "best_split_var_fuzzy": _scan_value(LINE_FEATURES, "lineitem", "l_extendedprice / 1000", False, _MASS),
    "best_split_std": _scan_value(LINE_FEATURES, "lineitem", "l_extendedprice / 1000", True, None),
    "best_split_mixed": _scan_class(
        [("o_orderpriority", "o_orderpriority"), ("o_month", "o_month"), ("o_orderstatus", "o_orderstatus")],
        "orders_t", "tier", (0, 1, 2), sql_gini, None, ORDERS_SQL, ("o_orderpriority", "o_orderstatus")),
    "best_split_on_memberships": _scan_class(_membership_features(), "lineitem", "l_returnflag", _FLAGS, sql_gini, None),
    "best_split_bucketed": _bucketed_sql(),
}
