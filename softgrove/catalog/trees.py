"""Whole trees: growth, nodes, rules, prediction, hold-out accuracy, multiway trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from softgrove.catalog.common import LINE_TIER, ORDERS_SQL, lines_tier, orders_tier, r, read, set_map, sql_mass
from softgrove.catalog.fuzzy import _theta, lloyd_sql
from softgrove.catalog.impurity import MULTIWAY, orders_discrete
from softgrove.catalog.sqlgen import TreeSql
from softgrove.functions import metrics
from softgrove.operators.fuzzify import FuzzySets
from softgrove.operators.sampling import holdout
from softgrove.plans.grow import StopRules
from softgrove.plans.multiway import MultiwaySpec, fit_multiway
from softgrove.plans.tree import TreeSpec, fit_soft_and_crisp, fit_table_tree, fit_tree

FEATURES = ("o_totalprice", "o_month")
TWO_LEVELS = StopRules(max_depth=1)


def _spec(soft=False, rules=TWO_LEVELS, **kw) -> TreeSpec:
    return TreeSpec(FEATURES, ("tier",), fuzzy_sets=set_map(*FEATURES) if soft else None, rules=rules, **kw)


def _tree(spark, sf, **kw):
    df = orders_tier(spark, sf)
    return df, fit_tree(df, _spec(**kw))


def _node_view(model, spark):
    return model.nodes(spark).select(
        "node_id", "depth", "is_leaf", "feature", "split_num", r("gain").alias("gain"),
        F.col("n").cast("bigint").alias("n"), "leaf_value")


def tree_nodes_depth1(spark, sf):
    _, model = _tree(spark, sf)
    return _node_view(model, spark)


def tree_nodes_soft(spark, sf):
    _, model = _tree(spark, sf, soft=True)
    return _node_view(model, spark)


def tree_nodes_entropy(spark, sf):
    _, model = _tree(spark, sf, criterion="entropy")
    return _node_view(model, spark)


def tree_predict(spark, sf):
    df, model = _tree(spark, sf, soft=True)
    return model.transform(df).select("o_orderkey", "prediction")


def tree_predict_proba(spark, sf):
    df, model = _tree(spark, sf)
    out = model.transform_proba(df)
    return out.select("o_orderkey", F.inline(F.arrays_zip("leaf_labels", "leaf_proba"))).select(
        "o_orderkey", F.col("leaf_labels").alias("label"), r("leaf_proba").alias("p"))


def tree_rules(spark, sf):
    _, model = _tree(spark, sf)
    return model.rules(spark).select("leaf_id", "rule", F.col("n").cast("bigint").alias("n"), "label")


STOP = StopRules(max_depth=2, min_samples_split=4000, min_gain=0.01)


def tree_stop_rules(spark, sf):
    """Growth limited by depth, node size and gain."""
    _, model = _tree(spark, sf, rules=STOP)
    return _node_view(model, spark)


def cart_classifier(spark, sf):
    """Soft and crisp tree end to end: fit fuzzy sets, hold out rows, train, score."""
    df = holdout(orders_tier(spark, sf), ["o_orderkey"], 0.4, seed=22)
    sets = FuzzySets.fit(df, FEATURES, 5, max_iter=3, tol=-1.0)
    train = df.filter("NOT is_test")
    soft, crisp = fit_soft_and_crisp(train, TreeSpec(FEATURES, ("tier",), fuzzy_sets=sets.sets, rules=TWO_LEVELS))
    scored = df.withColumns({"soft": soft.prediction(), "crisp": crisp.prediction()})
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("soft", "crisp")])
    return scored.select("is_test", "tier", F.inline(pairs)).groupBy("model", "is_test").agg(
        r(metrics.accuracy(F.col("tier"), F.col("p"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _priced(spark, sf):
    """Orders with a real target that depends on price and month."""
    return orders_tier(spark, sf).withColumn("amount", F.expr("o_totalprice / 1000 * (1 + o_month / 24.0D)"))


def cart_regressor(spark, sf):
    df = holdout(_priced(spark, sf), ["o_orderkey"], 0.4, seed=22)
    train = df.filter("NOT is_test")
    soft, crisp = fit_soft_and_crisp(
        train, TreeSpec(FEATURES, ("amount",), "value", fuzzy_sets=set_map(*FEATURES), rules=TWO_LEVELS))
    scored = df.withColumns({"soft": soft.prediction(), "crisp": crisp.prediction()})
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("soft", "crisp")])
    return scored.select("is_test", "amount", F.inline(pairs)).groupBy("model", "is_test").agg(
        r(metrics.mean_squared_error(F.col("amount"), F.col("p")), 4).alias("mse"),
        r(metrics.mean_absolute_error(F.col("amount"), F.col("p"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def _multiway(spark, sf, algo):
    df = orders_discrete(spark, sf)
    nodes = fit_multiway(df, MultiwaySpec(MULTIWAY, "o_orderpriority", algo=algo, max_depth=1)).nodes
    return nodes.select("path", "depth", "feature", r("score", 9).alias("score"), "n", "label")


LINE_FEATURES = ("l_quantity", "l_discount", "l_tax")


def tree_by_subtraction(spark, sf):
    """Four levels over few values: counts are kept, and the larger child's are parent minus sibling."""
    spec = TreeSpec(LINE_FEATURES, ("tier",), rules=StopRules(max_depth=3), subtract_rows=0)
    return fit_tree(lines_tier(spark, sf), spec).nodes(spark).select(
        "node_id", "depth", "is_leaf", "feature", "split_num", r("gain").alias("gain"),
        F.col("n").cast("bigint").alias("n"), "leaf_value")


def tree_full_depth(spark, sf):
    """A tree without any limit of depth, all its nodes in tables: it tells apart whatever the features tell apart."""
    features = ("l_quantity", "l_discount")
    df = read(spark, sf, "lineitem", *features, "l_extendedprice")
    model = fit_table_tree(df, TreeSpec(features, ("l_extendedprice",), "value"), driver_nodes=30)
    n = F.count(F.lit(1))
    return model.transform(df).groupBy(*features).agg(
        n.alias("n"), r(F.min("prediction") * n, 2).alias("lowest"), r(F.max("prediction") * n, 2).alias("highest"))


def id3_tree_level1(spark, sf):
    return _multiway(spark, sf, "id3")


def c45_tree_level1(spark, sf):
    return _multiway(spark, sf, "c45")


def id3_null_text(spark, sf):
    """Missing values and a real text NULL are children of their own; other marks of a path are escaped."""
    orders = read(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    said = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "NULL").when(
        F.col("o_orderpriority") == "5-LOW", "a/b=c%").otherwise(F.col("o_orderpriority"))
    df = read(spark, sf, "customer", "c_custkey", "c_mktsegment").join(
        orders.withColumn("said", said), F.col("c_custkey") == F.col("o_custkey"), "left")
    nodes = fit_multiway(df, MultiwaySpec(("said", "o_orderstatus"), "c_mktsegment", max_depth=0)).nodes
    return nodes.select("path", "depth", "feature", r("score", 9).alias("score"), "n", "label")


def c45_numeric_many_labels(spark, sf):
    """C4.5 on numbers only: the best threshold by gain ratio among hundreds of labels."""
    df = read(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_partkey")
    nodes = fit_multiway(df, MultiwaySpec((), "l_partkey", "c45", max_depth=0, numeric=("l_quantity", "l_extendedprice"))).nodes
    return nodes.filter("depth = 0").select("feature", "threshold", r("score", 9).alias("score"), "n", "label")


QUERIES = {f.__name__: f for f in (
    c45_numeric_many_labels,
    cart_classifier, cart_regressor, tree_nodes_depth1, tree_nodes_soft, tree_nodes_entropy, tree_predict,
    tree_predict_proba, tree_full_depth, tree_by_subtraction, tree_rules, tree_stop_rules, id3_tree_level1, c45_tree_level1, id3_null_text)}


# ---- SQL ----

def orders_base(target: str = "tier", soft: bool = False, where: str = "TRUE", value: bool = False,
                masses: tuple[str, str] | None = None, source: str = "orders_t") -> str:
    y = f"{target} AS t0" if value else f"{target} AS y"
    m0, m1 = masses or (sql_mass("o_totalprice", "o_totalprice"), sql_mass("o_month", "o_month"))
    m = f", {m0} AS m0, {m1} AS m1" if soft else ""
    return (f"SELECT 0 AS model, o_orderkey AS rid, 1.0::DOUBLE AS w, {y}, o_totalprice AS f0, o_month AS f1{m} "
            f"FROM {source} WHERE {where}")


def _names(fi: str) -> str:
    return f"CASE {fi} WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'o_month' END"


def _line_names(fi: str) -> str:
    return f"CASE {fi} WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' WHEN 2 THEN 'l_tax' END"


def _subtraction_sql() -> str:
    tree = TreeSql(3)
    for _ in range(4):
        tree.level()
    tree.leaves()
    base = (f"SELECT 0 AS model, 1.0::DOUBLE AS w, {LINE_TIER} AS y, l_quantity AS f0, l_discount AS f1, l_tax AS f2 FROM lineitem")
    return f"WITH base AS ({base}), {tree.text()} {_nodes_sql(tree, _line_names)}"


def _nodes_sql(tree: TreeSql, _names=_names) -> str:
    n = " + ".join(f"a_c{k}" for k in range(tree.k))
    inner = [f"SELECT node AS node_id, {L} AS depth, FALSE AS is_leaf, {_names('fi')} AS feature, v AS split_num, "
             f"round(gain, 6) AS gain, CAST({n} AS BIGINT) AS n, NULL AS leaf_value FROM {tree.p}_best{L}"
             for L in range(tree.levels)]
    leaf = (f"SELECT node, CAST(floor(log2(node)) AS INTEGER), TRUE, NULL, NULL, NULL, CAST(n AS BIGINT), "
            f"CAST(label AS VARCHAR) FROM {tree.p}_leaf")
    return " UNION ALL ".join([*inner, leaf])


def _orders_tree(levels=2, soft=False, **kw) -> TreeSql:
    tree = TreeSql(2, soft=soft, **kw)
    for _ in range(levels):
        tree.level()
    return tree.leaves()


def _with(tree: TreeSql, body: str, base: str | None = None, prelude: str = "") -> str:
    base = base or orders_base(soft=tree.soft)
    return f"WITH {ORDERS_SQL}{prelude}, base AS ({base}), {tree.text()} {body}"


def _rules_sql() -> str:
    tree = _orders_tree()

    def step(alias: str, passes: str) -> str:
        return (f"CASE WHEN {passes} THEN '' ELSE 'NOT ' END || {_names(f'{alias}.fi')} || ' >= ' || "
                f"CAST({alias}.v AS VARCHAR)")

    rule = (f"{step('a', '(l.node >> CAST(floor(log2(l.node)) - 1 AS INTEGER)) % 2 = 0')} || CASE WHEN b.fi IS NULL THEN '' ELSE "
            f"' AND ' || {step('b', 'l.node % 2 = 0')} END")
    return _with(tree, f"SELECT l.node AS leaf_id, {rule} AS rule, CAST(l.n AS BIGINT) AS n, CAST(label AS VARCHAR) AS label "
                       f"FROM t_leaf l JOIN t_best0 a ON TRUE LEFT JOIN t_best1 b ON b.node = l.node // 2 AND l.node > 3")


def _proba_sql() -> str:
    tree = _orders_tree()
    return _with(tree, "SELECT r.rid AS o_orderkey, p.y AS label, round(p.c / p.n, 6) AS p FROM t_rows2 r JOIN (SELECT node, y, "
                       "count(*) AS c, sum(count(*)) OVER (PARTITION BY node) AS n FROM t_rows2 GROUP BY 1, 2) p USING (node)")


_HELD = (", held AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', o_orderkey, 'holdout', '22'))) <= "
         "ceil(0.4 * count(*) OVER ()) AS is_test FROM {src})")


def _cart_classifier_sql() -> str:
    held = _HELD.replace("{src}", "orders_t")
    ctes, masses = [], []
    for i, f in enumerate(FEATURES):
        ctes += lloyd_sql("orders_t", f, 5, 3, f"k{i}")
        ctes.append(f"w{i} AS (SELECT list(struct_pack(c := c, theta := theta)) AS s FROM ({_theta(f'k{i}', 3)}))")
        masses.append(f"list_sum([greatest(0, 1 - abs({f} - e.c) / e.theta) FOR e IN (SELECT s FROM w{i})])")
    soft, crisp = TreeSql(2, soft=True, prefix="s", base="base_s"), TreeSql(2, prefix="c", base="base_c")
    for t in (soft, crisp):
        t.level().level().leaves()
    src = "SELECT 0 AS model, o_orderkey AS rid, o_totalprice AS f0, o_month AS f1, tier AS y, is_test FROM held"
    soft.route("allrows", "s_all")
    crisp.route("allrows", "c_all")
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS model, is_test, round(avg(CASE WHEN r.y = l.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
        f"count(*) AS n FROM {p}_all r JOIN {p}_leaf l USING (model, node) GROUP BY is_test"
        for n, p in (("soft", "s"), ("crisp", "c")))
    return (f"WITH {ORDERS_SQL}{held}, {', '.join(ctes)}, allrows AS ({src}), base_s AS ("
            f"{orders_base(soft=True, where='NOT is_test', masses=tuple(masses), source='held')}), base_c AS ("
            f"{orders_base(where='NOT is_test', source='held')}), {soft.text()}, {crisp.text()} {parts}")


_AMOUNT = "o_totalprice / 1000 * (1 + o_month / 24.0::DOUBLE)"


def _cart_regressor_sql() -> str:
    held = _HELD.replace("{src}", f"(SELECT *, {_AMOUNT} AS amount FROM orders_t)")
    soft = TreeSql(2, "value", 1, soft=True, prefix="s", base="base_s")
    crisp = TreeSql(2, "value", 1, prefix="c", base="base_c")
    for t in (soft, crisp):
        t.level().level().leaves()
    src = "SELECT 0 AS model, o_orderkey AS rid, o_totalprice AS f0, o_month AS f1, amount, is_test FROM held"
    soft.route("allrows", "s_all")
    crisp.route("allrows", "c_all")
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS model, is_test, round(avg((amount - mean0) * (amount - mean0)), 4) AS mse, "
        f"round(avg(abs(amount - mean0)), 6) AS mae, count(*) AS n "
        f"FROM {p}_all r JOIN {p}_leaf l USING (model, node) GROUP BY is_test" for n, p in (("soft", "s"), ("crisp", "c")))
    base = {s: orders_base("amount", s, "NOT is_test", True, source="held") for s in (True, False)}
    return (f"WITH {ORDERS_SQL}{held}, allrows AS ({src}), base_s AS ({base[True]}), base_c AS ({base[False]}), "
            f"{soft.text()}, {crisp.text()} {parts}")


def _multiway_sql(score: str) -> str:
    """Root and its children: the best feature, then per child value the best remaining feature."""
    d = ("d AS (SELECT o_orderstatus, o_orderpriority AS y, CAST(month(o_orderdate) AS VARCHAR) AS o_month, "
         "CAST(year(o_orderdate) AS VARCHAR) AS o_year FROM orders)")

    def block(p: str, rows: str) -> list[str]:
        union = " UNION ALL ".join(f"SELECT path, used, {i} AS fi, '{f}' AS feature, {f} AS v, y FROM {rows}"
                                   for i, f in enumerate(MULTIWAY))
        return [
            f"{p}_l AS (SELECT * FROM ({union}) WHERE feature IS DISTINCT FROM used)",
            f"{p}_h AS (SELECT path, fi, feature, sum(-p * log2(p)) AS h FROM (SELECT path, fi, feature, count(*) / "
            f"sum(count(*)) OVER (PARTITION BY path, fi) AS p FROM {p}_l GROUP BY path, fi, feature, y) GROUP BY 1, 2, 3)",
            f"{p}_v AS (SELECT path, fi, v, sum(c) AS n, sum(-p * log2(p)) AS h FROM (SELECT *, c / sum(c) OVER (PARTITION BY "
            f"path, fi, v) AS p FROM (SELECT path, fi, v, y, count(*) AS c FROM {p}_l GROUP BY ALL)) GROUP BY 1, 2, 3)",
            f"{p}_s AS (SELECT path, fi, count(*) AS k, sum(s * h) AS inside, sum(-s * log2(s)) AS info FROM (SELECT *, n / "
            f"sum(n) OVER (PARTITION BY path, fi) AS s FROM {p}_v) GROUP BY 1, 2)",
            f"{p}_best AS (SELECT * FROM (SELECT path, feature, {score} AS score, row_number() OVER (PARTITION BY path ORDER BY "
            f"round({score}, 12) DESC, fi) AS rn FROM {p}_s JOIN {p}_h USING (path, fi) WHERE k > 1) WHERE rn = 1 AND score > 1e-7)",
            f"{p}_m AS (SELECT path, arg_min(y, (-c, y)) AS label, sum(c) AS n FROM (SELECT path, y, count(*) AS c FROM {rows} "
            f"GROUP BY 1, 2) GROUP BY 1)",
        ]

    value = "CASE b.feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in MULTIWAY) + " END"
    step = (f"SELECT r.* EXCLUDE (path, used), r.path || '/' || b.feature || '=' || {value} AS path, b.feature AS used "
            f"FROM {{rows}} r JOIN {{p}}_best b USING (path)")
    ctes = [d, "r0 AS (SELECT *, '' AS path, NULL::VARCHAR AS used FROM d)", *block("a", "r0"),
            f"r1 AS ({step.format(rows='r0', p='a')})", *block("b", "r1"), f"r2 AS ({step.format(rows='r1', p='b')})",
            "c_m AS (SELECT path, arg_min(y, (-c, y)) AS label, sum(c) AS n FROM (SELECT path, y, count(*) AS c FROM r2 "
            "GROUP BY 1, 2) GROUP BY 1)"]
    out = " UNION ALL ".join(
        f"SELECT path, {i} AS depth, feature, round(score, 9) AS score, CAST(n AS BIGINT) AS n, label FROM {p}_m LEFT JOIN "
        f"(SELECT path, feature, score FROM {p}_best) USING (path)" for i, p in enumerate("ab"))
    return (f"WITH {', '.join(ctes)} {out} UNION ALL SELECT path, 2, NULL, NULL, CAST(n AS BIGINT), label FROM c_m")


_C45_NUMERIC = """
WITH f AS (SELECT 0 AS fi, 'l_quantity' AS feature, l_quantity AS v, l_partkey AS y FROM lineitem
           UNION ALL SELECT 1, 'l_extendedprice', l_extendedprice, l_partkey FROM lineitem),
c AS (SELECT fi, feature, v, y, count(*)::DOUBLE AS n FROM f GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY fi, y ORDER BY v DESC) AS run, sum(n) OVER (PARTITION BY fi, y) AS total FROM c),
d AS (SELECT *, {x('run')} - {x('run - n')} AS up, {x('total - run')} - {x('total - run + n')} AS down FROM w),
v AS (SELECT fi, feature, v, sum(n) AS n, sum(up) AS up, sum(down) AS down FROM d GROUP BY ALL),
s AS (SELECT fi, feature, v, sum(n) OVER k AS h, sum(up) OVER k AS hs, sum(down) OVER k AS ds, sum(n) OVER (PARTITION BY fi) AS a,
             sum(up) OVER (PARTITION BY fi) AS t FROM v WINDOW k AS (PARTITION BY fi ORDER BY v DESC)),
g AS (SELECT *, (({x('a')} - t) - ({x('h')} - hs) - ({x('a - h')} - (t + ds))) / a AS gain, h / a AS p, (a - h) / a AS q FROM s WHERE a > h),
r AS (SELECT *, gain / (-p * log2(p) - q * log2(q)) AS score FROM g),
m AS (SELECT arg_min(l_partkey, (-n, l_partkey)) AS label, CAST(sum(n) AS BIGINT) AS n FROM
      (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1))
SELECT feature, v AS threshold, round(score, 9) AS score, m.n, label FROM m, (SELECT * FROM r ORDER BY round(score, 12) DESC, fi, v LIMIT 1)"""
for _part in ("run", "run - n", "total - run", "total - run + n", "a", "h", "a - h"):
    _C45_NUMERIC = _C45_NUMERIC.replace("{x('" + _part + "')}", f"(CASE WHEN ({_part}) > 0 THEN ({_part}) * log2({_part}) ELSE 0 END)")

_NULL_TEXT = """
WITH d AS (SELECT c_mktsegment AS y, o_orderstatus, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'NULL'
             WHEN '5-LOW' THEN 'a/b=c%' ELSE o_orderpriority END AS said
           FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
l AS (SELECT 0 AS fi, 'said' AS feature, said AS v, y FROM d UNION ALL SELECT 1, 'o_orderstatus', o_orderstatus, y FROM d),
h AS (SELECT sum(-p * log2(p)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM d GROUP BY y)),
v AS (SELECT fi, feature, v, sum(c) AS n, sum(-c / t * log2(c / t)) AS e FROM
      (SELECT *, sum(c) OVER (PARTITION BY fi, v) AS t FROM (SELECT fi, feature, v, y, count(*) AS c FROM l GROUP BY ALL)) GROUP BY ALL),
g AS (SELECT fi, feature, (SELECT h FROM h) - sum(n * e) / sum(n) AS gain FROM v GROUP BY ALL),
best AS (SELECT * FROM g ORDER BY round(gain, 12) DESC, fi LIMIT 1),
m AS (SELECT v, arg_min(y, (-c, y)) AS label, CAST(sum(c) AS BIGINT) AS n FROM
      (SELECT v, y, count(*) AS c FROM l JOIN best USING (fi) GROUP BY v, y) GROUP BY v)
SELECT '' AS path, 0 AS depth, feature, round(gain, 9) AS score, (SELECT count(*) FROM d) AS n,
       (SELECT arg_min(y, (-c, y)) FROM (SELECT y, count(*) AS c FROM d GROUP BY y)) AS label FROM best
UNION ALL SELECT '/' || feature || coalesce('=' || replace(replace(replace(v, '%', '%25'), '/', '%2F'), '=', '%3D'), '?'),
       1, NULL, NULL, n, label FROM m, best"""

ORACLES = {
    "id3_null_text": _NULL_TEXT,
    "c45_numeric_many_labels": _C45_NUMERIC,
    "cart_classifier": _cart_classifier_sql(),
    "cart_regressor": _cart_regressor_sql(),
    "tree_nodes_depth1": _with(_orders_tree(), _nodes_sql(_orders_tree())),
    "tree_nodes_soft": _with(_orders_tree(soft=True), _nodes_sql(_orders_tree(soft=True))),
    "tree_nodes_entropy": _with(_orders_tree(criterion="entropy"), _nodes_sql(_orders_tree())),
    "tree_predict": _with(_orders_tree(soft=True), "SELECT r.rid AS o_orderkey, l.label AS prediction FROM t_rows2 r "
                                                   "JOIN t_leaf l USING (model, node)"),
    "tree_predict_proba": _proba_sql(),
    "tree_rules": _rules_sql(),
    "tree_by_subtraction": _subtraction_sql(),
    "tree_full_depth": """
        SELECT l_quantity, l_discount, count(*) AS n, round(sum(l_extendedprice), 2) AS lowest,
               round(sum(l_extendedprice), 2) AS highest
        FROM lineitem GROUP BY l_quantity, l_discount""",
    "tree_stop_rules": _with(_orders_tree(3, min_samples=4000, min_gain=0.01), _nodes_sql(_orders_tree(3))),
    "id3_tree_level1": _multiway_sql("(h - inside)"),
    "c45_tree_level1": _multiway_sql("((h - inside) / nullif(info, 0))"),
}
