"""Scaling, fuzzification and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from softgrove.catalog.common import CENTROIDS, r, read, set_map, sql_memberships, sql_mass
from softgrove.functions import encode as E
from softgrove.functions.membership import logit_slope, membership_array, membership_mass
from softgrove.operators.clusters import optimal_clusters
from softgrove.operators.fuzzify import FuzzySets, theta_table
from softgrove.operators.prepare import encode_first_seen, global_minmax_scale

FIT = ("l_quantity", "l_extendedprice", "l_discount")
N_SETS, STEPS = 4, 3


def _orders(spark, sf):
    return read(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate").withColumn(
        "o_month", F.month("o_orderdate").cast("double")).drop("o_orderdate")


def scale_global_minmax(spark, sf):
    df = global_minmax_scale(_orders(spark, sf), ["o_totalprice", "o_month"])
    return df.select("o_orderkey", r("o_totalprice", 9).alias("o_totalprice"), r("o_month", 9).alias("o_month"))


def _fit(spark, sf) -> FuzzySets:
    """A fixed number of k-means steps, so that SQL can repeat them."""
    return FuzzySets.fit(read(spark, sf, "lineitem", *FIT), FIT, N_SETS, max_iter=STEPS, tol=-1.0)


def fuzzy_centroids(spark, sf):
    return _fit(spark, sf).table(spark).select("feature", "set_id", r("centroid").alias("centroid"))


OPTIMAL = ("l_quantity", "l_discount", "l_tax")


def fuzzy_optimal(spark, sf):
    """The best of all ways to cut a feature's values into three sets."""
    df = read(spark, sf, "lineitem", *OPTIMAL)
    names = F.array(*[F.lit(f) for f in OPTIMAL])
    return optimal_clusters(df, OPTIMAL, 3).select(
        F.get(names, F.col("fi")).alias("feature"), r("sse", 4).alias("sse"),
        F.posexplode("centroids").alias("set_id", "c")).select("feature", "sse", "set_id", r("c").alias("centroid"))


def fuzzy_theta(spark, sf):
    return theta_table(_fit(spark, sf).table(spark).drop("theta")).select("feature", "set_id", r("theta").alias("theta"))


def _spread(df, key, array, names):
    return df.select(key, *[r(F.get(array, F.lit(i))).alias(n) for i, n in enumerate(names)])


DMS = [f"dm{j}" for j in range(5)]


def fuzzy_membership(spark, sf):
    sets = set_map("o_totalprice")["o_totalprice"]
    df = _orders(spark, sf).withColumn("dm", membership_array("o_totalprice", sets)).withColumn(
        "m", r(membership_mass("o_totalprice", sets)))
    return df.select("o_orderkey", *[r(F.get("dm", F.lit(i))).alias(n) for i, n in enumerate(DMS)], "m")


def fuzzy_membership_logit(spark, sf):
    sets = set_map("o_totalprice")["o_totalprice"]
    df = _orders(spark, sf).withColumn("dm", membership_array("o_totalprice", sets, logit_slope(0.8)))
    return _spread(df, "o_orderkey", "dm", DMS)


PART = ("p_size", "p_retailprice")


def _fit_part(spark, sf):
    df = read(spark, sf, "part", "p_partkey", *PART)
    return df, FuzzySets.fit(df, PART, 3, max_iter=STEPS, tol=-1.0)


def fuzzify_wide(spark, sf):
    """Fit and transform end to end: all memberships beside the key."""
    df, sets = _fit_part(spark, sf)
    out = sets.transform(df)
    return out.select("p_partkey", *[r(F.get(f"dm_{f}", F.lit(j))).alias(f"dm_{f}_{j}") for f in PART for j in range(3)],
                      *[r(f"m_{f}").alias(f"m_{f}") for f in PART])


def fuzzify_long(spark, sf):
    df, sets = _fit_part(spark, sf)
    out = sets.transform(df)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"dm_{f}").alias("dm")) for f in PART])
    return out.select("p_partkey", F.inline(pairs)).select(
        "p_partkey", "feature", F.posexplode("dm").alias("set_id", "v")).select(
        "p_partkey", "feature", "set_id", r("v").alias("membership"))


def one_hot(spark, sf):
    df = read(spark, sf, "embeddings", "vec_id", "label")
    width = df.agg((F.max("label") + 1).alias("w")).first()["w"]
    return df.select("vec_id", F.posexplode(E.one_hot(F.col("label"), width)).alias("k", "hot"))


def argmax_decode(spark, sf):
    return read(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", E.argmax_decode(F.col("embedding")).alias("top"))


def score_softmax(spark, sf):
    scores = F.array(F.col("o_totalprice") / 100000, F.col("o_month") / 4, F.lit(1.0))
    return _orders(spark, sf).select("o_orderkey", F.posexplode(E.softmax(scores)).alias("k", "p")).select(
        "o_orderkey", "k", r("p").alias("p"))


def score_sigmoid(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey", r(E.sigmoid((F.col("o_totalprice") - 200000) / 100000)).alias("p"))


# Fixed value: codes of the recoding query.
STATUS = {"F": 0, "O": 1, "P": 2}


def src_union_recode(spark, sf):
    """Union of two sources with a recoded label and cast numbers."""
    left = read(spark, sf, "orders", "o_orderkey", "o_orderstatus").select(
        F.col("o_orderkey").alias("id"), F.lit("orders").alias("source"),
        E.recode(F.col("o_orderstatus"), STATUS).alias("label"))
    right = read(spark, sf, "lineitem", "l_orderkey", "l_linestatus").select(
        F.col("l_orderkey").alias("id"), F.lit("lines").alias("source"),
        E.recode(F.col("l_linestatus"), STATUS).alias("label"))
    return left.unionByName(right).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def src_dropna(spark, sf):
    """Join that leaves gaps, then rows with missing values dropped."""
    docs = read(spark, sf, "documents", "doc_id", "lang", "n_chars")
    labels = read(spark, sf, "labels", "doc_id", "quality")
    return docs.join(labels, "doc_id", "left").na.drop()


def encode_first(spark, sf):
    df = read(spark, sf, "part", "p_partkey", "p_brand", "p_type")
    return encode_first_seen(df, ["p_brand", "p_type"], "p_partkey")


def label_shift(spark, sf):
    return read(spark, sf, "embeddings", "vec_id", "label").select("vec_id", E.shift_label(F.col("label")).alias("shifted"))


QUERIES = {f.__name__: f for f in (
    scale_global_minmax, fuzzy_centroids, fuzzy_optimal, fuzzy_theta, fuzzy_membership, fuzzy_membership_logit, fuzzify_wide,
    fuzzify_long, one_hot, argmax_decode, score_softmax, score_sigmoid, src_union_recode, src_dropna, label_shift)}
QUERIES["encode_first_seen"] = encode_first


# ---- SQL ----

def lloyd_sql(table: str, feature: str, k: int, steps: int, p: str) -> list[str]:
    """CTEs ``<p>_c<steps>(set_id, c)``: evenly spaced start, then assign and average."""
    out = [f"{p}_c0 AS (SELECT j AS set_id, lo + (j + 0.5) / {k} * (hi - lo) AS c FROM (SELECT min({feature})::DOUBLE AS lo, "
           f"max({feature})::DOUBLE AS hi FROM {table}), range({k}) t(j))"]
    for i in range(steps):
        cs = [f"(SELECT c FROM {p}_c{i} WHERE set_id = {j})" for j in range(k)]
        below = " + ".join(f"CASE WHEN x > m{j} THEN 1 ELSE 0 END" for j in range(k - 1))
        mids = ", ".join(f"({a} + {b}) / 2.0 AS m{j}" for j, (a, b) in enumerate(zip(cs, cs[1:])))
        out += [f"{p}_m{i} AS (SELECT {mids})",
                f"{p}_a{i} AS (SELECT {below} AS set_id, avg(x) AS c FROM (SELECT {feature}::DOUBLE AS x FROM {table}), "
                f"{p}_m{i} GROUP BY 1)",
                f"{p}_c{i + 1} AS (SELECT o.set_id, coalesce(n.c, o.c) AS c FROM {p}_c{i} o LEFT JOIN {p}_a{i} n USING (set_id))"]
    return out


def _theta(p: str, steps: int) -> str:
    return (f"SELECT a.set_id, a.c, min(CASE WHEN abs(a.c - b.c) = 0 THEN 9999.0 ELSE abs(a.c - b.c) END) AS theta "
            f"FROM {p}_c{steps} a, {p}_c{steps} b GROUP BY 1, 2")


def _fitted(column: str, from_theta: bool) -> str:
    ctes, parts = [], []
    for i, f in enumerate(FIT):
        ctes += lloyd_sql("lineitem", f, N_SETS, STEPS, f"f{i}")
        src = f"({_theta(f'f{i}', STEPS)})" if from_theta else f"f{i}_c{STEPS}"
        parts.append(f"SELECT '{f}' AS feature, CAST(set_id AS INTEGER) AS set_id, {column} FROM {src}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def _part_long() -> str:
    ctes = [c for i, f in enumerate(PART) for c in lloyd_sql("part", f, 3, STEPS, f"f{i}")]
    rows = " UNION ALL ".join(
        f"SELECT p_partkey, '{f}' AS feature, CAST(set_id AS INTEGER) AS set_id, greatest(0, 1 - abs({f} - c) / theta) AS dm "
        f"FROM part, ({_theta(f'f{i}', STEPS)})" for i, f in enumerate(PART))
    return f"WITH {', '.join(ctes)}, long AS ({rows})"


_T = "CAST(month(o_orderdate) AS DOUBLE)"
_WIDE = ", ".join([f"round(max(dm) FILTER (feature = '{f}' AND set_id = {j}), 6) AS dm_{f}_{j}" for f in PART for j in range(3)]
                  + [f"round(sum(dm) FILTER (feature = '{f}'), 6) AS m_{f}" for f in PART])
_LOGIT = [f"greatest(0.0, 1.0 - abs(o_totalprice - {c!r}) / t{i} * (ln(0.8) - ln(0.2)))"
          for i, c in enumerate(CENTROIDS["o_totalprice"])]
_WIDTHS = "(VALUES (9999.0, 9999.0, 9999.0, 9999.0, 9999.0)) w(t0, t1, t2, t3, t4)"

def _optimal_sql() -> str:
    """All pairs of cuts between the distinct values, each with the squares left in its three parts."""
    union = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v FROM lineitem" for f in OPTIMAL)

    def left(a: str, b: str) -> str:
        n, s, q = (f"({b}.{x} - {a}.{x})" for x in ("n", "s", "q"))
        return f"({q} - {s} * {s} / {n})"

    def mean(a: str, b: str) -> str:
        return f"({b}.s - {a}.s) / ({b}.n - {a}.n) + {b}.m"

    return f"""
WITH f AS ({union}), m AS (SELECT feature, avg(v) AS m FROM f GROUP BY 1),
c AS (SELECT feature, v, m, count(*)::DOUBLE AS n, sum(v - m) AS s, sum((v - m) * (v - m)) AS q FROM f JOIN m USING (feature) GROUP BY ALL),
p AS (SELECT feature, m, row_number() OVER w AS k, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM c
      WINDOW w AS (PARTITION BY feature ORDER BY v)),
z AS (SELECT feature, any_value(m) AS m, 0 AS k, 0.0::DOUBLE AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q FROM p GROUP BY 1),
t AS (SELECT p.* FROM p WHERE (feature, k) IN (SELECT (feature, max(k)) FROM p GROUP BY feature)),
tried AS (SELECT z.feature, {left('z', 'a')} + {left('a', 'b')} + {left('b', 't')} AS sse, a.k AS ka, b.k AS kb,
                 [{mean('z', 'a')}, {mean('a', 'b')}, {mean('b', 't')}] AS c
          FROM z JOIN p a USING (feature) JOIN p b ON b.feature = a.feature AND b.k > a.k JOIN t ON t.feature = a.feature AND t.k > b.k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(sse, 6), kb, ka) AS rn FROM tried) WHERE rn = 1)
SELECT feature, round(sse, 4) AS sse, CAST(j AS INTEGER) AS set_id, round(c[j + 1], 6) AS centroid FROM best, range(3) x(j)"""


ORACLES = {
    "fuzzy_optimal": _optimal_sql(),
    "scale_global_minmax": f"WITH o AS (SELECT o_orderkey, o_totalprice, {_T} AS o_month FROM orders), b AS (SELECT "
                           f"least(min(o_totalprice), min(o_month)) AS lo, greatest(max(o_totalprice), max(o_month)) AS hi FROM o) "
                           f"SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 9) AS o_totalprice, "
                           f"round((o_month - lo) / (hi - lo), 9) AS o_month FROM o, b",
    "fuzzy_centroids": _fitted("round(c, 6) AS centroid", False),
    "fuzzy_theta": _fitted("round(theta, 6) AS theta", True),
    "fuzzy_membership": "SELECT o_orderkey, " + ", ".join(
        f"round({e}, 6) AS dm{j}" for j, e in enumerate(sql_memberships("o_totalprice", "o_totalprice")))
    + f", round({sql_mass('o_totalprice', 'o_totalprice')}, 6) AS m FROM orders",
    "fuzzy_membership_logit": "SELECT o_orderkey, " + ", ".join(f"round({e}, 6) AS dm{j}" for j, e in enumerate(_LOGIT))
    + f" FROM orders, {_WIDTHS}",
    "fuzzify_wide": f"{_part_long()} SELECT p_partkey, {_WIDE} FROM long GROUP BY 1",
    "fuzzify_long": f"{_part_long()} SELECT p_partkey, feature, set_id, round(dm, 6) AS membership FROM long",
    "one_hot": "SELECT vec_id, CAST(k AS INTEGER) AS k, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot "
               "FROM embeddings, range((SELECT max(label) + 1 FROM embeddings)) t(k)",
    "argmax_decode": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings",
    "score_softmax": f"WITH s AS (SELECT o_orderkey, exp(o_totalprice / 100000) AS a, exp({_T} / 4) AS b, exp(1.0::DOUBLE) AS c "
                     f"FROM orders) SELECT o_orderkey, k, round(CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c), 6) "
                     f"AS p FROM s, (VALUES (0), (1), (2)) t(k)",
    "score_sigmoid": "SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 200000) / 100000)), 6) AS p FROM orders",
    "src_union_recode": "SELECT source, CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS label, count(*) AS n, "
                        "CAST(sum(id) AS BIGINT) AS ids FROM (SELECT o_orderkey AS id, 'orders' AS source, o_orderstatus AS s "
                        "FROM orders UNION ALL SELECT l_orderkey, 'lines', l_linestatus FROM lineitem) GROUP BY 1, 2",
    "src_dropna": "SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND "
                  "n_chars IS NOT NULL AND quality IS NOT NULL",
    "label_shift": "SELECT vec_id, label - 1 AS shifted FROM embeddings",
    "encode_first_seen": "WITH b AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS k FROM "
                         "part GROUP BY 1), t AS (SELECT p_type, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) "
                         "AS k FROM part GROUP BY 1) SELECT p_partkey, b.k AS p_brand, t.k AS p_type FROM part JOIN b USING "
                         "(p_brand) JOIN t USING (p_type)",
}
