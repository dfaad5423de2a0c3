"""Quality rules: an isolation forest on rule statistics.

Every document gets counts (words, symbols, repeated lines, words in repeated
windows, ...) in one pass over its whole text. Two fixed rules reject first.
The rest is judged by an isolation forest on nine statistics, each as its excess
over the usual range: that of the labelled good rows but for a tail, the tails
of all statistics together holding ``max_good_loss`` of them. So ordinary
variety is no anomaly, and what is ordinary comes from the labelled rows.
The fewer random splits isolate a document, the more anomalous it is. Splits are
drawn, evenly on a logarithmic scale, from all excesses that there can be, so a
document that is far off in a statistic in which all others are usual is isolated
early too. Length in words is not judged: a long clean document is usual.

The limit on the anomaly score is calibrated on labelled rows: of the limits
that reject at most ``max_good_loss`` of the good rows it is the one that best
separates them from the bad ones; without rows of both kinds nothing more is
rejected.

The fit covers all rows. Ranges are exact quantiles of all labelled good rows,
every tree counts every row of the table that passes the fixed rules at its
nodes, and the limit follows from the scores of all labelled rows. Trees have
ceil(log2(``sample``)) levels, the height that the published method gives trees
of that many rows; rows that are still together there count by the mean path
length of as many. Only the trees (``trees`` times twice ``sample`` nodes) are on
the driver. Scoring covers every row in a pass without shuffle or join.

Null text has no words and fails. Rows that repeat an id are judged alike; an
id labelled twice counts as bad if one label does. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches, written
from softgrove.operators.quantiles import exact_quantiles

TREES = 100
SAMPLE = 256
MAX_GOOD_LOSS = 0.005
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_digits",
          "n_same_next")
#: What the forest sees; "few" and "short" mean that small values are the unusual ones.
STATISTICS = ("symbols_per_word", "same_next_share", "caps_share", "dup_line_share", "digit_share", "repeat_share",
              "long_words", "short_words", "few_words_a_line")
#: Least width of a usual range, and the largest excess, both in units that shares and lengths have.
LEAST_WIDTH = 0.02
MOST_EXCESS = 50.0
#: Ranges of scores in which running sums are taken apart.
SCORE_RANGES = 1 << 16

SYMBOLS = b"#*$%&|<>"
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\v\f\r"
CONTINUATION = bytes(range(128, 192))
#: odd 64-bit multipliers, one per place in a window
MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)

    def n_of(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    repeated = 0
    if n > WINDOW:
        size = n - WINDOW + 1
        key = np.zeros(size, np.uint64)
        for k in range(WINDOW):
            key += (ids[k:k + size] + np.uint64(1)) * MULTIPLIERS[k]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(size, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.flatnonzero(twice), 1)
            np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same_next = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    return (n, len(raw) - n_of(CONTINUATION) - n_of(SPACE), n_of(SYMBOLS), len(lines) - len(set(lines)), repeated,
            len(lines), sum(len(w) > 1 and w.isupper() for w in words), n_of(DIGITS), same_next)


def statistics(c: np.ndarray) -> np.ndarray:
    """STATISTICS (columns) from COUNTS (columns)."""
    n, chars, symbols, dup, repeated, lines, caps, digits, same_next = c.astype(float).T
    words, some_lines = np.maximum(n, 1), np.maximum(lines, 1)
    return np.column_stack([symbols / words, same_next / words, caps / words, dup / some_lines, digits / np.maximum(chars, 1),
                            repeated / words, chars / words, -chars / words, -np.log(words / some_lines)])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(c: pa.Array) -> pa.Array:
    """STATISTICS of arrays of COUNTS."""
    x = statistics(c.flatten().to_numpy().reshape(-1, len(COUNTS)))
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


@dataclass(frozen=True)
class UsualRange:
    """Upper end and width (from the median) of the usual range of every statistic."""

    high: np.ndarray
    width: np.ndarray

    @staticmethod
    def of(good: np.ndarray, max_good_loss: float) -> UsualRange:
        """From COUNTS of good rows; without any, nothing is usual."""
        x = statistics(good)
        return UsualRange.between(*np.quantile(x, [0.5, 1 - max_good_loss / len(STATISTICS)], axis=0) if len(x) else ())

    @staticmethod
    def of_rows(good: DataFrame, max_good_loss: float) -> UsualRange:
        """The same from rows with COUNTS in a table."""
        values = F.posexplode(_statistics(F.array(*COUNTS))).alias("statistic", "value")
        found = exact_quantiles(good.select(values), ["statistic"], "value",
                                {"middle": 0.5, "high": 1 - max_good_loss / len(STATISTICS)})
        found = sorted((r["statistic"], r["middle"], r["high"]) for r in found.collect())  # a row per statistic
        return UsualRange.between(*np.array(found).T[1:] if found else ())

    @staticmethod
    def between(middle: np.ndarray | None = None, high: np.ndarray | None = None) -> UsualRange:
        if high is None:
            return UsualRange(np.full(len(STATISTICS), -MOST_EXCESS), np.ones(len(STATISTICS)))
        return UsualRange(high, np.maximum(high - middle, LEAST_WIDTH))

    def excess(self, c: np.ndarray) -> np.ndarray:
        """How many widths the statistics of COUNTS lie above their ranges; 0 inside."""
        return np.clip((statistics(c) - self.high) / self.width, 0, MOST_EXCESS)


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def average_depth(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draw(features: int, rng: np.random.Generator, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and split value of the inner nodes of a random tree; below node k are 2k + 1 (up to the value) and 2k + 2.

    Split values come from the box of the node, not from its rows: at the root from 0 to the most excess there is.
    """
    inner = (1 << levels) - 1
    feature, cut = rng.integers(features, size=inner), np.zeros(inner)
    low, high = np.zeros((2 * inner + 1, features)), np.full((2 * inner + 1, features), math.log1p(MOST_EXCESS))
    for k, (f, u) in enumerate(zip(feature, rng.random(inner))):
        middle = low[k, f] + u * (high[k, f] - low[k, f])
        cut[k] = math.expm1(middle)
        for below in (2 * k + 1, 2 * k + 2):
            low[below], high[below] = low[k], high[k]
        high[2 * k + 1, f] = low[2 * k + 2, f] = middle
    return feature, cut


def leaf_rows(feature: np.ndarray, cut: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of x at the leaves (tree x leaf) of drawn trees (tree x inner node)."""
    n_trees, inner = feature.shape
    x, n = np.unique(x, axis=0, return_counts=True)  # most rows have no excess
    tree, row = np.arange(n_trees)[:, None], np.arange(len(x))
    at = np.zeros((n_trees, len(x)), np.int64)
    for _ in range((inner + 1).bit_length() - 1):
        at = 2 * at + 1 + (x[row, feature[tree, at]] > cut[tree, at])
    at += tree * (inner + 1) - inner
    return np.bincount(at.ravel(), np.tile(n, n_trees), n_trees * (inner + 1)).astype(np.int64).reshape(n_trees, -1)


def settle(feature: np.ndarray, cut: np.ndarray, rows: np.ndarray, usual: float) -> Forest:
    """The forest of drawn trees with so many rows at their leaves; a node with fewer than two rows is a leaf."""
    n_trees, inner = feature.shape
    held = np.concatenate([np.zeros((n_trees, inner), np.int64), rows], axis=1)
    for k in range(inner - 1, -1, -1):
        held[:, k] = held[:, 2 * k + 1] + held[:, 2 * k + 2]
    number = np.arange(2 * inner + 1)
    depth = np.floor(np.log2(number + 1))
    split = (held >= 2) & (number < inner)
    pad = ((0, 0), (0, inner + 1))
    below = np.where(split, 2 * number + 1, 0)
    return Forest(np.where(split, np.pad(feature, pad), -1), np.where(split, np.pad(cut, pad), 0.0), below,
                  np.where(split, below + 1, 0), np.where(split, 0.0, depth + average_depth(held)), usual)


def grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple[int, float, int, int, float]]:
    """One tree of the rows of x: feature (-1 at a leaf), split value, left, right, path length at a leaf of its nodes."""
    feature, cut = (v[None] for v in draw(x.shape[1], rng, max_depth))
    tree = settle(feature, cut, leaf_rows(feature, cut, x), 1.0)
    return [(int(f), float(c), int(i), int(j), float(p)) for f, c, i, j, p in
            zip(tree.feature[0], tree.cut[0], tree.left[0], tree.right[0], tree.path[0])]


@dataclass(frozen=True)
class Forest:
    """Trees as padded arrays (tree x node); a few hundred kilobytes at any size of the input."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1]: two to the power of minus the mean path length over the usual one."""
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        x, own = np.unique(x, axis=0, return_inverse=True)  # most rows have no excess
        tree = np.arange(len(self.feature))[:, None]
        at = np.zeros((len(self.feature), len(x)), np.int64)
        row = np.arange(len(x))
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                break
            below = x[row, np.maximum(f, 0)] <= self.cut[tree, at]
            at = np.where(inner, np.where(below, self.left[tree, at], self.right[tree, at]), at)
        return (2.0 ** (-self.path[tree, at].mean(0) / max(self.usual, 1e-9)))[own.ravel()]


@dataclass(frozen=True)
class QualityModel:
    forest: Forest
    usual: UsualRange
    limit: float


def judge(model: QualityModel | None = None):
    """Column function: text -> struct of COUNTS, base_failed, score, kept."""
    fields = [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_()), ("score", pa.float64()),
                                                  ("kept", pa.bool_())]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]
                          + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
                             T.StructField("kept", T.BooleanType())])

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        c = np.array([counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
        failed = base_failed(c[:, 0], c[:, 4])
        score = model.forest.score(model.usual.excess(c)) if model else np.zeros(len(c))
        kept = ~failed & (score <= (model.limit if model else math.inf))
        values = [*c.T, failed, score, kept]
        return pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, fields)],
                                          fields=[pa.field(n, k) for n, k in fields])

    return run


def calibrate(good: np.ndarray, bad: np.ndarray, max_good_loss: float) -> float:
    """The limit on the score that rejects most bad rows less good ones, within the allowed loss of good ones."""
    if not len(good) or not len(bad):
        return math.inf
    limits = np.unique(np.concatenate([good, bad]))
    lost = len(good) - np.searchsorted(np.sort(good), limits, "right")
    caught = len(bad) - np.searchsorted(np.sort(bad), limits, "right")
    allowed = lost <= max_good_loss * len(good)
    best = int(np.flatnonzero(allowed)[np.argmax((caught * len(good) - lost * len(bad))[allowed])])
    if caught[best] <= 0:
        return math.inf
    above = limits[best + 1:best + 2]
    return float((limits[best] + above[0]) / 2) if len(above) else float(limits[best])


def best_limit(scored: DataFrame, max_good_loss: float) -> float:
    """``calibrate`` for a table of good (boolean) and score; equal scores are one row, summed up range by range."""
    kinds = [F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")]
    counted = written(scored.groupBy("score").agg(*kinds).withColumn("range", F.floor(F.col("score") * SCORE_RANGES)),
                      "quality-scores")
    n_good, n_bad = counted.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n_good or not n_bad:
        return math.inf

    def above(kind: str, window) -> Column:
        return F.coalesce(F.sum(kind).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    down = Window.orderBy(F.desc("range"))  # at most SCORE_RANGES rows
    ranges = counted.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ranges = ranges.select("range", above("good", down).alias("more_good"), above("bad", down).alias("more_bad"))
    inside = Window.partitionBy("range").orderBy(F.desc("score"))
    limits = counted.join(ranges, "range").select("score", (above("good", inside) + F.col("more_good")).alias("lost"),
                                                  (above("bad", inside) + F.col("more_bad")).alias("caught"))
    gain = F.col("caught") * n_good - F.col("lost") * n_bad
    best = limits.filter(F.col("lost") <= max_good_loss * n_good).agg(
        F.max(F.struct(gain, -F.col("score"), "caught")).alias("best")).select("best.*").first()
    if not best[2]:
        return math.inf
    limit = -best[1]
    nearest = counted.filter(F.col("score") > limit).agg(F.min("score")).first()[0]
    return limit if nearest is None else (limit + nearest) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        trees: int = TREES, sample: int = SAMPLE, max_good_loss: float = MAX_GOOD_LOSS, seed: int = 0) -> QualityModel:
    """Ranges, forest and limit from all rows; ``labels`` has the id and 1 for a good, 0 for a bad document."""
    small_batches(docs.sparkSession)
    known = labels.select(labels["doc_id"].alias("id"), (labels[label_col] > 0).alias("good"))
    known = known.filter("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"))
    rows = docs.select(docs[id_col].alias("id"), judge()(docs[text_col]).alias("s")).select("id", "s.base_failed", *[f"s.{c}" for c in COUNTS])
    rows = written(rows, "quality-counts").filter("NOT base_failed").drop("base_failed")
    held = written(rows.join(known, "id").select("good", *COUNTS), "quality-labelled")
    usual = UsualRange.of_rows(held.filter("good"), max_good_loss)
    drawn = [draw(len(STATISTICS), np.random.default_rng((seed, k)), math.ceil(math.log2(max(2, sample))))
             for k in range(trees)]
    feature, cut = np.array([f for f, _ in drawn]), np.array([c for _, c in drawn])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0
        for batch in batches:
            c = np.column_stack([batch.column(name).to_numpy() for name in COUNTS])
            found = found + leaf_rows(feature, cut, usual.excess(c))
        tree, leaf = np.nonzero(found) if np.ndim(found) else (np.zeros(0, int), np.zeros(0, int))
        n = found[tree, leaf] if len(tree) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(n, pa.int64())],
                                         names=["tree", "leaf", "n"])

    counted = rows.select(*COUNTS).mapInArrow(count, "tree int, leaf int, n long")
    counted = counted.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()  # at most a row per leaf of the trees
    at_leaves = np.zeros((trees, feature.shape[1] + 1), np.int64)
    for r in counted:
        at_leaves[r["tree"], r["leaf"]] = r["n"]
    forest = settle(feature, cut, at_leaves, float(average_depth(at_leaves[0].sum())))

    @F.arrow_udf(T.DoubleType())
    def score(c: pa.Array) -> pa.Array:
        return pa.array(forest.score(usual.excess(c.flatten().to_numpy().reshape(-1, len(COUNTS)))))

    scored = held.select("good", score(F.array(*COUNTS)).alias("score"))
    return QualityModel(forest, usual, best_limit(scored, max_good_loss))


def assess(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``__quality``: counts, base_failed, score and kept."""
    small_batches(docs.sparkSession)
    return docs.withColumn("__quality", judge(model)(docs[text_col]))
