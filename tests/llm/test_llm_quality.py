"""Isolation forest of the quality rules: path lengths, verdicts, junk that no label shows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from softgrove.llm import quality

SF = "/root/testdata/sf0.01"


def plain_path(nodes, sample, row):
    """Path length by following the row, the sample's rows at its leaf counted one by one."""
    at, depth, there = 0, 0, [tuple(r) for r in sample]
    while nodes[at][0] >= 0:
        f, cut, left, right, _ = nodes[at]
        at, there = (left, [r for r in there if r[f] <= cut]) if row[f] <= cut else (right, [r for r in there if r[f] > cut])
        depth += 1
    n = len(there)
    if n < 2:
        return depth
    return depth + (1 if n == 2 else 2 * (math.log(n - 1) + float(np.euler_gamma)) - 2 * (n - 1) / n)


def as_forest(trees, sample):
    size = max(map(len, trees))

    def table(k, fill, kind):
        return np.array([[n[k] for n in t] + [fill] * (size - len(t)) for t in trees], kind)

    return quality.Forest(table(0, -1, np.int64), table(1, 0.0, float), table(2, 0, np.int64), table(3, 0, np.int64),
                          table(4, 0.0, float), float(quality.average_depth(sample)))


def test_scores_by_plain_paths():
    rng = np.random.default_rng(4)
    x = np.where(rng.random((60, 3)) < 0.7, 0.0, rng.exponential(1.0, (60, 3)))
    x[:, 2] = 0.0  # the whole sample is usual there; cuts on it lie beyond all rows
    trees = [quality.grow(x, rng, 6) for _ in range(15)]
    assert any(n[0] == 2 for t in trees for n in t)
    rows = np.vstack([x, [[0, 0, 50], [7, 0, 0]]])
    got = as_forest(trees, 60).score(rows)
    usual = float(quality.average_depth(60))
    for row, score in zip(rows, got):
        mean = sum(plain_path(t, x, row) for t in trees) / len(trees)
        assert score == pytest.approx(2 ** (-mean / usual))
    assert got[-2] > np.median(got[:-2])


def test_usual_range():
    good = np.array([[100, 500, k % 3, 0, 0, 10, 0, 0, 0] for k in range(300)])
    usual = quality.UsualRange.of(good, 0.005)
    assert (usual.excess(good) == 0).mean() > 0.99
    odd = usual.excess(np.array([[100, 500, 90, 0, 0, 10, 0, 0, 0], [0] * 9]))
    assert odd[0, 0] > 10 and (odd[0, 1:] == 0).all() and np.isfinite(odd).all()
    assert quality.UsualRange.of(np.zeros((0, 9), np.int64), 0.005).excess(good).shape == (300, 9)


def test_junk_of_a_kind_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rng = np.random.default_rng(1)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(n, size):
        return ["".join(rng.choice(list(letters), size)) for _ in range(n)]

    junk = [" ".join(words(80, 60)), "\n".join(words(120, 5)), " ".join(words(100, 5)).upper(), " ".join(words(150, 1)),
            " ".join(str(rng.integers(10**5)) for _ in range(100)), " ".join(w for w in words(60, 5) for _ in range(2)),
            " ".join(f"{w}|#" for w in words(100, 5))]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    rows = quality.assess(odd, model).select("doc_id", "__quality.*").collect()
    assert not any(r["base_failed"] or r["kept"] for r in rows)
    judged = quality.assess(docs, model).join(labels.filter("quality = 1"), "doc_id").filter("NOT __quality.base_failed")
    kept = judged.agg(F.avg(F.col("__quality.kept").cast("double"))).first()[0]
    assert kept >= 1 - quality.MAX_GOOD_LOSS


def test_verdict_by_plain_paths(spark):
    """Scores and verdicts of the job, recomputed from the model row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), trees=5, sample=32)
    forest = model.forest
    for r in quality.assess(docs, model).limit(200).collect():
        c, got = quality.counts(r["text"]), r["__quality"]
        x = np.maximum((quality.statistics(np.array([c]))[0] - model.usual.high) / model.usual.width, 0)
        total = 0.0
        for t in range(5):
            at = 0
            while forest.feature[t][at] >= 0:
                at = (forest.left if x[forest.feature[t][at]] <= forest.cut[t][at] else forest.right)[t][at]
            total += forest.path[t][at]
        score = 2 ** (-total / 5 / forest.usual)
        assert got["score"] == pytest.approx(score)
        assert got["kept"] == (not got["base_failed"] and got["score"] <= model.limit)


def test_the_fit_counts_every_row(spark):
    """Ranges, numbers of rows at the nodes and limit, from all rows of the tables in one process."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, trees=7)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(known.get(r["doc_id"]), quality.counts(r["text"])) for r in docs.collect()]
    rows = [(y, c) for y, c in rows if not quality.base_failed(c[0], c[4])]
    every = np.array([c for _, c in rows])
    good, bad = (every[[k for k, (y, _) in enumerate(rows) if y == label]] for label in (1, 0))
    usual = quality.UsualRange.of(good, quality.MAX_GOOD_LOSS)
    assert np.allclose(model.usual.high, usual.high) and np.allclose(model.usual.width, usual.width)
    x, forest = model.usual.excess(every), model.forest
    assert forest.usual == pytest.approx(float(quality.average_depth(len(x))))
    for t in range(7):
        todo, leaves = [(0, 0, np.arange(len(x)))], 0
        while todo:
            at, depth, here = todo.pop()
            f = forest.feature[t][at]
            if f < 0:
                leaves += 1
                assert forest.path[t][at] == pytest.approx(depth + float(quality.average_depth(len(here))))
                continue
            below = x[here, f] <= forest.cut[t][at]
            todo += [(forest.left[t][at], depth + 1, here[below]), (forest.right[t][at], depth + 1, here[~below])]
        assert leaves > 1
    score = [forest.score(model.usual.excess(c)) for c in (good, bad)]
    assert model.limit == pytest.approx(quality.calibrate(*score, quality.MAX_GOOD_LOSS))


def test_ranges_of_more_than_twenty_thousand_labels(spark):
    n = 20_500
    words = " ".join(f"w{k}" for k in range(10, 40))
    docs = spark.range(n).selectExpr("id AS doc_id", f"concat('{words}', repeat('x', cast(id AS int))) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    model = quality.fit(docs, labels, trees=2)
    wanted = np.quantile([(90 + k) / 30 for k in range(n)], 1 - quality.MAX_GOOD_LOSS / 9)
    assert model.usual.high[quality.STATISTICS.index("long_words")] == pytest.approx(wanted)


@pytest.mark.parametrize("seed", range(4))
def test_limit_by_plain_calibration(spark, monkeypatch, seed):
    monkeypatch.setattr(quality, "SCORE_RANGES", 5)
    rng = np.random.default_rng(seed)
    good, bad = rng.integers(0, 60, 300) / 100, rng.integers(0, 100, 200) / 100
    rows = spark.createDataFrame([(True, float(s)) for s in good] + [(False, float(s)) for s in bad], "good boolean, score double")
    assert quality.best_limit(rows, 0.1) == pytest.approx(quality.calibrate(good, bad, 0.1))
    assert quality.best_limit(rows.filter("good"), 0.1) == math.inf
