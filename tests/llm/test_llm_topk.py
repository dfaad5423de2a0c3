"""Top-k search against plain integer inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from softgrove.llm import topk_search


def plain(rows, k, every=50, scale=256):
    """rows: (id or None, vector or None)"""
    good = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for a, (qid, q) in enumerate(good):
        if qid is None or qid % every:
            continue
        found = sorted((-int(q @ v), i is None, i or 0, i) for b, (i, v) in enumerate(good) if b != a)
        out += [(qid, r + 1, i, -s) for r, (s, _, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k=5, parts=3, schema="vec_id long, embedding array<float>", **how):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    got = topk_search.top_k(df, F.col("id") % 50 == 0, k, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("block_rows", [64, 16_384])
def test_random_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    vectors = (centres[rng.integers(0, 8, 700)] + rng.normal(size=(700, 24))) * 0.2
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    assert searched(spark, rows, block_rows=block_rows, group_rows=5) == plain(rows, 5)


def test_ties_repeats_and_bad_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [0.25, -0.5, 0.75]) for i in range(40, 160)]  # one hot vector
    rows += [(50, [0.25, -0.5, 0.75]), (None, [0.25, -0.5, 0.75]), (None, [9.0, -9.0, 9.0]), (200, None), (250, []), (300, [inf, 1.0, 1.0]),
             (350, [1.0, nan, 1.0]), (400, [1.0, None, 1.0]), (450, [0.5]), (0, [-0.25, 0.5, -0.75]), (1, [0.0, 0.0, 0.0])]
    assert searched(spark, rows, block_rows=16, group_rows=2) == plain(rows, 5)
    assert searched(spark, rows, k=500) == plain(rows, 500)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=40) * 60_000).tolist()) for i in range(120)]
    assert searched(spark, rows, schema="vec_id long, embedding array<double>", scale=300) == plain(rows, 5, scale=300)


def test_few_rows_and_clashing_columns(spark):
    assert searched(spark, [(50, [1.0])]) == []
    assert searched(spark, [(3, [1.0]), (4, [1.0])]) == []
    assert searched(spark, [(50, [1.0]), (3, [0.5])]) == [(50, 1, 3, 256 * 128)]
    assert searched(spark, []) == []
    names = "rid long, id long, vector long, block long, rank long, score long, lane long, query_id long"
    df = spark.createDataFrame([(i, [float(i)], *range(8)) for i in (0, 1, 50)], f"vec_id long, embedding array<float>, {names}")
    assert topk_search.top_k(df, F.col("id") % 50 == 0).count() == 4


def test_rounds_end_on_proof_only():
    """Every vector that is left out scores below the k-th best of those found."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-90, 90, (4000, 64)).astype(np.int32)
    parts = topk_search.indexed(vectors, 32)
    block = topk_search.Block(vectors, parts["postings"], parts["bounds"], parts["high"], parts["low"])
    left = []
    for q in vectors[:40]:
        members, scores = block.possible(q, 5, -np.inf)
        plain_scores = vectors.astype(np.int64) @ q
        assert (plain_scores[members] == scores).all()
        assert sorted(plain_scores)[-5:] == sorted(scores)[-5:]
        left.append(len(members))
    assert np.median(left) < 400
