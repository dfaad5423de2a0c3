"""Whitening against a dense eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from softgrove.llm import whitening as wh

SF001 = "/root/testdata/sf0.001"


def plain(rows, components=16):
    """(id, vector) -> x of usable rows, n, S, falling variances, vectors, trace."""
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in good), default=0)
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v) + (1_000_000,) * (dims - len(v))) for i, v in good]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    cov = away.T @ away / n
    values, vectors = np.linalg.eigh(cov)
    return xs, n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], np.trace(cov)


def check(out, rows, close=1e-7):
    xs, n, sums, values, vectors, trace = plain(rows)
    width = len(values)
    got = {}
    for r in out:
        got.setdefault(r["component"], []).append(r)
    assert sorted(got) == list(range(1, width + 1))
    deviation = {(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in xs}
    by_id = sorted(xs, key=str)
    away = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for _, x in by_id])
    for k in range(width):
        mine = sorted(got[k + 1], key=lambda r: (str(r["vec_id"]), r["deviation"]))
        assert len(mine) == len(xs) and {(r["vec_id"], r["deviation"]) for r in mine} == deviation
        assert all(r["n"] == n for r in mine)
        explained = values[k] / trace if trace > 0 else 0.0
        assert mine[0]["explained"] == pytest.approx(explained, rel=1e-9, abs=1e-12)
        want = away @ vectors[:, k] / np.sqrt(values[k]) if values[k] > 1e-9 * trace else np.zeros(len(xs))
        have = np.array([r["whitened"] for r in mine])
        order = sorted(range(len(xs)), key=lambda j: (str(by_id[j][0]), sum((n * c - s) ** 2 for c, s in zip(by_id[j][1], sums))))
        want = want[order]
        sign = np.sign(want @ have) or 1.0
        assert np.abs(have * sign - want).max() < close
    errors = {r["identity_error"] for r in out}
    assert len(errors) == 1 and (errors == {None} or errors.pop() < 1e-9)


def whitened(spark, rows, schema="vec_id long, embedding array<float>", parts=3):
    return wh.whitened(spark.createDataFrame(rows, schema).repartition(parts)).collect()


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 7, 40):
        state = wh.Spectrum(dims)
        rows = rng.integers(-50, 50, (90, dims)) * rng.integers(0, 2, dims) + 1_000_000
        rows[30:50] = rows[:20]  # equal rows
        state.add(rows)
        away = rows - rows.mean(axis=0)
        assert np.abs(state.basis.T @ state.basis - np.eye(dims)).max() < 1e-12
        back = state.basis @ np.diag(state.lam) @ state.basis.T
        assert np.abs(back - away.T @ away).max() < 1e-9 * max(1, np.abs(away.T @ away).max())
        parts = [wh.Spectrum(dims) for _ in range(3)]
        for part, some in zip(parts, (rows[:5], rows[5:6], rows[6:])):
            part.add(some)
        parts[0].join(parts[1])
        parts[0].join(parts[2])
        back = parts[0].basis @ np.diag(parts[0].lam) @ parts[0].basis.T
        assert np.abs(back - away.T @ away).max() < 1e-9 * max(1, np.abs(away.T @ away).max())
        assert parts[0].sums == state.sums and parts[0].n == 90


def test_secular_roots_near_poles():
    d = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 5.0])
    z2 = np.array([1e-20, 1e-3, 1e-16, 2.0, 1e-18])
    origin, t = wh.secular_roots(d, z2)
    found = np.sort(d[origin] + t)
    assert np.allclose(found, np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2))), atol=1e-13)
    assert (found >= d).all() and (found[:-1] <= d[1:]).all()


def test_random_vectors(spark):
    rng = np.random.default_rng(2)
    scales = np.linspace(0.1, 3, 20)
    vectors = (rng.normal(size=(400, 20)) * scales) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one hot vector counts once
    rows += [(5, rows[9][1]), (None, rows[10][1]), (7, None), (8, [float("nan")] * 20), (9, [None, *[1.0] * 19])]
    check(whitened(spark, rows), rows)
    check(whitened(spark, rows, parts=40), rows)


def test_few_and_short_rows(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, []), (2, None)]) == []
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [0.5, 0.25, 7.0]), (2, [0.75]), (3, [])],
                 [(k, [float(k), 2.0 * k, -1.0]) for k in range(20)]):
        check(whitened(spark, rows), rows, 1e-6)
    far = whitened(spark, [(k, [1e30 * k, 3e38]) for k in range(3)])
    assert len(far) == 6 and all(np.isfinite(r["whitened"]) for r in far)
    names = "x string, id string, n string, component string, at string, value string, part string"
    wide = [(k, [float(k % 5), float(k % 3)], *"abcdefg") for k in range(30)]
    check(whitened(spark, wide, f"vec_id long, embedding array<float>, {names}"), [w[:2] for w in wide])


def test_op13_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF001}/embeddings.parquet'").fetchall()
    out = entry.queries()["op13_whitening"](spark, SF001)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), rows)
