"""Embedding whitening from an incremental eigendecomposition.

Vectors become whole numbers x = floor(scale * component) + shift; the fit list
holds every different x once. Each task starts from nothing and takes its part of
the list row by row: a row moves the mean and changes the scatter by one centred
rank-one term, so the spectrum follows from a secular equation. Entries of the
update that are negligible, and equal eigenvalues (turned into one another by
Givens rotations), are deflated first; the eigenvectors come from weights that
are recomputed from the roots, so they stay orthogonal. The spectra of tasks are
combined in small groups, level by level: each eigenpair of one is a rank-one
update of the other, and one more update accounts for the distance of the means.

The spectrum found so is the basis of a last pass over the fit list: the
covariance of the centred list, projected on the basis, is summed by Spark and
diagonalised (Rayleigh-Ritz), which gives eigenvectors to double precision. Sums
of x are whole numbers, so counts, means and deviations are exact. What the
driver or a task holds is a square of the dimensions, whatever the rows.

Rows whose vector is null, or holds a null or a component that is not finite, are
left out. Shorter vectors count as continued with zero components. Scaled
components are limited to +-2**40. A component whose variance is zero (one row,
constant vectors, fewer different rows than components) is 0 after whitening,
with explained 0; the identity error covers the others, null if there is none.
A deviation beyond a BIGINT is null. Repeated rows, and rows that repeat an id,
all come back; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softgrove.llm.common import written
from softgrove.llm.topk_search import matrix, scaled, usable

SCALE = 64
SHIFT = 1_000_000
LIMIT = 1 << 40
COMPONENTS = 16
FAN_IN = 8
EPS = np.finfo(np.float64).eps
STATE_SCHEMA = "part long, n long, sums array<decimal(38,0)>, mean array<double>, lam array<double>, basis array<double>"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)), one above each of the rising poles ``d``, as (nearest pole, distance from it)."""
    k = len(d)
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total * (1 + 4 * EPS))
    width = upper - d
    middle = d + width / 2
    at_middle = 1 + (z2 / (d[None, :] - middle[:, None])).sum(axis=1)
    left = at_middle >= 0  # the root lies in the left half of its interval
    left[-1] = True
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d[None, :] - d[origin][:, None]
    low = np.where(left, 0.0, -width / 2)
    high = np.where(left, np.where(np.arange(k) < k - 1, width / 2, width), 0.0)
    here = np.arange(k)
    at_left = delta[here, here]
    at_right = np.append(delta[here[:-1], here[1:]], upper[-1] - d[-1])
    lower = np.tri(k, dtype=bool)
    t = (low + high) / 2
    for _ in range(60):
        gap = delta - t[:, None]
        term = z2 / gap
        slope = term / gap
        f = 1 + term.sum(axis=1)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        settled = np.abs(f) <= 8 * k * EPS * (1 + np.abs(term).sum(axis=1))
        settled |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if settled.all():
            break
        # the next point solves a rational function with the two poles around the root
        left_slope = np.where(lower, slope, 0.0).sum(axis=1)
        right_slope = slope.sum(axis=1) - left_slope
        a_gap, b_gap = at_left - t, at_right - t
        a = (a_gap + b_gap) * f - a_gap * b_gap * (left_slope + right_slope)
        b = a_gap * b_gap * f
        c = f - a_gap * left_slope - b_gap * right_slope
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = t + step
        inside = (moved > low) & (moved < high)
        t = np.where(settled, t, np.where(inside, moved, (low + high) / 2))
    return origin, t


def rank_one(lam: np.ndarray, basis: np.ndarray, u: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis diag(lam) basis' + weight u u' for rising ``lam`` and a weight that isn't negative."""
    z = basis.T @ u
    norm = float(z @ z)
    if weight * norm <= 0:
        return lam, basis
    tol = 8 * EPS * max(abs(lam[0]), abs(lam[-1]), weight * norm)
    z = z * np.sqrt(weight)
    alive = np.abs(z) * np.sqrt(weight * norm) > tol
    kept = np.flatnonzero(alive)
    close = np.flatnonzero(np.diff(lam[kept]) <= tol) if len(kept) > 1 else ()
    if len(close):  # rotate the weight of equal eigenvalues into one of them
        basis = basis.copy()
        for p in close.tolist():
            i, j = kept[p], kept[p + 1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            basis[:, [i, j]] = basis[:, [i, j]] @ np.array([[c, s], [-s, c]])
            z[i], z[j] = 0.0, r
            alive[i] = False
        kept = np.flatnonzero(alive)
    if not len(kept):
        return lam, basis
    d, zk = lam[kept], z[kept]
    origin, t = secular_roots(d, zk * zk)
    found = d[origin] + t
    # distances of roots and poles without cancellation, then weights for which the roots are exact
    apart = (d[None, :] - d[origin][:, None]) - t[:, None]  # [root, pole]
    apart[apart == 0] = np.finfo(np.float64).tiny
    between = d[:, None] - d[None, :]  # [other, pole]
    np.fill_diagonal(between, 1.0)
    ratio = np.empty_like(apart)
    ratio[:-1] = apart[:-1] / np.where(np.tri(len(d), k=-1, dtype=bool).T[:-1], between[:-1], between[1:])
    ratio[-1] = apart[-1]
    exact = np.copysign(np.sqrt(np.abs(ratio.prod(axis=0))), zk)
    inner = exact[None, :] / apart
    inner /= np.linalg.norm(inner, axis=1)[:, None]
    out_lam, out_basis = lam.copy(), basis.copy()
    out_lam[kept] = found
    out_basis[:, kept] = basis[:, kept] @ inner.T
    order = np.argsort(out_lam, kind="stable")
    return out_lam[order], out_basis[:, order]


class Spectrum:
    """Count, exact sums, mean and spectrum of the scatter of the rows taken so far."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.lam, self.basis = np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, rows: np.ndarray) -> None:
        for x in rows.astype(np.float64):
            away = x - self.mean
            if self.n:
                self.lam, self.basis = rank_one(self.lam, self.basis, away, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + away / self.n
        self.sums = [a + b for a, b in zip(self.sums, rows.sum(axis=0, dtype=object).tolist())]

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        both = self.n + other.n
        apart = other.mean - self.mean
        for lam, u in zip(other.lam, other.basis.T):
            if lam > 0:
                self.lam, self.basis = rank_one(self.lam, self.basis, u, float(lam))
        self.lam, self.basis = rank_one(self.lam, self.basis, apart, self.n * other.n / both)
        self.mean = self.mean + apart * (other.n / both)
        self.n, self.sums = both, [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> dict:
        from decimal import Decimal

        return {"part": part, "n": self.n, "sums": [Decimal(s) for s in self.sums], "mean": self.mean.tolist(),
                "lam": self.lam.tolist(), "basis": self.basis.ravel().tolist()}

    @staticmethod
    def of(n: int, sums: list, mean: list, lam: list, basis: list) -> Spectrum:
        dims = len(mean)
        out = Spectrum(dims)
        out.n, out.sums = int(n), [int(s) for s in sums]
        out.mean, out.lam = np.array(mean, float), np.array(lam, float)
        out.basis = np.array(basis, float).reshape(dims, dims)
        return out


STATE_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
                         ("mean", pa.list_(pa.float64())), ("lam", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64()))])


def spectrum(fit: DataFrame, dims: int, parts: int) -> Spectrum:
    """Spectrum of the scatter of column ``x``: one per task, then combined in groups of FAN_IN."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(dims)
        for batch in batches:
            own.add(matrix(batch.column("x"), dims, np.int64))
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())], STATE_ARROW)

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        states = [Spectrum.of(*row) for row in zip(*(group[c] for c in ("n", "sums", "mean", "lam", "basis")))]
        out = states[0]
        for other in states[1:]:
            out.join(other)
        return pd.DataFrame([out.row(int(group["part"].iloc[0]))])

    states = written(fit.mapInArrow(start, STATE_SCHEMA), "spectra")
    width = max(1, parts)
    group = 1
    while width > FAN_IN:
        group *= FAN_IN
        width = -(-width // FAN_IN)
        states = written(states.groupBy(F.floor(F.col("part") / group)).applyInPandas(combine, STATE_SCHEMA), "spectra")
    left = states.orderBy("part").collect()  # at most FAN_IN spectra
    out = Spectrum(dims)
    for row in left:
        out.join(Spectrum.of(row["n"], row["sums"], row["mean"], row["lam"], row["basis"]))
    return out


def summed(rows: DataFrame, values, width: int) -> np.ndarray:
    """Sums over all rows of an array of ``width`` numbers for each batch of column ``x``, added up by Spark."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width), False
        for batch in batches:
            if len(batch):
                total, seen = total + values(batch), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["at", "value"])

    found = rows.mapInArrow(part, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for row in found:
        out[row["at"]] = row["value"]
    return out


class Centre:
    """Exact means of x: x - S / n in doubles, as a whole offset and a small rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def away(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact."""
        left = np.array([s % self.n for s in self.sums], object)
        near = np.abs(x - self.whole).max(initial=0)
        if (int(near) + 1) ** 2 * self.n ** 2 * max(1, x.shape[1]) < 1 << 62:
            off = (x - self.whole) * self.n - left.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        off = (x - self.whole).astype(object) * self.n - left
        return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


class Whitener:
    """Components by falling variance, with the list's centre."""

    def __init__(self, centre: Centre, vectors: np.ndarray, variances: np.ndarray, trace: float):
        self.centre, self.vectors, self.variances, self.trace = centre, vectors, variances, trace
        self.explained = variances / trace if trace > 0 else np.zeros(len(variances))
        with np.errstate(divide="ignore"):
            self.scales = np.where(variances > 0, 1 / np.sqrt(variances), 0.0)
        self.error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.away(x) @ self.vectors) * self.scales


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Whitening of column ``x`` (arrays of whole numbers) over its different values; None without any."""
    fit = written(rows.select("x").distinct(), "whitening-list")
    dims = fit.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    base = spectrum(fit, dims, fit.rdd.getNumPartitions())
    centre = Centre(base.n, base.sums)
    basis = np.linalg.qr(base.basis[:, ::-1])[0]

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        y = centre.away(matrix(batch.column("x"), dims, np.int64)) @ basis
        return (y.T @ y).ravel()

    scatter = summed(fit, projected, dims * dims).reshape(dims, dims) / base.n
    values, turned = np.linalg.eigh((scatter + scatter.T) / 2)
    order = np.argsort(values)[::-1][:components]
    trace = float(np.trace(scatter))
    variances = np.where(values[order] > 16 * dims * EPS * trace, values[order], 0.0)
    out = Whitener(centre, basis @ turned[:, order], variances, trace)
    width = len(order)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = out.whiten(matrix(batch.column("x"), dims, np.int64))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = summed(fit, moments, width + width * width) / base.n
    mean, second = found[:width], found[width:].reshape(width, width)
    there = variances > 0
    if there.any():
        out.error = float(np.abs((second - np.outer(mean, mean) - np.eye(width))[np.ix_(there, there)]).max())
    return out


OUT_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
            shift: int = SHIFT) -> DataFrame:
    """(id, x) of the usable rows."""
    own = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("vector")).filter(usable(F.col("vector")))
    dims = own.agg(F.max(F.size("vector"))).first()[0] or 0
    whole = F.transform(scaled(F.col("vector"), scale, LIMIT), lambda v: v + F.lit(shift))
    padding = F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("vector"))
    return own.select("id", F.concat(whole, padding).alias("x"))


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of the table and component."""
    spark = df.sparkSession
    rows = written(numbers(df, id_col, vector_col), "whitening-numbers")
    model = fit_whitening(rows, components)
    if model is None:
        return spark.createDataFrame([], OUT_SCHEMA)
    dims, width = len(model.centre.sums), len(model.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims, np.int64)
            size = len(x) * width
            each = np.repeat(np.arange(len(x)), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, model.centre.n)), pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, len(x))),
                pa.array([model.error] * size, pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, OUT_SCHEMA)
