"""Embedding whitening by FEAST contour integration.

Sums and the covariance are added up over all rows, in tasks; the driver holds only the dimensions' sums and one matrix of
dimensions by dimensions, whose leading components are found there. The inertia of a shifted covariance (the signs of the
pivots of its LDL^T factors) counts the eigenvalues above the shift. By such counts the top of the spectrum is cut into
intervals. For each, Gauss-Legendre quadrature of the resolvent along a circle around it projects a block of vectors onto
the interval's eigenvectors; Rayleigh-Ritz in that block extracts them; and it is repeated until residuals are at the level of
rounding and there are as many components in the interval as inertia counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.common import slim, table
from autolot.llm.vectors import finite, main_length, matrix

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: The driver holds one matrix of dimensions by dimensions; longer vectors are refused.
WIDEST = 4096
#: Nodes of the quadrature on half a circle; eigenvalues of an interval, if they can be told apart; rounds of an interval.
NODES, WITHIN, ROUNDS = 8, 4, 40


def negatives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are below zero: the inertia of its LDL^T factors, with pivots of one or
    two rows (Bunch and Kaufman)."""
    a, count, k, n = a.copy(), 0, 0, len(a)
    alpha = (1 + 17**0.5) / 8
    while k < n:
        rest = a[k:, k:]
        below = np.abs(rest[1:, 0])
        if not len(below) or below.max() == 0:
            count, k = count + int(rest[0, 0] < 0), k + 1
            continue
        r = int(below.argmax()) + 1
        lam, size = below[r - 1], 1
        if abs(rest[0, 0]) < alpha * lam:
            column = np.abs(rest[:, r])
            column[r] = 0
            sigma = column.max()
            if abs(rest[0, 0]) * sigma < alpha * lam * lam:
                size = 1 if abs(rest[r, r]) >= alpha * sigma else 2
                to = 0 if size == 1 else 1
                swap = np.arange(len(rest))
                swap[[to, r]] = swap[[r, to]]
                rest[:] = rest[np.ix_(swap, swap)]
        pivot, side = rest[:size, :size].copy(), rest[size:, :size].copy()
        count += int((np.linalg.eigvalsh(pivot) < 0).sum())
        rest[size:, size:] -= side @ np.linalg.solve(pivot, side.T)
        k += size
    return count


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of `v` exceed the shift."""
    return negatives(shift * np.eye(len(v)) - v)


def intervals(v: np.ndarray, k: int, within: int = WITHIN) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold at least the k largest eigenvalues of `v` (all from 0 to 1), from the top down.

    Each is found by bisection over inertia counts. It has at most `within` eigenvalues, unless those of a narrow range cannot be
    told apart.
    """
    least, done, high, found = 1e-13, 0, 1.001, []
    while done < k:
        a, b = -0.001, high  # more than enough above a, none more above b
        while True:
            low = (a + b) / 2
            count = above(v, low) - done
            if b - a < least:
                low, count = a, above(v, a) - done
                break
            if count == 0:
                b = low
            elif count > within:
                a = low
            elif above(v, low + least) == above(v, low - least):
                break
            else:  # an eigenvalue lies on the cut
                b += (b - a) / 7
        found.append((low, high, count))
        high, done = low, done + count
    return found


def feast(v: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """The eigenvectors of the `count` eigenvalues of `v` in (low, high), as columns; an error if they can't be found."""
    d, scale = len(v), float(np.linalg.norm(v))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (nodes + 1)
    middle, radius = (low + high) / 2, (high - low) / 2
    turn = radius * np.exp(1j * angle)
    shifted = [(middle + t) * np.eye(d) - v for t in turn]
    size = min(d, 2 * count + 8)
    while True:
        block, good = rng.standard_normal((d, size)), False
        for _ in range(ROUNDS):
            q = sum(w / 2 * (t * np.linalg.solve(s, block)).real for s, t, w in zip(shifted, turn, weights, strict=True))
            q = np.linalg.qr(q)[0]
            ritz, small = np.linalg.eigh(q.T @ v @ q)
            block = q @ small
            inside = np.flatnonzero((ritz > low) & (ritz < high))
            residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * ritz[inside], axis=0)
            if good and len(inside) == count:  # after one more round
                return block[:, inside]
            good = len(inside) == count and residual.max() <= 4 * d * np.finfo(float).eps * scale
        if size == d:
            raise ArithmeticError(f"{len(inside)} of {count} components found between {low} and {high}")
        size = min(d, 2 * size)  # the block was too small for what lies around the interval


def leading(v: np.ndarray, k: int, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance and their unit eigenvectors (columns); fewer if its rank is lower.

    Ranks count eigenvalues above the level of rounding.
    """
    size = float(np.abs(v).sum(1).max()) if len(v) else 0.0
    floor = len(v) * np.finfo(float).eps * size * 4
    k = min(k, above(v, floor)) if size > 0 else 0
    if not k:
        return np.zeros(0), np.zeros((len(v), 0))
    unit, rng = v / size, np.random.default_rng(13)
    parts = [feast(unit, low, high, count, rng) for low, high, count in intervals(unit, k, within)]
    basis = np.linalg.qr(np.hstack(parts))[0]  # those of neighbouring intervals are made orthogonal to the last digit
    value, turn = np.linalg.eigh(basis.T @ unit @ basis)
    first = np.argsort(-value, kind="stable")[:k]
    return value[first] * size, basis @ turn[:, first]


@dataclass(frozen=True)
class Whitening:
    """What the fit list taught: rows, exact sums of the dimensions, leading eigenvalues and -vectors, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    basis: np.ndarray
    trace: float
    scale: int
    shift: int


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and embedding of the rows that take part, those whose components are longs after scaling."""
    fits = ~F.exists("embedding", lambda x: F.abs(x.cast("double") * scale) >= 2.0**53)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(finite(F.col("embedding")) & fits & (F.size("embedding") > 0))


def whole(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    return np.floor(matrix(column) * scale).astype(np.int64) + shift


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n: the whole part of S / n is taken off exactly, then the rest."""
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], float)
    return (x - mean).astype(float) - rest / n


def deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row, exactly; None where it is no long."""
    about = (centred(x, n, sums) ** 2).sum(1) * float(n) * n
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    out: list[int | None] = [None] * len(x)
    safe = np.flatnonzero(about < 2.0**62)  # so each difference is below 2^31
    for i, s in zip(safe.tolist(), (((x[safe] - mean) * n - rest) ** 2).sum(1).tolist(), strict=True):
        out[i] = s
    for i in np.flatnonzero((about >= 2.0**62) & (about < 2.0**64)).tolist():
        s = sum((n * int(a) - b) ** 2 for a, b in zip(x[i], sums, strict=True))
        out[i] = s if s < 2**63 else None
    return out


def _added(rows: DataFrame, width: int, part: Callable[[pa.RecordBatch], np.ndarray], exact: bool) -> list:
    """The sum over all rows of `part(vectors)`, an array of one value for each of `width` cells: of longs if `exact`, else of doubles.

    A task adds up its own rows; cells are then added in Spark, so that the driver gets one value for each.
    """

    def run(batches):
        total = None
        for batch in slim(batches, 4096):
            if batch.num_rows:
                one = part(batch)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["cell", "v"])

    got = rows.mapInArrow(run, f"cell int, v {'long' if exact else 'double'}").groupBy("cell")
    cells = dict(got.agg(F.sum(F.col("v").cast("decimal(38, 0)") if exact else "v")).collect())
    return [int(cells[i]) if exact else float(cells[i]) for i in range(width)]


def fit(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Learn from all usable rows; None without any."""
    rows = usable(vectors, scale)
    d, n = main_length(rows, "embedding")
    if not n:
        return None
    if d > WIDEST:
        raise ValueError(f"vectors of {d} dimensions; at most {WIDEST}")
    rows = rows.where(F.size("embedding") == d)

    def halves(batch: pa.RecordBatch) -> np.ndarray:  # of 32 bits, so that no sum leaves a long
        x = whole(batch.column(1), scale, shift)
        return np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    both = _added(rows, 2 * d, halves, True)
    sums = tuple((both[i] << 32) + both[d + i] for i in range(d))

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(whole(batch.column(1), scale, shift), n, sums)
        return (y.T @ y).ravel()

    v = np.array(_added(rows, d * d, squares, False)).reshape(d, d) / n
    v = (v + v.T) / 2
    values, basis = leading(v, k)
    return Whitening(n, sums, values, basis, float(np.trace(v)), scale, shift)


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.basis / np.sqrt(model.values))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, rows = len(model.values), usable(vectors, model.scale).where(F.size("embedding") == len(model.sums))
    if not k:
        return 0.0

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        w = project(whole(batch.column(1), model.scale, model.shift), model)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = np.array(_added(rows, k + k * k, squares, False)) / model.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


ANSWER = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Each usable row with its whitened value in each of the k leading components.

    `vectors` has vec_id and embedding. A component c, as double, becomes x = floor(scale * c) + shift. Rows whose vector is
    null, empty, holds a null or a component that is not finite, or of which scale * c is not below 2^53, take no part; nor do
    vectors of another length than most usable ones. A null vec_id stays null, repeated rows all count, and other columns are
    ignored. Components without variance (fewer independent rows or dimensions than k) are left out, as nothing can be divided by
    their root; so an empty table, a single row and equal rows give no rows. `deviation` is null where it is no long.
    """
    model = fit(vectors, k, scale, shift)
    spark = vectors.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], ANSWER)
    error, k = identity_error(vectors, model), len(model.values)

    def run(batches):
        for batch in slim(batches, 4096):
            if not batch.num_rows:
                continue
            x = whole(batch.column(1), scale, shift)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.n)), pa.array(deviation(x, model.n, model.sums), pa.int64()).take(pa.array(rows)),
                pa.array(project(x, model).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(rows), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors, scale).where(F.size("embedding") == len(model.sums)).mapInArrow(run, ANSWER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
