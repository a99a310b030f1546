"""Embedding whitening: leading principal directions by Jacobi-Davidson.

The covariance is never formed. All the solver asks of the table is a product with a few
columns, one pass over the vectors in which each task centres its rows exactly (as whole
numbers) and adds up ``C' (C B)``; the parts are folded by tasks before the driver gets
them, and all the driver holds has one row for each dimension.

Outside, a block of Ritz pairs is improved at once: Rayleigh-Ritz in the search space;
residuals that have reached double precision lock their vectors, largest values first; for
the others the projected correction equation (I - Q Q') (V - theta I) (I - Q Q') t = -r is
solved by MINRES, all columns in step, so that a step costs one pass whatever the number of
columns. A full search space is restarted from its best Ritz vectors.

Entries are taken as x = floor(64 c) + 1,000,000; all sums over x are exact. The offset
cancels wherever x is centred, so the work is done on floor(64 c).

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out,
and so are those whose length is not the most frequent one (of equal counts the smallest);
repeated rows count each time; null ids are returned as they are; directions without variance
(below ``FLAT`` of the largest) are no components, so a single vector, equal vectors and an
empty table give an empty result; other columns are not looked at. Entries of 2^40 or more,
and deviations that exceed a long, end the job with an error that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 32
# Ritz vectors carried beyond those asked for, and columns of a full search space
EXTRA = 8
SPACE = 4
# steps and relative accuracy of the inner solver, rounds of the outer one
STEPS, INNER, ROUNDS = 8, 0.05, 200
# a residual of so many roundings of the largest value counts as none
ROUNDINGS = 32
# variance, as a share of the largest, that counts as none
FLAT = 1e-12
LARGEST = float(1 << 40)
# rows multiplied at a time, tasks that fold the parts
ROWS, FOLDS = 8_192, 16


def entries(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their floor(64 c), one row each."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = flat.reshape(-1, size)
    whole = np.isfinite(values).all(1)
    values = np.floor(64 * values[whole])
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError("embedding entries of 2^40 or more cannot be whitened in whole numbers")
    return at[whole], values.astype(np.int64)


@dataclass(frozen=True)
class Fit:
    """Number and sums of the vectors that take part; ``size`` 0 if there are none."""
    size: int
    n: int
    sums: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, whole numbers."""
        return self.n * x - self.sums


def measure(vectors: DataFrame, column: str = "embedding") -> Fit:
    """Length, number and sums of the vectors, in one pass."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, tuple[int, np.ndarray]] = {}
        for batch in arrived:
            for size in np.unique(np.asarray(pc.fill_null(pc.list_value_length(batch.column(0)), 0))).tolist():
                if size > 0:
                    x = entries(batch.column(0), size)[1]
                    n, sums = told.get(size, (0, np.zeros(size, np.int64)))
                    told[size] = n + len(x), sums + x.sum(0)
        rows = [(size, n, sums.tolist()) for size, (n, sums) in told.items() if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["size", "n", "sums"])
    parts = vectors.select(column).mapInArrow(work, "size int, n bigint, sums array<bigint>")
    size = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    if size is None:
        return Fit(0, 0, np.empty(0, np.int64))
    each = (parts.filter(F.col("size") == size["size"]).select(F.posexplode("sums").alias("at", "x"))
            .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect())
    return Fit(size["size"], size["n"], np.array([r["x"] for r in each], np.int64))


def _folded(vectors: DataFrame, column: str, shape: tuple[int, int], fit: Fit,
            part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(centred rows)`` over the table. Tasks add up their own rows, a few
    tasks add up the tasks' sums, and the driver the few."""
    def add(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in arrived:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["fold", "sums"])

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in arrived:
            x = entries(batch.column(0), fit.size)[1]
            for low in range(0, len(x), ROWS):
                total += part(fit.centred(x[low:low + ROWS]) / fit.n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % FOLDS], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["fold", "sums"])
    schema = "fold int, sums binary"
    told = vectors.select(column).mapInArrow(work, schema).repartition(FOLDS, "fold").mapInArrow(add, schema)
    return sum((np.frombuffer(r["sums"]).reshape(shape) for r in told.collect()), np.zeros(shape))


def product(vectors: DataFrame, fit: Fit, block: np.ndarray, column: str = "embedding") -> np.ndarray:
    """The covariance times the columns of ``block``, in one pass over the vectors."""
    return _folded(vectors, column, block.shape, fit, lambda c: c.T @ (c @ block)) / fit.n


def corrections(times: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, rest: np.ndarray,
                frame: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Columns t of (I - Q Q') (V - theta I) (I - Q Q') t = -rest, Q the orthonormal
    ``frame``, by MINRES; each column has its own shift and its own recurrence."""
    def project(block: np.ndarray) -> np.ndarray:
        return block - frame @ (frame.T @ block)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)
    start = project(-rest)
    left = first = np.linalg.norm(start, axis=0)
    old, now = np.zeros_like(start), over(start, first)
    beta = np.zeros_like(first)
    cos, cos_old, sin, sin_old = np.ones_like(first), np.ones_like(first), np.zeros_like(first), np.zeros_like(first)
    way, way_old = np.zeros_like(start), np.zeros_like(start)
    found = np.zeros_like(start)
    for _ in range(steps):
        image = project(times(now) - theta * now)
        alpha = (now * image).sum(0)
        new = image - alpha * now - beta * old
        size = np.linalg.norm(new, axis=0)
        size[size <= 1e-14 * np.abs(alpha)] = 0.0
        rho = cos * alpha - cos_old * sin * beta
        full = np.hypot(rho, size)
        ahead = over(now - way_old * (sin_old * beta) - way * (sin * alpha + cos_old * cos * beta), full)
        turn, lean = over(rho, full), over(size, full)
        found += ahead * (turn * left)
        left = -lean * left
        old, now, beta = now, over(new, size), size
        cos_old, cos, sin_old, sin = cos, turn, sin, lean
        way_old, way = way, ahead
        if (np.abs(left) <= INNER * first).all():
            break
    return project(found)


def _joined(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The columns of ``more`` made orthonormal to ``basis`` and to each other; those
    that lie in what is there already are left out."""
    kept = np.empty((basis.shape[0], 0))
    for column in more.T:
        before = np.linalg.norm(column)
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            column = column - kept @ (kept.T @ column)
        after = np.linalg.norm(column)
        if after > 1e-8 * before and basis.shape[1] + kept.shape[1] < basis.shape[0]:
            kept = np.column_stack([kept, column / after])
    return kept


def leading(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 1
            ) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator of ``size`` dimensions,
    falling, and their unit eigenvectors as columns. ``times`` multiplies a block."""
    wanted = min(wanted, size)
    chance = np.random.default_rng(seed)
    held, values = np.empty((size, 0)), []
    basis = _joined(held, chance.standard_normal((size, min(size, wanted + EXTRA))))
    image = times(basis)
    best, scale = np.inf, 0.0
    for _ in range(ROUNDS):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        scale = max(scale, theta[0])
        rest = image - basis * theta
        rest -= held @ (held.T @ rest)
        wide = np.linalg.norm(rest, axis=0)
        whole = held.shape[1] + basis.shape[1] == size
        # with all dimensions in the space Rayleigh-Ritz is exact, what is left is rounding
        small = wide <= (64 if whole else 1) * ROUNDINGS * np.finfo(float).eps * np.sqrt(size) * scale
        ahead = small[:wanted - len(values)]
        locked = len(ahead) if ahead.all() else int(np.argmin(ahead))
        values += theta[:locked].tolist()
        held = np.column_stack([held, basis[:, :locked]])
        basis, image, theta, rest, wide = (basis[:, locked:], image[:, locked:], theta[locked:], rest[:, locked:],
                                           wide[locked:])
        if len(values) >= wanted:
            break
        if whole and not locked and wide.max() >= best:
            raise ArithmeticError(f"residuals stay at {wide.max():.3g} with all dimensions in the search space")
        best = wide.max()
        if basis.shape[1] > SPACE * (wanted + EXTRA):
            basis, image = basis[:, :wanted + EXTRA], image[:, :wanted + EXTRA]
            theta, rest = theta[:wanted + EXTRA], rest[:, :wanted + EXTRA]
        open_ = wanted - len(values)
        more = corrections(times, theta[:open_], rest[:, :open_], np.column_stack([held, basis[:, :open_]]))
        more = _joined(np.column_stack([held, basis]), more)
        if not more.shape[1]:
            more = _joined(np.column_stack([held, basis]), chance.standard_normal((size, open_)))
        if more.shape[1]:
            basis, image = np.column_stack([basis, more]), np.column_stack([image, times(more)])
        else:
            image = times(basis)
    else:
        raise ArithmeticError(f"no double precision after {ROUNDS} rounds")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], held[:, order]


@dataclass(frozen=True)
class Model:
    """Directions (columns) with their variances, falling; ``total`` is the trace."""
    fit: Fit
    values: np.ndarray
    directions: np.ndarray
    total: float

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.directions / np.sqrt(self.values))


def learn(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Model:
    """The leading directions of all vectors that take part."""
    fit = measure(vectors, column)
    if not fit.size:
        return Model(fit, np.empty(0), np.empty((0, 0)), 0.0)
    total = float(_folded(vectors, column, (1, 1), fit, lambda c: np.array([[np.square(c).sum()]]))[0, 0]) / fit.n
    if total == 0:
        return Model(fit, np.empty(0), np.empty((fit.size, 0)), 0.0)
    values, directions = leading(lambda block: product(vectors, fit, block, column), fit.size, components)
    real = values > FLAT * values[0]
    return Model(fit, values[real], directions[:, real], total)


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k = len(model.values)

    def part(centred: np.ndarray) -> np.ndarray:
        own = model.whitened(centred)
        return np.vstack([own.T @ own, own.sum(0)])
    told = _folded(vectors, column, (k + 1, k), model.fit, part) / model.fit.n
    return float(np.abs(told[:k] - np.outer(told[k], told[k]) - np.eye(k)).max())


def apply(vectors: DataFrame, model: Model, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each vector
    that takes part and each component; ``whitened`` is the vector's place on the component
    in units of its spread, ``deviation`` its exact squared distance from the mean times n^2."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    k = len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, column)
    share = model.values / model.total

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            at, x = entries(batch.column(1), model.fit.size)
            for low in range(0, len(at), ROWS):
                own = model.fit.centred(x[low:low + ROWS])
                if (np.square(own.astype(np.float64)).sum(1) >= 2.0**63).any():
                    raise ValueError("the deviation of a vector exceeds a long")
                rows = np.repeat(at[low:low + ROWS], k)
                many = len(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, model.fit.n)),
                    pa.array(np.repeat(np.square(own).sum(1), k)),
                    pa.array(model.whitened(own / model.fit.n).ravel()),
                    pa.array(np.tile(share, many)),
                    pa.array(np.full(many * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.select(id_col, column).mapInArrow(work, schema)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``learn`` and ``apply`` on one table of ``vec_id, embedding``."""
    return apply(vectors, learn(vectors, components))
