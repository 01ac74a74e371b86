"""Embedding whitening: means and covariances by Welford updates, merged across partitions, then a symmetric QR eigen-solve.

A partition goes through its vectors one by one. Each adds its rank-one step to the mean and to the sum of centred products,
so nothing is squared before it is centred. Vectors are first moved by the partition's first vector, which is exact for
whole numbers and keeps the mean's error at the size of the spread. Partitions' states are merged by the parallel update
formula in three rounds of ever fewer tasks, each of which holds one state per vector length; what reaches the
driver is one state a length. There the covariance is reduced to a tridiagonal matrix by reflections and diagonalised by
implicit QR steps with Wilkinson shifts.

Rows whose vector is null, or holds a null or a number that isn't finite, are left out. An empty vector has no components
and keeps an empty result. Vectors of different lengths have no common covariance: each length is fitted and whitened by
itself. Equal rows count as often as they occur. A component whose eigenvalue is lost in rounding (no variance, or fewer
vectors than components) has null coordinates. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common

_STATE = "part int, length int, n long, total array<decimal(38,0)>, shift array<double>, mean array<double>, spread array<double>"


@dataclass
class State:
    """``n`` vectors: their exact whole-number total, the mean as ``shift + mean``, and the sum of centred products."""

    n: int
    total: list[int]
    shift: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def at(cls, x: np.ndarray) -> State:
        d = len(x)
        return cls(0, [0] * d, x.copy(), np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update by one vector after the other."""
        for x in rows - self.shift:
            self.n += 1
            gap = x - self.mean
            self.mean += gap / self.n
            self.spread += np.multiply.outer(gap, gap * ((self.n - 1) / self.n))

    def merge(self, other: State) -> None:
        """The parallel update (Chan, Golub and LeVeque 1979)."""
        n = self.n + other.n
        gap = (other.shift - self.shift) + (other.mean - self.mean)
        self.mean += gap * (other.n / n)
        self.spread += other.spread + np.multiply.outer(gap, gap * (self.n * other.n / n))
        self.total = [a + b for a, b in zip(self.total, other.total)]
        self.n = n

    @property
    def covariance(self) -> np.ndarray:
        return self.spread / self.n


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all of its entries are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.coalesce(~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and vectors of the rows of each length."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, values[ends[at][:, None] + np.arange(size)]


def _emitted(states: dict[int, State], part: int) -> pa.RecordBatch:
    rows = [{"part": part, "length": d, "n": s.n, "total": s.total, "shift": s.shift, "mean": s.mean, "spread": s.spread.ravel()} for d, s in states.items()]
    decimals = pa.list_(pa.decimal128(38, 0))
    kinds = pa.schema([("part", pa.int32()), ("length", pa.int32()), ("n", pa.int64()), ("total", decimals), ("shift", pa.list_(pa.float64())), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_pylist(rows, kinds)


def moments(rows: DataFrame, column: str, *, fans: tuple[int, ...] = (64, 8, 1)) -> dict[int, State]:
    """The state of all vectors of each length. ``total`` is meant for whole numbers and is of their whole parts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, State] = {}
        for batch in batches:
            for d, _, found in _by_length(batch.column(0)):
                exact = found.astype(np.float64)
                states.setdefault(d, State.at(exact[0])).add(exact)
                states[d].total = [a + int(b) for a, b in zip(states[d].total, found.astype(np.int64).sum(axis=0))]
        yield _emitted(states, TaskContext.get().partitionId())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        first = 0
        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                d = r["length"]
                x = State(r["n"], [int(t) for t in r["total"]], np.array(r["shift"]), np.array(r["mean"]), np.array(r["spread"]).reshape(d, d))
                first = r["part"] if not states else first
                if d in states:
                    states[d].merge(x)
                else:
                    states[d] = x
        yield _emitted(states, first)

    vector = F.col(f"`{column}`")
    found = rows.where(finite(vector)).select(vector.alias("x")).mapInArrow(gather, _STATE)
    for fan in fans:
        found = found.repartition(fan, F.col("part")).sortWithinPartitions("part").mapInArrow(fold, _STATE)
    return {r["length"]: State(r["n"], [int(t) for t in r["total"]], np.array(r["shift"]), np.array(r["mean"]), np.array(r["spread"]).reshape(r["length"], r["length"])) for r in found.collect()}


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and basis of a symmetric matrix, by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        size = float(np.abs(a[k + 1 :, k]).max())
        if size == 0:
            continue
        v = a[k + 1 :, k] / size  # so that squares of leftovers of rounding don't underflow
        v[0] += math.copysign(math.sqrt(float(v @ v)), v[0])
        v /= math.sqrt(float(v @ v))
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= (v @ p) * v
        rest -= 2 * (np.multiply.outer(v, p) + np.multiply.outer(p, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors by row, by implicit symmetric QR steps (Golub and Van Loan, 8.3)."""
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = _tridiagonal(a)
    basis, tiny = np.ascontiguousarray(q.T), np.finfo(float).eps
    end = n - 1
    while end > 0:
        small = np.abs(e[:end]) <= tiny * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0
        if e[end - 1] == 0:
            end -= 1
            continue
        broken = np.flatnonzero(e[: end - 1] == 0)
        start = int(broken[-1]) + 1 if len(broken) else 0
        half = (d[end - 1] - d[end]) / 2
        x = d[start] - (d[end] - e[end - 1] ** 2 / (half + math.copysign(math.hypot(half, e[end - 1]), half)))
        z = e[start]
        for k in range(start, end):
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one - 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one + 2 * c * s * off + c * c * two
            e[k] = c * s * (one - two) + (c * c - s * s) * off
            if k < end - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            basis[[k, k + 1]] = c * basis[k] - s * basis[k + 1], s * basis[k] + c * basis[k + 1]
    order = np.argsort(-d, kind="stable")
    return d[order], basis[order]


@dataclass
class Whitener:
    """What whitens vectors of one length: ``n``, exact total, mean, directions divided by their deviation, shares of variance."""

    n: int
    total: list[int]
    shift: np.ndarray
    mean: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, s: State, components: int) -> Whitener:
        values, vectors = eigen(s.covariance)
        trace = float(np.trace(s.covariance))
        values, vectors = values[:components], vectors[:components]
        flat = values <= len(s.mean) * np.finfo(float).eps * max(trace, 1e-300)
        scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, values)))
        return cls(s.n, s.total, s.shift, s.mean, vectors / scale[:, None], np.where(flat, 0.0, values) / (trace or 1.0), flat)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return ((rows.astype(np.float64) - self.shift) - self.mean) @ self.directions.T

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Exact sums of squares of ``n * x - total``; null where a 64-bit number can't hold one."""
        most = max((abs(t) for t in self.total), default=0) + self.n * int(max(np.abs(rows).max(initial=0), 0))
        if most**2 * max(1, len(self.total)) < 1 << 62:
            gap = self.n * rows - np.array(self.total, np.int64)
            return np.einsum("ij,ij->i", gap, gap).tolist()
        gap = self.n * rows.astype(object) - np.array(self.total, object)
        if not gap.shape[1]:
            return [0] * len(rows)
        return [int(s) if s < 1 << 63 else None for s in (gap * gap).sum(axis=1)]


def fit(rows: DataFrame, column: str, components: int = 32) -> dict[int, Whitener]:
    """The whitener of each vector length."""
    return {d: Whitener.of(s, components) for d, s in moments(rows, column).items()}


def whiten(rows: DataFrame, column: str, model: dict[int, Whitener], *, deviation: bool = False) -> DataFrame:
    """``rows`` with their ``whitened`` coordinates and the ``explained`` shares; with ``n`` and ``deviation`` if asked for.

    Caller's columns of these names are replaced."""
    names = {"whitened": "array<double>", "explained": "array<double>"} | ({"n": "long", "deviation": "long"} if deviation else {})
    own = rows.drop(*names)
    schema = common.extended(own.schema, **names)
    order = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            for d, at, vectors in _by_length(batch.column(column)):
                w = model[d]
                z = w(vectors)
                far = w.deviation(vectors) if deviation else [None] * len(at)
                for i, row, gap in zip(at, z, far):
                    found[i] = {"whitened": [None if flat else v for v, flat in zip(row.tolist(), w.flat)] if w.flat.any() else row, "explained": w.explained, "n": w.n, "deviation": gap}
            kinds = {"whitened": pa.list_(pa.float64()), "explained": pa.list_(pa.float64()), "n": pa.int64(), "deviation": pa.int64()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[c] for f in found], kinds[c]) for c in names)], names=order)

    return own.where(finite(F.col(f"`{column}`"))).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance minus the identity, over all lengths; 0 without rows.

    Measured over all whitened rows by the same updates; directions without variance, which are null, have no part in it."""
    known = whitened.select(F.filter(f"`{column}`", lambda x: x.isNotNull()).alias("z"))
    return max((float(np.abs(s.covariance - np.eye(d)).max()) for d, s in moments(known, "z").items() if d), default=0.0)
