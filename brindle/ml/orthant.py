"""Poisson regression with l1 and l2 penalties by proximal Newton steps, or the orthant-wise quasi-Newton method if there are many features.

The objective is ``mean(exp(s) - y s) + l2 / 2 |w|^2 + l1 |w|_1`` with ``s = w x + b`` and a free intercept ``b``. Tasks sum loss,
gradient and, up to ``NEWTON`` features, second derivatives of stored blocks; the driver keeps these sums. All is divided by the
label's mean and measured from the best model without weights: in large counts rounding would hide the last steps.
The quasi-Newton method (Andrew and Gao 2007) doesn't leave the orthant of the current weights, and Newton's model is minimised
with its l1, so weights that the penalty holds at zero are exactly zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.ml import blocks, sums
from brindle.sources import scratch

MEMORY = 10
#: Features up to which second derivatives are summed: their square is what a task and the driver hold.
NEWTON = 256


def pseudo_gradient(w: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The steepest direction of the penalised objective: zero where the penalty holds a zero weight."""
    up, down = g + l1, g - l1
    at_zero = np.where(up < 0, up, np.where(down > 0, down, 0.0))
    return np.where(w == 0, at_zero, g + np.sign(w) * l1)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, l1: np.ndarray, *, iterations: int, tolerance: float = 1e-9) -> np.ndarray:
    """The minimum of ``f(w) + sum(l1 * |w|)``; ``f`` gives value and gradient."""
    value, g = f(w)
    total = value + float(l1 @ np.abs(w))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    scale = max(1.0, float(np.abs(g).max(initial=0)))
    for _ in range(iterations):
        pseudo = pseudo_gradient(w, g, l1)
        if np.abs(pseudo).max(initial=0) <= tolerance * scale:
            break
        q, kept = pseudo.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        move = -q
        move[move * pseudo >= 0] = 0  # against the steepest direction
        slope = float(pseudo @ move)
        if slope >= 0:
            steps, move = [], -pseudo
            slope = -float(pseudo @ pseudo)
        orthant = np.where(w != 0, np.sign(w), -np.sign(pseudo))
        length = 1.0 if steps else min(1.0, 1 / float(np.abs(pseudo).sum()))
        for _ in range(40):
            tried = w + length * move
            tried = np.where(l1 > 0, np.where(tried * orthant > 0, tried, 0.0), tried)
            new_value, new_g = f(tried)
            new_total = new_value + float(l1 @ np.abs(tried))
            if np.isfinite(new_total) and new_total <= total + 1e-4 * float(pseudo @ (tried - w)):
                break
            length /= 2
        else:
            if not steps:
                break
            steps = []
            continue
        s, y = tried - w, new_g - g
        w, g = tried, new_g
        if float(s @ y) > 1e-12 * float(y @ y):
            steps = [*steps[1 - MEMORY :], (s, y)]
        if abs(total - new_total) <= 1e-15 * max(1.0, abs(total)):
            total = new_total
            break
        total = new_total
    return w


def model_minimum(w: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, sweeps: int = 10_000) -> np.ndarray:
    """Where ``g (v - w) + (v - w) h (v - w) / 2 + sum(l1 |v|)`` is least, by coordinate descent."""
    v, slope, steep = w.copy(), g.copy(), np.maximum(np.diag(h), 1e-300)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            goal = v[j] - slope[j] / steep[j]
            move = np.sign(goal) * max(abs(goal) - l1[j] / steep[j], 0.0) - v[j]
            if move:
                v[j] += move
                slope += move * h[j]
                most = max(most, abs(move) * np.sqrt(steep[j]))
        # With the signs settled the rest is linear: one solution ends what may be a long crawl.
        free = (v != 0) | (l1 == 0)
        there = v.copy()
        there[free] = w[free] + np.linalg.lstsq(h[np.ix_(free, free)], h[np.ix_(free, ~free)] @ w[~free] - g[free] - (l1 * np.sign(v))[free], rcond=1e-13)[0]
        rest = g + h @ (there - w)
        if np.all(np.where(l1 > 0, there * v >= 0, True)) and np.all(np.abs(rest[~free]) <= l1[~free]):
            return there
        if most <= 1e-14:
            break
    return v


def newton(f: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], w: np.ndarray, l1: np.ndarray, *, iterations: int, tolerance: float = 1e-9) -> np.ndarray:
    """The minimum of ``f(w) + sum(l1 * |w|)``; ``f`` gives value, gradient and second derivatives."""
    value, g, h = f(w)
    total, scale = value + float(l1 @ np.abs(w)), max(1.0, float(np.abs(g).max(initial=0)))
    for _ in range(iterations):
        if np.abs(pseudo_gradient(w, g, l1)).max(initial=0) <= tolerance * scale:
            break
        move = model_minimum(w, g, h, l1) - w
        promised = float(g @ move + l1 @ (np.abs(w + move) - np.abs(w)))
        if promised >= 0:
            break
        length = 1.0
        for _ in range(40):
            tried = w + length * move
            new_value, new_g, new_h = f(tried)
            new_total = new_value + float(l1 @ np.abs(tried))
            if np.isfinite(new_total) and new_total <= total + 1e-4 * length * promised + 1e-15:
                break
            length /= 2
        else:
            break
        w, g, h, total = tried, new_g, new_h, new_total
        if -promised <= 1e-16:
            break
    return w


class PoissonRegression(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Counts by a log-linear model over ``features`` and ``label``."""

    l1 = Param(Params._dummy(), "l1", "l1 penalty", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "l2 penalty", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "steps at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, l1: float = 0.01, l2: float = 0.01, iterations: int = 100):
        super().__init__()
        self._setDefault(l1=0.01, l2=0.01, iterations=100)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PoissonModel:
        kept = df.select("features", F.col("label").cast("double").alias("label")).where("label is not null")
        stats = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), F.max(F.size(vector_to_array("features"))).alias("d")).first()
        n, d = stats["n"], stats["d"] or 0
        if not n:
            return PoissonModel([], 0.0)
        mean, wide = max(stats["mean"], 1e-9), d > NEWTON
        l1, l2 = self.getOrDefault("l1") / mean, self.getOrDefault("l2") / mean
        size = d + 2 + (0 if wide else (d + 1) ** 2)

        def f(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size)
                for x, y in blocks.opened(batches):
                    score, y = x @ w[:-1] + w[-1], y / mean
                    with np.errstate(over="ignore", invalid="ignore"):  # an infinite value is a step too far, which is taken back
                        more = np.expm1(score)
                        gap = more + (1 - y)
                        total[:d] += gap @ x
                        total[d] += gap.sum()
                        total[d + 1] += (more - y * score).sum()
                        if not wide:
                            whole = np.column_stack([x, np.ones(len(y))])
                            total[d + 2 :] += (whole.T @ (whole * (more + 1)[:, None])).ravel()
                yield sums.row(0, sums.partition(), total)

            total = sums.folded(rows.mapInArrow(run, sums.SCHEMA), parts, 1, size)[0] / n
            bare = np.append(w[:-1], 0.0)
            second = total[:0] if wide else total[d + 2 :].reshape(d + 1, -1) + l2 * np.diag(np.append(np.ones(d), 0.0))
            return float(total[d + 1] + l2 / 2 * bare @ bare), total[: d + 1] + l2 * bare, second

        rows, path = blocks.stored(kept, d)
        try:
            parts, start, held = max(1, rows.rdd.getNumPartitions()), np.zeros(d + 1), np.append(np.full(d, l1), 0.0)
            limit = self.getOrDefault("iterations")
            w = minimise(lambda v: f(v)[:2], start, held, iterations=limit) if wide else newton(f, start, held, iterations=limit)
        finally:
            scratch.remove(df.sparkSession, path)
        return PoissonModel(w[:-1].tolist(), float(w[-1]) + math.log(mean))


class PoissonModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "weights", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept", TypeConverters.toFloat)

    def __init__(self, weights: list[float] | None = None, bias: float = 0.0):
        super().__init__()
        self._set(weights=weights or [], bias=float(bias))

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(x)) for x in self.getOrDefault("weights")])
        score = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda a, b: a * b), F.lit(self.getOrDefault("bias")), lambda a, x: a + x)
        return df.withColumn("prediction", F.exp(score))
