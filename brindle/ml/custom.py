"""Learners that MLlib lacks: averaged perceptron, SGD regression, PCA anomalies, spikes, singular spectrum forecasts.

Iterative learners mix parameters: each pass runs over every partition on its own and the partitions' weights, a few
numbers, are averaged (McDonald et al. 2010). No rows leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.ml import blocks, sums
from brindle.sources import scratch

#: Rows of a partition for each lane of a pass, and lanes at most.
LANE_ROWS = 16_384
LANES = 64


class _LinearModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A weight vector and bias, applied as an expression."""

    weights = Param(Params._dummy(), "weights", "weights", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "bias", TypeConverters.toFloat)
    classify = Param(Params._dummy(), "classify", "whether to emit classes", TypeConverters.toBoolean)

    def __init__(self, weights: list[float] | None = None, bias: float = 0.0, classify: bool = False):
        super().__init__()
        self._set(weights=[float(w) for w in weights or []], bias=float(bias), classify=bool(classify))

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(x) for x in self.getOrDefault("weights")])
        dot = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) + F.lit(self.getOrDefault("bias"))
        if not self.getOrDefault("classify"):
            return df.withColumn("prediction", dot)
        return df.withColumn("_score", dot).withColumn("prediction", (F.col("_score") > 0).cast("double")).drop("_score")


class _Mixing(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    rate = Param(Params._dummy(), "rate", "step size", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "passes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rate: float = 0.1, epochs: int = 10):
        super().__init__()
        self._setDefault(rate=0.1, epochs=10)
        self._set(**self._input_kwargs)

    _classify = False

    @staticmethod
    def _step(w, b, x, y, rate, t):
        """Weights and bias after a block of rows, and their sums over the rows."""
        raise NotImplementedError

    def _block(self) -> int:
        """How many rows a step takes."""
        return 256

    def _pass(self, w: np.ndarray, b: float, held: Iterator[tuple[np.ndarray, np.ndarray]], epoch: int, lanes: int) -> np.ndarray:
        """Sums over the rows of weights and bias after each step, and the number of rows, of one partition's pass."""
        rate, block, mine, bias = self.getOrDefault("rate"), self._block(), w.copy(), b
        total = np.zeros(len(w) + 2)
        for xs, ys in held:
            for at in range(0, len(ys), block):
                x, y = xs[at : at + block], ys[at : at + block]
                mine, bias, summed, summed_bias = self._step(mine, bias, x, y, rate, epoch)
                total += [*summed, summed_bias, len(y)]
        return total

    def _fit(self, df: DataFrame) -> _LinearModel:
        kept = df.select("features", F.col("label").cast("double").alias("label")).where("label is not null")
        stats = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("features"))).alias("d")).first()
        size = stats["d"] or 0
        w, b = np.zeros(size), 0.0
        rows, path = blocks.stored(kept, size)
        try:
            parts = max(1, rows.rdd.getNumPartitions())
            lanes = max(1, min(LANES, stats["n"] // parts // LANE_ROWS))
            for epoch in range(self.getOrDefault("epochs") if stats["n"] else 0):

                def run(batches: Iterator[pa.RecordBatch], w=w, b=b, epoch=epoch) -> Iterator[pa.RecordBatch]:
                    total = self._pass(w, b, blocks.opened(batches), epoch, lanes)
                    if total[-1]:
                        yield sums.row(0, sums.partition(), total)

                total = sums.folded(rows.mapInArrow(run, sums.SCHEMA), parts, 1, size + 2)[0]
                w, b = total[:size] / total[-1], float(total[size] / total[-1])
        finally:
            scratch.remove(df.sparkSession, path)
        return _LinearModel(w.tolist(), b, self._classify)


class AveragedPerceptron(_Mixing):
    """A perceptron whose weights are averaged over all steps and partitions."""

    _classify = True

    @staticmethod
    def _step(w, b, x, y, rate, t):
        # Row by row, but in leaps from mistake to mistake: each adds its row of inner products to all margins.
        sign, margin, near = np.where(y > 0, 1.0, -1.0), x @ w + b, x @ x.T + 1
        push, at = np.zeros(len(y)), 0
        while len(wrong := np.flatnonzero(sign[at:] * margin[at:] <= 0)):
            at += wrong[0]
            push[at] = rate * sign[at]
            margin = margin + push[at] * near[at]
            at += 1
        stays = push * np.arange(len(y), 0, -1)
        return w + push @ x, b + push.sum(), len(y) * w + stays @ x, len(y) * b + stays.sum()


class SgdRegression(_Mixing):
    """Least squares by stochastic gradient steps that shrink with the passes and with the features' norm."""

    def _block(self) -> int:
        # Together the rows of a block take no more than one full step.
        return max(1, min(64, int(0.5 / max(self.getOrDefault("rate"), 1e-9))))

    def _pass(self, w, b, held, epoch, lanes):
        # Lanes are parts within a part: each goes through its own rows from the same start, all a step at a time.
        rate, block = self.getOrDefault("rate") / (1 + 0.1 * epoch), self._block()
        mine, bias, total = np.tile(w, (lanes, 1)), np.full(lanes, b), np.zeros(len(w) + 2)
        for xs, ys in held:
            scale = 2 * rate / (1 + (xs * xs).sum(axis=1))
            whole = len(ys) // lanes
            x, y, scales = (np.ascontiguousarray(v[: whole * lanes]).reshape(lanes, whole, *v.shape[1:]) for v in (xs, ys, scale))
            for at in range(0, whole, block):
                part = x[:, at : at + block]
                move = (y[:, at : at + block] - (part @ mine[:, :, None])[:, :, 0] - bias[:, None]) * scales[:, at : at + block]
                mine = mine + (move[:, None, :] @ part)[:, 0]
                bias = bias + move.sum(axis=1)
                n = part.shape[1]
                total[:-2] += n * mine.sum(axis=0)
                total[-2:] += n * bias.sum(), n * lanes
            for at in range(whole * lanes, len(ys), block):  # fewer rows than lanes: the first one's
                part = xs[at : at + block]
                move = (ys[at : at + block] - part @ mine[0] - bias[0]) * scale[at : at + block]
                mine[0] += move @ part
                bias[0] += move.sum()
                total += [*(len(part) * mine[0]), len(part) * bias[0], len(part)]
        return total


class PcaAnomaly(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """How far a row lies from the first components' subspace, which a seeded sketch finds (Halko, Martinsson and Tropp 2011).

    ``rank + oversampling`` random directions are multiplied by the covariance ``powers`` times, a pass over the rows each, and
    made orthonormal in between; a last pass sums the rows' products in that basis, whose first axes are the components.
    Sums are features x directions at most: the covariance itself is never formed. With as many directions as features
    the result is exact."""

    rank = Param(Params._dummy(), "rank", "components", TypeConverters.toInt)
    oversampling = Param(Params._dummy(), "oversampling", "further directions of the sketch", TypeConverters.toInt)
    powers = Param(Params._dummy(), "powers", "passes that multiply by the covariance", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rank: int = 5, oversampling: int = 20, powers: int = 4):
        super().__init__()
        self._setDefault(rank=5, oversampling=20, powers=4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        from pyspark.ml.stat import Summarizer

        if not df.select("features").limit(1).count():
            return PcaAnomalyModel()
        mean = df.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
        d, rank = len(mean), min(self.getOrDefault("rank"), len(mean))
        wide = min(d, rank + max(0, self.getOrDefault("oversampling")))
        rows = df.select(vector_to_array("features").alias("x")).persist()
        parts = max(1, rows.rdd.getNumPartitions())

        def summed(w: np.ndarray, last: bool) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((w.shape[1] if last else d, w.shape[1]))
                for batch in batches:
                    if batch.num_rows:
                        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean
                        t = x @ w
                        total += (t if last else x).T @ t
                yield sums.row(0, sums.partition(), total)

            return sums.folded(rows.mapInArrow(run, sums.SCHEMA), parts, 1, d * wide)[0].reshape(-1, wide)

        try:
            w = np.linalg.qr(np.random.default_rng(42).normal(size=(d, wide)))[0]
            for _ in range(self.getOrDefault("powers") if wide < d else 0):
                w = np.linalg.qr(summed(w, False))[0]
            values, turn = np.linalg.eigh(summed(w, True))
        finally:
            rows.unpersist()
        first = w @ turn[:, np.argsort(-values, kind="stable")[:rank]]
        return PcaAnomalyModel([float(x) for x in mean], first.T.tolist())


class PcaAnomalyModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "feature means", TypeConverters.toListFloat)
    components = Param(Params._dummy(), "components", "components by row", TypeConverters.toListListFloat)

    def __init__(self, mean: list[float] | None = None, components: list[list[float]] | None = None):
        super().__init__()
        self._set(mean=mean or [], components=components or [])

    def _transform(self, df: DataFrame) -> DataFrame:
        vector = lambda v: F.array(*[F.lit(float(x)) for x in v])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        wide = df.withColumn("_x", F.zip_with(vector_to_array("features"), vector(self.getOrDefault("mean")), lambda a, b: a - b))
        norm = dot(F.col("_x"), F.col("_x"))
        kept = sum((F.pow(dot(F.col("_x"), vector(c)), F.lit(2.0)) for c in self.getOrDefault("components")), F.lit(0.0))
        return wide.withColumn("prediction", F.sqrt(F.greatest(norm - kept, F.lit(0.0)))).drop("_x")


#: The least deviation that a history counts as having.
LEAST_DEVIATION = 1e-6


def upper_tail(z: Column) -> Column:
    """Share of the normal distribution above ``z`` by Abramowitz and Stegun 26.2.17 (error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    beyond = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, 1 - beyond).otherwise(beyond)


def kernel_p(past: list[float], value: float) -> float:
    """The two-sided p-value of ``value`` under the kernel density of ``past``: one normal kernel a value, as wide as their deviation."""
    n = len(past)
    if n < 3:
        return 1.0
    mean = sum(past) / n
    width = max(LEAST_DEVIATION, math.sqrt(sum((x - mean) ** 2 for x in past) / n))
    above = sum(math.erfc((value - x) / width / math.sqrt(2)) / 2 for x in past) / n
    return min(1.0, max(0.0, 2 * min(above, 1 - above)))


def spikes(df: DataFrame, column: str, order: str | list[str], confidence: float = 95.0, history: int = 30, by: list[str] | None = None) -> DataFrame:
    """``alert``, ``spike_score`` and ``p_value`` of each value against the ``history`` values before it in its series.

    A value's p-value is twice the smaller of the kernel density's two tails beyond it (``kernel_p``, which streams
    use). A gap uses up a row of the history; with fewer than 3 values in it a value has p-value 1, as a gap has. Name the series in
    ``by``: a series is one window, of which a row sees ``history`` values at most."""
    order = [order] if isinstance(order, str) else order
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(-history, -1)
    v = F.col(column).cast("double")
    held = df.withColumn("_sp_past", F.collect_list(v).over(window)).withColumn("_sp_width", F.greatest(F.stddev_pop(v).over(window), F.lit(LEAST_DEVIATION)))
    n = F.size("_sp_past")
    above = F.try_divide(F.aggregate("_sp_past", F.lit(0.0), lambda s, x: s + upper_tail((v - x) / F.col("_sp_width"))), n)
    p = F.when((n < 3) | v.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.least(above, 1 - above))))
    scored = held.withColumn("spike_score", F.coalesce(v, F.lit(0.0))).withColumn("p_value", p).withColumn("alert", (F.col("p_value") < 1 - confidence / 100).cast("int"))
    return scored.drop("_sp_past", "_sp_width")


#: Values of a series that a task may hold.
LONG = 20_000


def ssa_forecast(values: np.ndarray, window: int, horizon: int) -> np.ndarray:
    """Recurrent singular spectrum forecast (Golyandina 2001) keeping singular values over 2.858 medians (Gavish and Donoho 2014)."""
    lagged = np.lib.stride_tricks.sliding_window_view(values, window).T
    return recurrent_forecast(lagged @ lagged.T, values[-(2 * window - 2) :], window, horizon)


def recurrent_forecast(moments: np.ndarray, tail: np.ndarray, window: int, horizon: int) -> np.ndarray:
    """The forecast from the lagged vectors' products, summed over the series, and the series' last ``2 * window - 2`` values.

    Only the last ``window - 1`` rebuilt values are used, and all lagged vectors that hold one of these lie in the tail."""
    u, s, _ = np.linalg.svd(moments)
    s = np.sqrt(s)
    rank = min(max(1, int((s > max(2.858 * np.median(s), 1e-6 * s[0])).sum())), window - 1)
    u = u[:, :rank]
    lagged = np.lib.stride_tricks.sliding_window_view(tail, window).T
    rebuilt, counts = np.zeros(len(tail)), np.zeros(len(tail))
    low = u @ (u.T @ lagged)
    for i in range(window):
        rebuilt[i : i + low.shape[1]] += low[i]
        counts[i : i + low.shape[1]] += 1
    series = list((rebuilt / counts)[-(window - 1) :])
    last = u[-1]
    norm = float(last @ last)
    if norm >= 1 - 1e-9:
        return np.full(horizon, series[-1])
    weights = (u[:-1] @ last) / (1 - norm)
    for _ in range(horizon):
        series.append(float(weights @ np.array(series[-(window - 1) :])))
    return np.array(series[-horizon:])


def forecast(df: DataFrame, column: str, order: str, horizon: int = 7, window: int = 14, series_length: int = 60, by: list[str] | None = None) -> DataFrame:
    """``(by..., step, forecast)`` for each series, from its last ``series_length`` values by ``order``.

    A window function keeps just those values before any series is gathered, so a group holds ``series_length`` rows at
    most; where that is more than ``LONG`` values, ``series.forecast`` cuts the series in pieces. A series shorter than twice
    the window is refused."""
    if max(series_length, 2 * window) > LONG:
        from brindle.ml import series

        return series.forecast(df, column, order, horizon, window, series_length, by)
    keys = by or ["_series"]
    rows = df.select(*(by or [F.lit(0).alias("_series")]), F.col(column).cast("double").alias("_v"), F.col(order).alias("_o")).where("_v is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_o")))
    kept = rows.withColumn("_k", rank).where(F.col("_k") <= max(series_length, 2 * window))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("_k", ascending=False)["_v"].to_numpy()
        if len(values) < 2 * window:
            raise ValueError(f"The series has {len(values)} values; a window of {window} needs {2 * window}.")
        found = ssa_forecast(values, window, horizon)
        return pd.DataFrame({k: part[k].iloc[0] for k in keys} | {"step": range(1, horizon + 1), "forecast": found})[[*keys, "step", "forecast"]]

    schema = ", ".join([*(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys), "step int", "forecast double"])
    out = kept.groupBy(*keys).applyInPandas(run, schema)
    return out if by else out.drop("_series")
