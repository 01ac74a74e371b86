"""Stochastic dual coordinate ascent for least squares, two classes and many classes, with an elastic net.

The objective is ``mean(loss) + l2 / 2 |w|^2 + l1 |w|_1``. Every row has a dual value beside its features, in a table of blocks that each round
writes anew, so that a lost executor costs a round's part at most. In
a round each partition goes through its rows in a seeded order and moves dual values as far as the dual's lower bound
allows (Shalev-Shwartz and Zhang 2014, prox-SDCA), a few rows together (mini-batches, Takac et al. 2015): a batch's moves are bounded by
its largest eigenvalue, so that their sum is safe, and its size by what costs little against one row at a time, which grows
with the rows. A partition sees its own moves at once and the others' at the end of the round: moves
are made as if all partitions made the same, so that their sum is safe to add (CoCoA+, Ma et al. 2015). A round also gives
the primal and dual objectives of the one before; their gap, which bounds the distance from the best objective, ends it. Partitions that differ a little make
the last digits slow, so with few weights the second-order model's least point is tried as well, by the same gap.

Squares are fitted to centred features and labels, so the intercept is free of any penalty; classifiers learn theirs as the
weight of a constant feature, with the l2 penalty but not the l1. Penalties may be for features of deviation 1, as MLlib's are. A partition's seed is its number and the round's, so a lost
executor's work is repeated as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.ml import orthant, sums
from brindle.ml.blocks import FILE_BYTES
from brindle.sources import scratch

_BLOCK = "x binary, y binary, alpha binary, rows int, moved binary, part int"
BLOCK_ROWS = 8_192
#: A batch's bound by its rows' norms, as a multiple of the loss's own; the bound that counts is a few times smaller.
BATCH = 4.0
#: Side of the matrices of products that bound a batch; larger ones leave it to the norms.
GRAM = 256
#: Weights up to which second derivatives are summed.
NEWTON = 128
LEAST_L2 = 1e-6
#: Rows that a partition should hold at least.
PART_ROWS = 5_000


class Squares:
    """Half the squared error; 1-smooth."""

    outputs, smooth = 1, 1.0

    def losses(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 0.5 * (z[:, 0] - y) ** 2

    def slopes(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Derivatives of the losses by the scores."""
        return z - y[:, None]

    def curves(self, z: np.ndarray) -> np.ndarray:
        """Second derivatives, ``(rows, outputs, outputs)``."""
        return np.ones((len(z), 1, 1))

    def moves(self, z: np.ndarray, a: np.ndarray, y: np.ndarray, norm: float) -> np.ndarray:
        """How far a batch's dual values move towards the negative gradient: as far as the dual's lower bound grows."""
        return (y[:, None] - z - a) / (1 + norm)

    def conjugates(self, alpha: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The conjugate of the loss at ``-alpha``."""
        return 0.5 * alpha[:, 0] ** 2 - alpha[:, 0] * y


def _entropy(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0.0)


def _step(gap: np.ndarray, size: np.ndarray, smooth: float, norm: float) -> np.ndarray:
    """The share of the way that lifts the dual's lower bound most (prox-SDCA, option III)."""
    return np.clip((gap + smooth / 2 * size) / np.maximum(size * (smooth + norm), 1e-300), 0.0, 1.0)


class TwoClasses:
    """Logistic loss of labels 0 and 1; a quarter-smooth."""

    outputs, smooth = 1, 4.0

    def losses(self, z, y):
        return np.logaddexp(0, np.where(y > 0, -z[:, 0], z[:, 0]))

    def slopes(self, z, y):
        return 1 / (1 + np.exp(np.clip(-z, -700.0, 700.0))) - (y > 0)[:, None]

    def curves(self, z):
        p = 1 / (1 + np.exp(np.clip(-z, -700.0, 700.0)))
        return (p * (1 - p))[:, :, None]

    def moves(self, z, a, y, norm):
        sign = np.where(y > 0, 1.0, -1.0)
        m, b = sign * z[:, 0], np.clip(sign * a[:, 0], 0.0, 1.0)
        q = 1 / (1 + np.exp(np.clip(m, -700.0, 700.0))) - b
        gap = np.logaddexp(0, -m) + m * b + _entropy(b) + _entropy(1 - b)
        return (sign * q * _step(gap, q * q, self.smooth, norm))[:, None]

    def conjugates(self, alpha, y):
        p = np.clip(np.where(y > 0, alpha[:, 0], -alpha[:, 0]), 0, 1)
        return _entropy(p) + _entropy(1 - p)


class ManyClasses:
    """Softmax loss of class numbers; a half-smooth."""

    smooth = 2.0

    def __init__(self, classes: int):
        self.outputs = classes

    def losses(self, z, y):
        top = z.max(axis=1)
        return top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(z)), y.astype(int)]

    def _shares(self, z):
        e = np.exp(z - z.max(axis=1)[:, None])
        return e / e.sum(axis=1)[:, None]

    def slopes(self, z, y):
        p = self._shares(z)
        p[np.arange(len(z)), y.astype(int)] -= 1
        return p

    def curves(self, z):
        p = self._shares(z)
        return p[:, :, None] * np.eye(self.outputs) - p[:, :, None] * p[:, None, :]

    def moves(self, z, a, y, norm):
        at, hit = np.arange(len(z)), y.astype(int)
        top = z.max(axis=1)
        e = np.exp(z - top[:, None])
        total = e.sum(axis=1)
        q, p = -e / total[:, None] - a, -a
        q[at, hit] += 1
        p[at, hit] += 1
        gap = top + np.log(total) - z[at, hit] + (z * a).sum(axis=1) + _entropy(np.clip(p, 0, 1)).sum(axis=1)
        return q * _step(gap, (q * q).sum(axis=1), self.smooth, norm)[:, None]

    def conjugates(self, alpha, y):
        p = -alpha.copy()
        p[np.arange(len(p)), y.astype(int)] += 1
        return _entropy(np.clip(p, 0, 1)).sum(axis=1)


def primal(moved: np.ndarray, l1: float, l2: float, free: int) -> np.ndarray:
    """Weights (outputs, features) from the mean of dual values times features; the last ``free`` features have no l1."""
    w = np.sign(moved) * np.maximum(np.abs(moved) - l1, 0)
    if free:
        w[:, -free:] = moved[:, -free:]
    return w / l2


def batch_norms(x: np.ndarray, size: int) -> np.ndarray:
    """An upper bound of the largest eigenvalue of each batch's products of rows: their matrix's Frobenius norm, or its trace."""
    norms, cuts = (x * x).sum(axis=1), range(0, len(x), size)
    bounds = np.add.reduceat(norms, cuts)
    side, whole = min(size, x.shape[1]), len(x) // size
    if 1 < side <= GRAM and size > 1:
        rows = x[: whole * size].reshape(whole, size, -1)
        products = rows.transpose(0, 2, 1) @ rows if size >= x.shape[1] else rows @ rows.transpose(0, 2, 1)
        bounds[:whole] = np.minimum(bounds[:whole], np.sqrt((products * products).sum(axis=(1, 2))))
    return bounds


def local_round(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, moved: np.ndarray, loss, n: int, l1: float, l2: float, free: int, share: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over a partition's rows. ``moved`` is what all rows have moved so far, plus ``share`` times what these do now."""
    x, y, after = np.ascontiguousarray(x[order]), y[order], alpha[order]
    size = int(max(1.0, min(len(x), BATCH * loss.smooth * l2 * n / (share * max(float((x * x).sum()) / len(x), 1e-300)))))
    own, seen = np.zeros_like(moved), moved.copy()
    w = primal(seen, l1, l2, free)
    for k, norm in enumerate(batch_norms(x, size) * (share / (l2 * n))):
        at = slice(k * size, (k + 1) * size)
        move = loss.moves(x[at] @ w.T, after[at], y[at], norm)
        after[at] += move
        push = move.T @ x[at] / n
        own += push
        seen += share * push
        w = primal(seen, l1, l2, free) if l1 else seen / l2
    alpha = np.empty_like(after)
    alpha[order] = after
    return alpha, own


@dataclass
class Fit:
    weights: np.ndarray
    gap: float
    objective: float
    rounds: int


def _blocks(rows: DataFrame, n: int, shift: np.ndarray, scale: np.ndarray, shift_y: float, constant: bool, outputs: int) -> DataFrame:
    """Centred features and labels with dual values of 0, in blocks by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        part = sums.partition()

        def block():
            x, y = (np.concatenate(v) for v in zip(*held))
            held.clear()
            return _packed(x, y, np.zeros((len(y), outputs)), None, part)

        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = (x - shift) / scale
                held.append((np.hstack([x, np.ones((len(x), 1))]) if constant else x, batch.column(1).to_numpy(zero_copy_only=False) - shift_y))
                if sum(len(v) for _, v in held) >= BLOCK_ROWS:
                    yield block()
        if held:
            yield block()

    spread = rows.select(vector_to_array("features").alias("x"), "label")
    # Few rows in many partitions learn little from one another; many in few leave cores idle.
    wanted, parts = min(rows.sparkSession.sparkContext.defaultParallelism, max(1, n // PART_ROWS)), spread.rdd.getNumPartitions()
    if parts < wanted:
        spread = spread.repartition(wanted)
    elif n < parts * PART_ROWS:
        spread = spread.coalesce(wanted)
    return spread.mapInArrow(run, _BLOCK)


def _packed(x, y, alpha, moved, part) -> pa.RecordBatch:
    # Features lie column by column, which compresses well.
    data = lambda v, order="C": pa.array([None if v is None else v.tobytes(order=order)], pa.binary())
    return pa.RecordBatch.from_pydict({"x": data(x, "F"), "y": data(y), "alpha": data(alpha), "rows": pa.array([0 if y is None else len(y)], pa.int32()), "moved": data(moved), "part": pa.array([part], pa.int32())})


def _model_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, loss) -> np.ndarray:
    """First and second derivatives of a block's losses by the weights."""
    k, d = loss.outputs, x.shape[1]
    curves, second = loss.curves(z), np.empty((k, d, k, d))
    for a in range(k):
        for c in range(a, k):
            second[a, :, c] = (x.T * curves[:, a, c]) @ x
            second[c, :, a] = second[a, :, c].T
    return np.concatenate([(loss.slopes(z, y).T @ x).ravel(), second.ravel()])


def ascend(blocks: DataFrame, loss, n: int, features: int, l1: float, l2: float, *, free: int, rounds: int, tolerance: float, seed: int = 42) -> Fit:
    """Rounds until the gap is at most ``tolerance`` times the objective of no weights, or there have been ``rounds``.

    With up to ``NEWTON`` weights a round also sums the derivatives at its weights. The least point of that second-order model,
    l1 included, and the dual values that belong to it are tried in the next round; the best objective and the best bound count."""
    spark, moved = blocks.sparkSession, np.zeros((loss.outputs, features))
    file_rows = max(1, FILE_BYTES // (8 * BLOCK_ROWS * (features + 1 + loss.outputs)))
    (current, path), first, shape, size = scratch.stored(blocks, file_rows), None, moved.shape, moved.size
    narrow, n = size <= NEWTON, max(n, 1)
    held = np.full(shape, l1)
    held[:, features - free :] = 0.0
    numbers = (size + 2) * 2 + (size + size * size if narrow else 0)
    best, bound, tried = None, -np.inf, None

    def penalty(w: np.ndarray) -> float:
        return l2 / 2 * float((w * w).sum()) + float((held * np.abs(w)).sum())

    try:
        for round_ in range(rounds + 1):
            last = round_ == rounds
            parts = max(1, current.rdd.getNumPartitions())  # how many passes run side by side, at most

            def run(batches: Iterator[pa.RecordBatch], moved=moved, round_=round_, parts=parts, tried=tried) -> Iterator[pa.RecordBatch]:
                w, part = primal(moved, l1, l2, free), sums.partition()
                total, seen, met = np.zeros(numbers), moved.copy(), 0
                for batch in batches:
                    for i in range(batch.num_rows):
                        rows = batch.column("rows")[i].as_py()
                        if not rows:
                            continue
                        x, y, alpha = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64) for c in ("x", "y", "alpha"))
                        x, alpha = x.reshape(-1, rows).T, alpha.reshape(rows, -1)
                        z = x @ w.T
                        total[size] += loss.losses(z, y).sum()
                        total[size + 1] += loss.conjugates(alpha, y).sum()
                        if tried is not None:
                            z_tried = x @ tried.T
                            dual = -loss.slopes(z_tried, y)
                            total[size + 2 : 2 * size + 4] += np.concatenate([(dual.T @ x).ravel(), [loss.losses(z_tried, y).sum(), loss.conjugates(dual, y).sum()]])
                        if narrow:
                            total[2 * size + 4 :] += _model_sums(x, y, z, loss)
                        order = np.random.default_rng([seed, round_, part, met]).permutation(rows)
                        met += 1
                        alpha, mine = local_round(x, y, alpha, seen, loss, n, l1, l2, free, parts, order)
                        total[:size] += mine.ravel()
                        seen = seen + parts * mine
                        yield _packed(x, y, alpha, None, part)
                yield _packed(None, None, None, total, part)

            before = path
            current, path = scratch.stored(current.mapInArrow(run, _BLOCK), file_rows)
            scratch.remove(spark, before)
            told = current.where("moved is not null").select(F.lit(0).alias("key"), "part", F.col("moved").alias("sums"))
            total = sums.folded(told, parts, 1, numbers).get(0, np.zeros(numbers))
            pairs = [(primal(moved, l1, l2, free), total[size], total[size + 1], moved)]
            if tried is not None:
                pairs.append((tried, total[2 * size + 2], total[2 * size + 3], total[size + 2 : 2 * size + 2].reshape(shape) / n))
            for w, losses, conjugates, dual in pairs:
                objective = losses / n + penalty(w)
                if best is None or objective < best[0]:
                    best = objective, w
                implied = primal(dual, l1, l2, free)
                bound = max(bound, -conjugates / n - l2 / 2 * float((implied * implied).sum()))
            first = best[0] if first is None else first
            if best[0] - bound <= tolerance * max(first, 1e-300) or last:
                break
            if narrow:
                w, model = pairs[0][0].ravel(), total[2 * size + 4 :] / n
                tried = orthant.model_minimum(w, model[:size] + l2 * w, model[size:].reshape(size, size) + l2 * np.eye(size), held.ravel()).reshape(shape)
            moved = moved + total[:size].reshape(shape)
    finally:
        scratch.remove(spark, path)
    return Fit(best[1], best[0] - bound, best[0], round_)


class DualAscent(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Linear models by dual coordinate ascent over ``features`` and ``label``."""

    loss = Param(Params._dummy(), "loss", "squares, two or many", TypeConverters.toString)
    l1 = Param(Params._dummy(), "l1", "l1 penalty", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "l2 penalty, 1e-6 at least", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "rounds at most", TypeConverters.toInt)
    standardize = Param(Params._dummy(), "standardize", "whether penalties are for centred features of deviation 1", TypeConverters.toBoolean)
    tolerance = Param(Params._dummy(), "tolerance", "gap as a share of the objective without weights", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, loss: str = "squares", l1: float = 0.01, l2: float = 0.01, rounds: int = 100, tolerance: float = 1e-4, standardize: bool = False):
        super().__init__()
        self._setDefault(loss="squares", l1=0.01, l2=0.01, rounds=100, tolerance=1e-4, standardize=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DualModel:
        p = self.getOrDefault
        kept = df.select("features", F.col("label").cast("double").alias("label")).where("label is not null")
        stats = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"), F.max("label").alias("top"), F.max(F.size(vector_to_array("features"))).alias("d")).first()
        d = stats["d"] or 0
        squares = p("loss") == "squares"
        loss = Squares() if squares else TwoClasses() if p("loss") == "two" else ManyClasses(int(stats["top"] or 0) + 1)
        shift, scale = np.zeros(d), np.ones(d)
        if d and (squares or p("standardize")):
            known = kept.agg(Summarizer.mean(F.col("features")).alias("x"), Summarizer.std(F.col("features")).alias("s")).first()
            shift = known["x"].toArray()
            if p("standardize"):
                scale = np.where(known["s"].toArray() > 0, known["s"].toArray(), 1.0)
        shift_y, free = (stats["y"] or 0.0, 0) if squares else (0.0, 1)
        if not stats["n"]:
            return DualModel(np.zeros((loss.outputs, d)).ravel().tolist(), [0.0] * loss.outputs, p("loss"), 0.0, 0.0)
        blocks = _blocks(kept, stats["n"], shift, scale, shift_y, not squares, loss.outputs)
        fit = ascend(blocks, loss, stats["n"], d + free, p("l1"), max(p("l2"), LEAST_L2), free=free, rounds=p("rounds"), tolerance=p("tolerance"))
        w = fit.weights[:, :d] / scale
        bias = ((shift_y if squares else fit.weights[:, d]) - w @ shift).tolist()
        return DualModel(w.ravel().tolist(), bias, p("loss"), fit.gap, fit.objective)


class DualModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "weights by output", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept by output", TypeConverters.toListFloat)
    loss = Param(Params._dummy(), "loss", "squares, two or many", TypeConverters.toString)
    gap = Param(Params._dummy(), "gap", "duality gap of the fit", TypeConverters.toFloat)
    objective = Param(Params._dummy(), "objective", "objective of the fit", TypeConverters.toFloat)

    def __init__(self, weights: list[float] | None = None, bias: list[float] | None = None, loss: str = "squares", gap: float = 0.0, objective: float = 0.0):
        super().__init__()
        self._set(weights=weights or [], bias=bias or [0.0], loss=loss, gap=float(gap), objective=float(objective))

    def _transform(self, df: DataFrame) -> DataFrame:
        bias = self.getOrDefault("bias")
        w = np.array(self.getOrDefault("weights")).reshape(len(bias), -1)
        x = vector_to_array("features")
        score = lambda k: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[k]]), lambda a, b: a * b), F.lit(float(bias[k])), lambda s, v: s + v)
        if self.getOrDefault("loss") == "squares":
            return df.withColumn("prediction", score(0))
        if self.getOrDefault("loss") == "two":
            p = 1 / (1 + F.exp(-F.col("_score")))
            return df.withColumn("_score", score(0)).withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (F.col("_score") > 0).cast("double")).drop("_score")
        found = df.withColumn("_scores", F.array(*[score(k) for k in range(len(bias))]))
        e = F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores")))
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        found = found.withColumn("probability", array_to_vector(F.transform(e, lambda v: v / total)))
        return found.withColumn("prediction", (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double")).drop("_scores")
