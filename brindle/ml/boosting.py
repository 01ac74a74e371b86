"""Boosted trees grown leaf by leaf on histograms: losses for numbers, two classes, many classes and Tweedie counts.

Features become codes of at most 256 quantile bins, packed by partition into blocks that stay cached. A tree starts as one
leaf; the leaf whose best split gains most is split next, until there are ``numberOfLeaves``. A pass over the blocks sums
gradients, Hessians and rows by node, feature and bin for the smaller child of every split that may come next, so
that one pass serves a whole frontier; partitions' sums are folded by tasks, and the larger child is parent less sibling. The
result is the tree that one split after the other would give. What reaches the driver is nodes x features x bins numbers,
however many rows there are. Sums are taken in the order of the partitions, so a lost executor changes nothing.

Scores are kept beside the codes in a table that every other tree writes anew, so lineage stays short.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.ml import sums
from brindle.ml.blocks import FILE_BYTES
from brindle.sources import scratch

BINS = 256
BLOCK_ROWS = 16_384
#: Trees after which scores are stored anew; until then they are applied on the way.
REFRESH = 2
#: Features whose sums travel in one row.
CHUNK = 64
LEAST_HESSIAN = 1e-3
_BLOCK = "codes binary, label binary, score binary, rows int"


# ---- losses --------------------------------------------------------------------------------------------------------


class Loss:
    """Gradient and Hessian of a row's loss by its scores, ``(outputs, rows)`` each, and a leaf's value from its sums."""

    outputs = 1

    def start(self, mean: np.ndarray) -> list[float]:
        """Scores before any tree, from the label's mean (the classes' shares if there are more)."""
        return [float(mean[0])]

    def steps(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score - y, np.ones_like(score)

    def value(self, g: float, h: float) -> float:
        return -g / max(h, 1e-300)

    def answer(self, score: np.ndarray) -> np.ndarray:
        """Predictions from scores: a number, or the classes' probabilities."""
        return score


class Squared(Loss):
    pass


class Logistic(Loss):
    def start(self, mean):
        p = min(max(float(mean[0]), 1e-9), 1 - 1e-9)
        return [math.log(p / (1 - p))]

    def steps(self, score, y):
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)

    def answer(self, score):
        p = 1 / (1 + np.exp(-score))
        return np.concatenate([1 - p, p])


class Softmax(Loss):
    def __init__(self, classes: int):
        self.outputs = classes

    def start(self, mean):
        return np.log(np.maximum(mean, 1e-9)).tolist()

    def steps(self, score, y):
        p = self.answer(score)
        hit = np.arange(self.outputs)[:, None] == y
        # The off-diagonal part of the Hessian is made up for by this factor (Friedman, Hastie and Tibshirani 2000).
        return p - hit, p * (1 - p) * self.outputs / max(self.outputs - 1, 1)

    def answer(self, score):
        e = np.exp(score - score.max(axis=0))
        return e / e.sum(axis=0)


class Tweedie(Loss):
    """Deviance of variance power 1.5 under a log link. A leaf's value is the exact minimum along its own line."""

    power = 1.5
    farthest = 5.0

    def start(self, mean):
        return [math.log(max(float(mean[0]), 1e-9))]

    def steps(self, score, y):
        a, b = y * np.exp((1 - self.power) * score), np.exp((2 - self.power) * score)
        return b - a, (self.power - 1) * a + (2 - self.power) * b

    def value(self, g, h):
        # The sums of y exp((1-p) F) and exp((2-p) F), of which g and h are combinations; their ratio is exp(best step).
        a, b = h - (2 - self.power) * g, h + (self.power - 1) * g
        return min(max(math.log(max(a, 1e-300) / max(b, 1e-300)), -self.farthest), self.farthest)

    def answer(self, score):
        return np.exp(score)


# ---- trees ---------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in order of creation; a leaf's feature is -1. A code up to ``bin`` goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, bin
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for mine, filler in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            mine += [filler, filler]
        return self.left[node], self.right[node]

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node in which each column of ``codes(features, rows)`` ends."""
        feature, bin_, left, right = (np.array(v) for v in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        while len(rows):
            node = at[rows]
            f = feature[node]
            rows, node, f = rows[f >= 0], node[f >= 0], f[f >= 0]
            at[rows] = np.where(codes[f, rows] <= bin_[node], left[node], right[node])
        return at

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(codes)]

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of ``x(rows, features)`` as ``(features, rows)``: how many edges lie strictly below a value; a gap is in the last."""
    return np.stack([np.searchsorted(e, x[:, i], side="left").astype(np.uint8) for i, e in enumerate(edges)]) if edges else np.zeros((0, len(x)), np.uint8)


@dataclass(order=True)
class _Leaf:
    """A leaf with its sums and best split; ordered by gain, then by creation."""

    rank: tuple[float, int]
    node: int = field(compare=False)
    sums: np.ndarray = field(compare=False)  # features x bins x (gradient, Hessian, rows)
    split: tuple[int, int] | None = field(compare=False)
    children: tuple[_Leaf, _Leaf] | None = field(default=None, compare=False)


def best_split(sums: np.ndarray, least_rows: int) -> tuple[float, tuple[int, int] | None]:
    """The largest gain and its (feature, bin), the first of equal ones; no split without gain."""
    left = np.cumsum(sums, axis=1)
    total = left[:, -1:, :]
    right = total - left
    enough = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (sums[..., 2] > 0) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
    quotient = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-300)
    gain = np.where(enough, quotient(left) + quotient(right) - quotient(total), -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    most = float(gain.ravel()[at]) if gain.size else -np.inf
    if most <= 1e-9 * float(np.abs(quotient(total)).max(initial=1e-3)):
        return 0.0, None
    return most, divmod(at, sums.shape[1])


class _Grower:
    """One tree on its way: what the next pass must sum, and what its sums lead to."""

    def __init__(self, leaves: int, least_rows: int):
        self.tree, self.leaves, self.least_rows = Tree(), leaves, least_rows
        self.heap: list[_Leaf] = []
        self.spare = Tree()  # the tree with the splits that may come next, for the pass
        self.asked: dict[int, tuple[_Leaf, bool]] = {}  # node of the spare tree: whose smaller child it is, and whether the left
        self.root: _Leaf | None = None
        self.done = False
        self.made = 0

    def _leaf(self, node: int, sums: np.ndarray) -> _Leaf:
        gain, split = best_split(sums, self.least_rows)
        self.made += 1
        return _Leaf((-gain, self.made), node, sums, split)

    def requests(self) -> list[int]:
        """Nodes of ``spare`` to sum in the next pass."""
        if self.root is None:
            return [0]
        self.spare = Tree(*(list(v) for v in (self.tree.feature, self.tree.bin, self.tree.left, self.tree.right, self.tree.value)))
        self.asked = {}
        open_, room = list(self.heap), self.leaves - self.tree.leaves
        # Only the best so many leaves can still be split; all of them and their known children are looked ahead to.
        frontier = [(leaf, leaf.node) for leaf in sorted(open_)[:room]]
        while frontier:
            leaf, node = frontier.pop()
            if leaf.split is None:
                continue
            left, right = self.spare.split(node, *leaf.split)
            if leaf.children:
                frontier += [(leaf.children[0], left), (leaf.children[1], right)]
                continue
            f, b = leaf.split
            rows = leaf.sums[f, :, 2]
            smaller_left = rows[: b + 1].sum() * 2 <= rows.sum()
            self.asked[left if smaller_left else right] = leaf, bool(smaller_left)
        return list(self.asked)

    def take(self, found: dict[int, np.ndarray]) -> None:
        """Use the sums of the requested nodes, then split as far as they lead."""
        if self.root is None:
            self.root = self._leaf(0, found[0])
            self.heap = [self.root]
        for node, (leaf, smaller_left) in self.asked.items():
            small = found[node]
            rest = leaf.sums - small
            rest[..., 2] = np.maximum(rest[..., 2], 0)
            rest[rest[..., 2] == 0] = 0  # what rounding left in empty bins
            pair = (small, rest) if smaller_left else (rest, small)
            leaf.children = tuple(self._leaf(-1, s) for s in pair)
        self._split()

    def _split(self) -> None:
        while self.tree.leaves < self.leaves:
            if not self.heap or self.heap[0].split is None:
                break
            leaf = self.heap[0]
            last = self.tree.leaves + 1 == self.leaves
            if leaf.children is None and not last:
                return
            heapq.heappop(self.heap)
            left, right = self.tree.split(leaf.node, *leaf.split)
            if leaf.children is None:
                self._finish(last=(leaf, left, right))
                return
            for child, node in zip(leaf.children, (left, right)):
                child.node = node
                heapq.heappush(self.heap, child)
        self._finish()

    def _finish(self, last: tuple[_Leaf, int, int] | None = None) -> None:
        self.done = True
        self.totals = {leaf.node: leaf.sums[0].sum(axis=0) for leaf in self.heap}
        if last:
            leaf, left, right = last
            f, b = leaf.split
            self.totals[left] = leaf.sums[f, : b + 1].sum(axis=0)
            self.totals[right] = leaf.sums[f, b + 1 :].sum(axis=0)

    def finished(self, loss: Loss, rate: float) -> Tree:
        for node, (g, h, _) in self.totals.items():
            self.tree.value[node] = rate * loss.value(float(g), float(h))
        return self.tree


# ---- passes over the blocks ----------------------------------------------------------------------------------------


def _packed(edges: list[np.ndarray], start: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            codes = np.concatenate([c for c, _ in held], axis=1)
            y = np.concatenate([v for _, v in held])
            score = np.repeat(np.array(start), len(y))
            held.clear()
            return pa.RecordBatch.from_pydict({"codes": [codes.tobytes()], "label": [y.tobytes()], "score": [score.tobytes()], "rows": pa.array([len(y)], pa.int32())})

        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((codes_of(x, edges), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)))
                if sum(len(v) for _, v in held) >= BLOCK_ROWS:
                    yield block()
        if held:
            yield block()

    return run


def _opened(batches: Iterator[pa.RecordBatch], loss: Loss, newer: list[list[Tree]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, labels and current scores of each block."""
    for batch in batches:
        for i in range(batch.num_rows):  # one block at a time is copied
            codes, label, score = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("codes", np.uint8), ("label", np.float64), ("score", np.float64)))
            codes, score = codes.reshape(-1, len(label)), score.reshape(loss.outputs, -1).copy()
            for trees in newer:
                for k, tree in enumerate(trees):
                    score[k] += tree.scores(codes)
            yield codes, label, score


def _refreshing(loss: Loss, newer: list[list[Tree]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, label, score in _opened(batches, loss, newer):
            yield pa.RecordBatch.from_pydict({"codes": [codes.tobytes()], "label": [label.tobytes()], "score": [score.tobytes()], "rows": pa.array([len(label)], pa.int32())})

    return run


def _summing(loss: Loss, newer: list[list[Tree]], wanted: list[tuple[int, Tree, list[int]]], features: int):
    """A pass: sums of gradient, Hessian and rows by wanted node, feature and bin, one set a partition."""
    slots = sum(len(nodes) for _, _, nodes in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((slots, features, BINS, 3)), False
        for codes, label, score in _opened(batches, loss, newer):
            seen = True
            g, h = loss.steps(score, label)
            first = 0
            for k, tree, nodes in wanted:
                slot_of = np.full(len(tree.feature), -1)
                slot_of[nodes] = np.arange(len(nodes))
                slot = slot_of[tree.nodes(codes)]
                rows = np.flatnonzero(slot >= 0)
                at, gk, hk, size = slot[rows] * BINS, g[k, rows], h[k, rows], len(nodes) * BINS
                for f in range(features):
                    key = at + codes[f, rows]
                    for j, weights in enumerate((gk, hk, None)):
                        total[first : first + len(nodes), f, :, j] += np.bincount(key, weights, size).reshape(-1, BINS)
                first += len(nodes)
        if seen:
            part, cuts = sums.partition(), range(0, features, CHUNK)
            for slot in range(slots):
                for chunk, f in enumerate(cuts):
                    yield sums.row(slot * len(cuts) + chunk, part, total[slot, f : f + CHUNK])

    return run


def _summed(blocks: DataFrame, run, parts: int, features: int, slots: int) -> list[np.ndarray]:
    """The pass's sums by slot, over all partitions."""
    chunks = math.ceil(features / CHUNK)
    found = sums.folded(blocks.mapInArrow(run, sums.SCHEMA), parts, slots * chunks, min(features, CHUNK) * BINS * 3)
    out = [np.zeros((features, BINS, 3)) for _ in range(slots)]
    for key, values in found.items():
        slot, chunk = divmod(key, chunks)
        out[slot][chunk * CHUNK : (chunk + 1) * CHUNK] = values.reshape(-1, BINS, 3)
    return out


def quantile_edges(df: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins: its distinct quantiles without the largest value."""
    edges: list[np.ndarray] = []
    x = vector_to_array("features")
    for first in range(0, features, CHUNK):
        cuts = F.percentile_approx
        asked = [cuts(x[i], [j / bins for j in range(1, bins + 1)], 20 * bins).alias(f"q{i}") for i in range(first, min(first + CHUNK, features))]
        for found in df.agg(*asked).first():
            edges.append(np.unique(np.array(found or [], np.float64))[:-1])
    return edges


def grow(blocks: DataFrame, loss: Loss, features: int, *, trees: int, leaves: int, least_rows: int, rate: float) -> list[list[Tree]]:
    """Rounds of one tree an output."""
    spark, path, parts = blocks.sparkSession, None, max(1, blocks.rdd.getNumPartitions())
    found: list[list[Tree]] = []
    newer: list[list[Tree]] = []
    current, file_rows = blocks, max(1, FILE_BYTES // (BLOCK_ROWS * (features + 8 + 8 * loss.outputs)))
    try:
        for _ in range(trees):
            growers = [_Grower(leaves, least_rows) for _ in range(loss.outputs)]
            while open_ := [(k, g) for k, g in enumerate(growers) if not g.done]:
                wanted = [(k, nodes) for k, g in open_ if (nodes := g.requests())]
                asked = [(k, growers[k].spare, nodes) for k, nodes in wanted]
                slots = sum(len(nodes) for _, nodes in wanted)
                found_sums = iter(_summed(current, _summing(loss, newer, asked, features), parts, features, slots) if slots else [])
                answers = {k: {node: next(found_sums) for node in nodes} for k, nodes in wanted}
                for k, g in open_:
                    g.take(answers.get(k, {}))
            newer.append([g.finished(loss, rate) for g in growers])
            found.append(newer[-1])
            if all(t.leaves == 1 for t in newer[-1]):
                break
            if len(newer) == REFRESH and len(found) < trees:
                before = current, path
                current, path = scratch.stored(current.mapInArrow(_refreshing(loss, newer), _BLOCK), file_rows)
                current, newer = current.persist(StorageLevel.MEMORY_AND_DISK), []
                before[0].unpersist()
                scratch.remove(spark, before[1])
                parts = max(1, current.rdd.getNumPartitions())
    finally:
        current.unpersist()
        scratch.remove(spark, path)
    return found


# ---- the estimator -------------------------------------------------------------------------------------------------

LOSSES = {"squared": Squared, "logistic": Logistic, "tweedie": Tweedie}


class LeafwiseBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees with exactly ``leaves`` leaves each wherever the rows allow so many."""

    loss = Param(Params._dummy(), "loss", "squared, logistic, softmax or tweedie", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "rounds", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "leaves of a tree", TypeConverters.toInt)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a leaf", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, loss: str = "squared", trees: int = 100, leaves: int = 31, leastRows: int = 10, rate: float = 0.2):
        super().__init__()
        self._setDefault(loss="squared", trees=100, leaves=31, leastRows=10, rate=0.2)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LeafwiseModel:
        p = self.getOrDefault
        if p("leaves") < 2:
            raise ValueError("A tree needs at least 2 leaves.")
        kept = df.select("features", F.col("label").cast("double").alias("label")).where("label is not null")
        stats = kept.agg(F.max(F.size(vector_to_array("features"))).alias("d"), F.avg("label").alias("mean"), F.max("label").alias("top")).first()
        features = stats["d"] or 0
        if p("loss") == "softmax":
            classes = int(stats["top"] or 0) + 1
            shares = {int(r["label"]): r["count"] for r in kept.groupBy("label").count().collect()}
            loss: Loss = Softmax(classes)
            mean = np.array([shares.get(k, 0) for k in range(classes)]) / max(1, sum(shares.values()))
        else:
            loss, mean = LOSSES[p("loss")](), np.array([stats["mean"] or 0.0])
        edges, start = quantile_edges(kept, features), loss.start(mean)
        trees: list[list[Tree]] = []
        if features:
            blocks = kept.select(vector_to_array("features").alias("x"), "label").mapInArrow(_packed(edges, start), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
            trees = grow(blocks, loss, features, trees=p("trees"), leaves=p("leaves"), least_rows=p("leastRows"), rate=p("rate"))
        text = json.dumps({"loss": p("loss"), "start": start, "edges": [e.tolist() for e in edges], "trees": [[vars(t) for t in round_] for round_ in trees]})
        return LeafwiseModel(text)


class LeafwiseModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    model = Param(Params._dummy(), "model", "bin edges and trees as JSON", TypeConverters.toString)

    def __init__(self, model: str = "{}"):
        super().__init__()
        self._set(model=model)

    def read_out(self) -> tuple[Loss, list[float], list[np.ndarray], list[list[Tree]]]:
        m = json.loads(self.getOrDefault("model"))
        start = m["start"]
        loss = Softmax(len(start)) if m["loss"] == "softmax" else LOSSES[m["loss"]]()
        return loss, start, [np.array(e, np.float64) for e in m["edges"]], [[Tree(**t) for t in round_] for round_ in m["trees"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        loss, start, edges, trees = self.read_out()

        def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in parts:
                if not len(xs):
                    yield pd.Series([], dtype=object)
                    continue
                codes = codes_of(np.stack(xs.to_numpy()), edges)
                score = np.repeat(np.array(start)[:, None], len(xs), axis=1)
                for round_ in trees:
                    for k, tree in enumerate(round_):
                        score[k] += tree.scores(codes)
                yield pd.Series(list(loss.answer(score).T))

        answer = F.pandas_udf(answers, "array<double>")
        out = df.withColumn("_answer", answer(vector_to_array("features")))
        if isinstance(loss, Logistic):
            out = out.withColumn("probability", array_to_vector("_answer")).withColumn("prediction", (F.col("_answer")[1] > 0.5).cast("double"))
        elif isinstance(loss, Softmax):
            out = out.withColumn("probability", array_to_vector("_answer")).withColumn("prediction", (F.array_position("_answer", F.array_max("_answer")) - 1).cast("double"))
        else:
            out = out.withColumn("prediction", F.col("_answer")[0])
        return out.drop("_answer")
