"""Toxicity: a linear-chain conditional random field over words, trained on tokens labelled from document labels.

Sequences are sentences (ended by ``. ! ?`` or a line break) of any length; words are stripped of all outer punctuation
(of punctuation alone, one mark is left). A word's features are itself, its first 4, 5 and 6 bytes and its two neighbours,
hashed; transitions between the two states are learned too. Passes over long sequences go block by block: each block's
sums over paths are found for all blocks at once and then chained, which gives the same marginals.

Token labels come from the labelled documents: a word in a toxic document is toxic if it, or a prefix of it, occurs in at
least ``least`` toxic documents of the sample and ``odds`` times likelier there than in the others. At most
``sample_rows`` documents of each label are read (a documented bound), drawn by a hash of their id; they are dealt to
tasks of ``shard_rows`` rows or more, ``shards`` at most, that each fit by AdaGrad on the exact likelihood, and the weights are averaged.

A document's score joins the marginals from forward and backward passes: one minus the product of ``1 - p`` over words with
``p >= 0.2``, or the largest ``p`` if there are none. Words with ``p >= 0.5`` are reported by code-point offsets, end
exclusive, touching ones joined. Null and empty texts have no words and score 0. Without toxic labels every score is near 0.
Null labels are left out; of several labels of one id the largest counts. Other columns are kept; repeated rows score
alike, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common
from brindle.llm.quality import labelled_sample

#: Words of a sequence that are gone through one after the other.
BLOCK = 64
_SEEDS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PREFIXES = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_TRIM = np.ones(256, bool)
_TRIM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Words:
    """The words of many texts without outer punctuation, their hashes, and where sequences begin."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    own: np.ndarray  # a row per word: hash of the word and of its prefixes
    begin: np.ndarray  # first word of each sequence

    @classmethod
    def of(cls, texts: pa.Array) -> tuple[Words, np.ndarray]:
        data, offsets = common.utf8(texts)
        starts, ends, doc = common.word_spans(data, offsets)
        data = common.LOWER[data]
        stop = _ENDS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        lines = np.r_[0, np.cumsum(data == 10)]
        inner = np.r_[np.flatnonzero(~_TRIM[data]), len(data)]  # bytes that are no punctuation
        left, right = inner[np.searchsorted(inner, starts)], inner[np.searchsorted(inner, ends) - 1] + 1
        some = left < ends
        starts, ends = np.where(some, left, ends - 1), np.where(some, right, ends)
        fresh = np.ones(len(starts), bool)
        if len(starts):
            fresh[1:] = stop[:-1] | (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
        own = [common.span_hashes(data, starts, ends)] + [common.mix(common.span_hashes(data, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in _PREFIXES] if len(starts) else [np.zeros(0, np.uint64)] * 4
        return cls(doc, starts, ends, np.stack(own, axis=1), np.flatnonzero(fresh)), data

    def features(self, bits: int) -> np.ndarray:
        """A row of feature numbers per word; a neighbour beyond the sequence counts as a word of its own."""
        n = len(self.doc)
        word = self.own[:, 0]
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[self.begin] = 1
        after[np.r_[self.begin[1:], n] - 1] = 1
        columns = [self.own[:, 0], self.own[:, 1], self.own[:, 2], self.own[:, 3], common.mix(before * _SEEDS[0]), common.mix(after * _SEEDS[1])]
        return np.stack([(c >> np.uint64(64 - bits)).astype(np.int32) for c in columns], axis=1)


@dataclass
class CrfModel:
    weights: np.ndarray
    bias: float
    move: np.ndarray  # from state, to state
    bits: int


def _ahead(found: np.ndarray, emission: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> None:
    """Fill forward scores behind those of each run's first word; all runs advance together, longest first."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    for t in range(1, int(size[0]) if len(size) else 0):
        at = start[: np.searchsorted(-size, -t, side="left")] + t
        o, x = found[at - 1, 0], found[at - 1, 1]
        found[at, 0] = np.logaddexp(o + move[0, 0], x + move[1, 0])
        found[at, 1] = emission[at] + np.logaddexp(o + move[0, 1], x + move[1, 1])


def _back(found: np.ndarray, emission: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> None:
    """Fill backward scores before those of each run's last word."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    for t in range((int(size[0]) if len(size) else 0) - 2, -1, -1):
        at = start[: np.searchsorted(-size, -(t + 1), side="left")] + t
        o, x = found[at + 1, 0], found[at + 1, 1] + emission[at + 1]
        found[at, 0] = np.logaddexp(o + move[0, 0], x + move[0, 1])
        found[at, 1] = np.logaddexp(o + move[1, 0], x + move[1, 1])


def _after(vectors: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rows of two log scores times 2 x 2 log matrices."""
    return np.logaddexp(vectors[:, 0, None] + steps[:, 0], vectors[:, 1, None] + steps[:, 1])


def passes(emission: np.ndarray, begin: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward scores of both states of every word, each sequence's log total, and its number by word."""
    n = len(emission)
    sizes = np.diff(np.r_[begin, n])
    blocks = -(-sizes // BLOCK)
    head = np.cumsum(blocks) - blocks  # first block of each sequence
    chain = np.repeat(np.arange(len(begin)), blocks)
    start = begin[chain] + (np.arange(len(chain)) - head[chain]) * BLOCK
    size = np.minimum(BLOCK, (begin + sizes)[chain] - start)
    last = start + size - 1
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[begin, 1] = emission[begin]
    if len(chain) > len(begin):
        # Sums over all paths of a block, from either state of its first word to either of its last.
        many = np.flatnonzero(blocks[chain] > 1)
        paths = np.full((len(chain), 2, 2), -np.inf)
        for state in (0, 1):
            trial = np.full((n, 2), -np.inf)
            trial[start[many], state] = 0
            _ahead(trial, emission, start[many], size[many], move)
            paths[many, state] = trial[last[many]]
        gain = np.zeros((len(chain), 2))
        gain[:, 1] = emission[start]
        longest = int(blocks.max())
        left, right = forward[start].copy(), np.zeros((len(chain), 2))  # forward at first words, backward at last ones
        for k in range(1, longest):
            at = head[blocks > k] + k
            left[at] = _after(_after(left[at - 1], paths[at - 1]), np.broadcast_to(move, (len(at), 2, 2))) + gain[at]
        for k in range(longest - 2, -1, -1):
            at = head[blocks > k + 1] + k
            onward = _after(right[at + 1], paths[at + 1].transpose(0, 2, 1)) + gain[at + 1]
            right[at] = _after(onward, np.broadcast_to(move.T, (len(at), 2, 2)))
        forward[start], backward[last] = left, right
    _ahead(forward, emission, start, size, move)
    _back(backward, emission, start, size, move)
    ends = np.r_[begin[1:], n] - 1
    total = np.logaddexp(forward[ends, 0], forward[ends, 1])
    return forward, backward, total, np.repeat(np.arange(len(begin)), sizes)


def marginals(emission: np.ndarray, begin: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Each word's probability of the toxic state."""
    forward, backward, total, number = passes(emission, begin, move)
    return np.exp(np.minimum(0, forward[:, 1] + backward[:, 1] - total[number]))


def fit(features: np.ndarray, labels: np.ndarray, begin: np.ndarray, bits: int, epochs: int, rate: float, l2: float) -> CrfModel:
    """Maximise the log likelihood of the labelled sequences by AdaGrad over batches of sequences."""
    m = CrfModel(np.zeros(1 << bits), -4.0, np.zeros((2, 2)), bits)
    seen, seen_bias, seen_move = np.full(1 << bits, 1e-4), 1e-4, np.full((2, 2), 1.0)
    ends = np.r_[begin[1:], len(labels)]
    draw = np.random.default_rng(1)
    for _ in range(epochs):
        for some in np.array_split(draw.permutation(len(begin)), max(4, len(begin) // 512)):
            size = ends[some] - begin[some]
            first = np.r_[0, np.cumsum(size)[:-1]]
            words = np.repeat(begin[some] - first, size) + np.arange(size.sum())
            x, y = features[words], labels[words]
            e = m.weights[x].sum(axis=1) + m.bias
            forward, backward, total, number = passes(e, first, m.move)
            p = np.exp(np.minimum(0, forward[:, 1] + backward[:, 1] - total[number]))
            gap = y - p
            touched, back = np.unique(x, return_inverse=True)
            g = np.bincount(back.ravel(), np.repeat(gap, x.shape[1])) - l2 * m.weights[touched]
            seen[touched] += g * g
            m.weights[touched] += rate * g / np.sqrt(seen[touched])
            g = gap.sum()
            seen_bias += g * g
            m.bias += rate * g / np.sqrt(seen_bias)
            inner = np.ones(len(y), bool)
            inner[first] = False
            to = np.flatnonzero(inner)
            g = np.zeros((2, 2))
            for i in range(2):
                for j in range(2):
                    pair = forward[to - 1, i] + m.move[i, j] + backward[to, j] + (e[to] if j else 0) - total[number[to]]
                    g[i, j] = ((y[to - 1] == i) & (y[to] == j)).sum() - np.exp(np.minimum(0, pair)).sum()
            seen_move += g * g
            m.move += rate * g / np.sqrt(seen_move)
    return m


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", held_out: Column | None = None, sample_rows: int = 2400, shards: int = 6, shard_rows: int = 400, bits: int = 18, epochs: int = 5, rate: float = 0.3, l2: float = 1e-3, least: int = 4, odds: float = 25.0) -> CrfModel:
    """Fit on at most ``sample_rows`` labelled rows of each label; rows where ``held_out`` (over ``labels``) holds are never read."""
    sample = common.written(labelled_sample(docs, labels, label, sample_rows, held_out, by_class=True))

    def occurring(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(parts, "text"):
            words, _ = Words.of(part.column("text"))
            seen = pd.DataFrame({"doc": np.repeat(words.doc, words.own.shape[1]), "feature": words.own.ravel().view(np.int64)}).drop_duplicates()
            toxic = np.array(part.column("label").to_pylist(), np.int64)[seen["doc"]]
            sums = pd.DataFrame({"feature": seen["feature"].to_numpy(), "toxic": toxic, "clean": 1 - toxic}).groupby("feature", as_index=False).sum()
            yield pa.RecordBatch.from_pandas(sums, preserve_index=False)

    counts = sample.select("text", "label").mapInArrow(occurring, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("clean")).first()
    shards = max(1, min(shards, (sizes["toxic"] + sizes["clean"]) // shard_rows))
    rate_of = lambda c: (F.col(c) + 0.1) / (sizes[c] + 0.2)
    # The sample is bounded, and so is what it says of each feature.
    seeds = counts.where((F.col("toxic") >= least) & (rate_of("toxic") >= odds * rate_of("clean"))).select("feature").toPandas()["feature"].to_numpy(np.int64)
    seeds = np.sort(seeds.view(np.uint64))

    def fit_shard(part: pd.DataFrame) -> pd.DataFrame:
        words, _ = Words.of(pa.array(part["text"], pa.large_string()))
        toxic = part["label"].to_numpy()[words.doc] == 1
        known = np.zeros(len(words.doc), bool)
        for column in words.own.T:
            at = np.minimum(np.searchsorted(seeds, column), max(len(seeds) - 1, 0))
            known |= (seeds[at] == column) if len(seeds) else False
        m = fit(words.features(bits), (toxic & known).astype(np.int64), words.begin, bits, epochs, rate, l2)
        index = np.flatnonzero(m.weights)
        return pd.DataFrame({"index": np.r_[index, [-1, -2, -3, -4, -5]], "weight": np.r_[m.weights[index], m.bias, m.move.ravel()]})

    dealt = sample.select("text", "label", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(2)), F.lit(shards)).alias("shard"))
    used = dealt.select("shard").distinct().count()
    found = dealt.groupBy("shard").applyInPandas(fit_shard, "index long, weight double").groupBy("index").agg((F.sum("weight") / max(used, 1)).alias("weight")).toPandas()
    by = dict(zip(found["index"], found["weight"]))
    weights = np.zeros(1 << bits, np.float32)
    inner = found[found["index"] >= 0]
    weights[inner["index"].to_numpy(np.int64)] = inner["weight"]
    return CrfModel(weights, by.get(-1, -12.0), np.array([by.get(k, 0.0) for k in (-2, -3, -4, -5)]).reshape(2, 2), bits)


def tag(texts: pa.Array, model: CrfModel) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
    """Each text's score and toxic spans."""
    words, data = Words.of(texts)
    rows = len(texts)
    p = marginals(model.weights[words.features(model.bits)].sum(axis=1, dtype=np.float64) + model.bias, words.begin, model.move) if len(words.doc) else np.zeros(0)
    top = np.zeros(rows)
    np.maximum.at(top, words.doc, p)
    strong = p >= 0.2
    joined = 1 - np.exp(np.bincount(words.doc[strong], np.log1p(-np.minimum(p[strong], 1 - 1e-12)), minlength=rows))
    score = np.where(np.bincount(words.doc[strong], minlength=rows) > 0, joined, top)
    spans: list[list[dict[str, int]]] = [[] for _ in range(rows)]
    flagged = np.flatnonzero(p >= 0.5)
    if len(flagged):
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        _, offsets = common.utf8(texts)
        base = points[offsets[words.doc[flagged]]]
        last = -2
        for k, d, a, b in zip(flagged.tolist(), words.doc[flagged].tolist(), (points[words.starts[flagged]] - base).tolist(), (points[words.ends[flagged]] - base).tolist()):
            if k == last + 1 and spans[d]:
                spans[d][-1]["end"] = b
            else:
                spans[d].append({"start": a, "end": b})
            last = k
    return score, spans


def score(docs: DataFrame, model: CrfModel, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score``, ``spans`` (start, end) and ``predicted``; columns of those names are replaced."""
    docs = docs.drop("score", "spans", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text", 2 << 20):
            found, spans = tag(part.column("text"), shared.value)
            yield part.append_column("score", pa.array(found)).append_column("spans", pa.array(spans, kind))

    scored = docs.mapInArrow(run, common.extended(docs.schema, score="double", spans="array<struct<start: bigint, end: bigint>>"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
