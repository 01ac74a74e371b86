"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features of a text are its lower-case words, pairs of neighbouring words, the words' shapes (runs of lower case,
upper case, digits and each punctuation mark) and pairs of shapes with a mark for a repeated word. A feature's value
is ``log(1 + count)`` over the text's Euclidean norm, so a score is one sparse dot product.

Labelled rows are drawn by a hash of their id up to ``sample_rows`` (a documented bound), dealt to tasks of
``shard_rows`` rows or more, ``shards`` at most, that each run the updates over their share, and the shards' weights are
averaged; only the weights, at most ``2 ** bits`` numbers, reach the driver.

Null and empty texts have no features and score by the bias alone. Null labels are left out; of several labels of one
id the largest counts. Without labels every score is 0.5. Repeated rows score alike. Other columns are kept.
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

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91], _CLASS[48:58] = ord("A"), ord("0")
_C = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of every feature that occurs."""
    data, offsets = common.utf8(texts)
    starts, ends, doc = common.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    words = common.span_hashes(common.LOWER[data], starts, ends)
    kinds = _CLASS[data]
    kept = np.r_[True, kinds[1:] != kinds[:-1]]
    kept[starts] = True
    rank = np.r_[0, np.cumsum(kept)]
    shapes = common.span_hashes(kinds[kept], rank[starts], rank[ends])
    near = doc[1:] == doc[:-1]
    again = (words[1:] == words[:-1]).astype(np.uint64) + np.uint64(1)
    found = [words, common.mix(words[:-1] * _C[0] + words[1:])[near], shapes * _C[1], common.mix((shapes[:-1] * _C[2] + shapes[1:]) * _C[3] + again)[near]]
    docs = [doc, doc[1:][near], doc, doc[1:][near]]
    key = np.concatenate([(d << bits) | (f >> np.uint64(64 - bits)).astype(np.int64) for d, f in zip(docs, found)])
    key, count = np.unique(key, return_counts=True)
    doc, value = key >> bits, np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    return doc, key & ((1 << bits) - 1), value / norm[doc]


def follow(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal over (features, values, label) rows in the given order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(i):
        return -np.where(np.abs(z[i]) > l1, z[i] - np.sign(z[i]) * l1, 0) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for index, value, label in rows:
            i, v = np.r_[index, 1 << bits], np.r_[value, 1.0]
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - label) * v
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    w = weight(slice(None))
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: Column | None, by_class: bool = False) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents (of each label if ``by_class``), drawn by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out) if held_out is not None else known
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    draw = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    parts = [known.where(F.col("label") == x) for x in (0, 1)] if by_class else [known]
    chosen = parts[0].orderBy(*draw).limit(rows)
    for part in parts[1:]:
        chosen = chosen.unionByName(part.orderBy(*draw).limit(rows))
    # At most 2 * rows pairs of numbers: a proven bound for the broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", held_out: Column | None = None, sample_rows: int = 6000, shards: int = 6, shard_rows: int = 1000, bits: int = 18, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled rows; rows where ``held_out`` (over ``labels``) holds are never read."""
    sample = labelled_sample(docs, labels, label, sample_rows, held_out)
    shards = max(1, min(shards, min(labels.count(), sample_rows) // shard_rows))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("draw", kind="stable")
        rows = []
        for at in range(0, len(part), 64):
            some = part.iloc[at : at + 64]
            doc, index, value = features(pa.array(some["text"], pa.large_string()), bits)
            cut = np.searchsorted(doc, np.arange(len(some) + 1))
            rows += [(index[a:b], value[a:b], y) for a, b, y in zip(cut, cut[1:], some["label"])]
        w, bias = follow(rows, bits, epochs, alpha, beta, l1, l2)
        index = np.flatnonzero(w)
        return pd.DataFrame({"index": np.r_[index, -1], "weight": np.r_[w[index], bias], "rows": len(rows)})

    dealt = sample.select("text", "label", F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)).alias("draw")).withColumn("shard", F.pmod("draw", F.lit(shards)))
    fitted = dealt.groupBy("shard").applyInPandas(fit, "index long, weight double, rows long")
    total = F.sum(F.col("weight") * F.col("rows")).alias("weight")
    found = fitted.groupBy("index").agg(total, F.sum("rows").alias("rows")).toPandas()
    weights, bias = np.zeros(1 << bits, np.float32), 0.0
    if len(found):
        rows = found.loc[found["index"] < 0, "rows"].iloc[0]
        bias = float(found.loc[found["index"] < 0, "weight"].iloc[0] / rows)
        found = found[found["index"] >= 0]
        weights[found["index"].to_numpy()] = found["weight"] / rows
    return QualityModel(weights, bias, bits)


def score(docs: DataFrame, model: QualityModel, *, threshold: float = 0.5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns, a score (0 to 1) and whether it is over the threshold; columns of their names are replaced."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in common.pieces(batches, "text"):
            doc, index, value = features(part.column("text"), m.bits)
            margin = np.bincount(doc, m.weights[index] * value, minlength=part.num_rows) + m.bias
            yield part.append_column(names[0], pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))

    scored = docs.mapInArrow(run, common.extended(docs.schema, **{names[0]: "double"}))
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
