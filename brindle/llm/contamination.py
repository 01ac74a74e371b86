"""Benchmark decontamination: an index of item shingles, a bound for each item, exact similarity of all its windows.

A text is compared with each item in windows as long as the item (in words, A-Z lower-cased). A shingle is ``width``
words and weighs by how rare it is among the items: ``1 + ln(items / items that hold it)``; one that the item does not
hold weighs ``1 + ln(items)``, as one that no item holds. Similarity is the weight of the shared shingles (as multisets)
over the weight of all, and a window at ``threshold`` or more is a leak.

Per text:

1. Rolling shingle hashes are looked up in the items' shingles, and the items that hold them in an index. An item whose
   distinct shingles in the text weigh less than the threshold allows cannot leak in any of its windows.
2. For each other item the exact similarity of every window follows from running sums: a hit adds to the shared weight
   of the windows that hold it and not too many earlier hits of its shingle. The similarity changes only where a hit
   enters or leaves, so work and memory follow the hits, and no window is passed over.

Items are counted and weighed by Spark over the whole benchmark and broadcast in slices of at most ``max_bytes`` of
text, dealt by a hash of the item; a slice's results do not depend on the others. A slice over the bound (one item longer
than it) raises an error. Null and empty texts and items have no windows; items shorter than a shingle are one shingle of
all their words. Repeated rows give repeated results; repeated items each match. Of equally similar windows the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each position; positions with fewer words ahead are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _STEP + words[k : k + n]
    return common.mix(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts and where each text's begin."""
    data, offsets = common.utf8(texts)
    starts, ends, doc = common.word_spans(data, offsets)
    return common.span_hashes(common.LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64), np.searchsorted(doc, np.arange(len(texts) + 1))


@dataclass
class Benchmark:
    """Some items with their shingles, the weights these have in the whole benchmark, and the index from shingles to items."""

    ids: list[int]
    length: np.ndarray
    shingles: list[np.ndarray]
    known: np.ndarray  # sorted distinct shingles
    weight: np.ndarray
    heaviest: float
    width: int
    threshold: float

    @classmethod
    def build(cls, rows: list[tuple[int, int, list[int], list[int]]], items: int, width: int, threshold: float) -> Benchmark:
        """From ``(item_id, words, shingles in order, items that hold each)``."""
        shingles = [np.array(r[2], np.int64).view(np.uint64) for r in rows]
        none = [np.zeros(0, np.int64)]
        known, first = np.unique(np.concatenate(shingles or [np.zeros(0, np.uint64)]), return_index=True)
        holders = np.concatenate([np.array(r[3], np.int64) for r in rows] or none)[first]
        total = 1 + np.log(max(items, 1))
        self = cls([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), shingles, known, total - np.log(np.maximum(holders, 1)), total, width, threshold)
        counted = [np.unique(self.places(s), return_counts=True) for s in shingles]
        self.own = counted
        self.whole = np.array([(self.weight[p] * n).sum() for p, n in counted])
        item, place, times = np.repeat(np.arange(len(rows)), [len(p) for p, _ in counted]), *(np.concatenate([c[k] for c in counted] or none) for k in (0, 1))
        order = np.argsort(place, kind="stable")
        self.holder, self.times = item[order], times[order]
        self.start = np.searchsorted(place[order], np.arange(len(known) + 1))
        self.shape = np.minimum(width, self.length)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(known >> np.uint64(42)).astype(np.int64)] = True
        return self

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Index of each shingle among the items', -1 for others."""
        at = np.minimum(np.searchsorted(self.known, shingles), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == shingles, at, -1) if len(self.known) else np.full(len(shingles), -1)

    def possible(self, found: np.ndarray, width: int) -> list[int]:
        """Items of one shingle width whose shingles among ``found`` (distinct places) weigh enough for the threshold."""
        size = self.start[found + 1] - self.start[found]
        entry = np.repeat(self.start[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        total = np.bincount(self.holder[entry], np.repeat(self.weight[found], size) * self.times[entry], minlength=len(self.ids))
        return np.flatnonzero((total > 0) & (total >= self.whole * self.threshold - 1e-9) & (self.shape == width)).tolist()

    def best_window(self, item: int, at: np.ndarray, which: np.ndarray, n_words: int) -> tuple[float, int]:
        """The greatest similarity of any window with the item, and the first word of the first such window.

        at, which: positions in a text of ``n_words`` words that hold a known shingle, ascending, and its place."""
        size = min(int(self.length[item]), n_words)  # a shorter text is one window
        span = size - int(self.shape[item])  # shingle starts in a window: first to first + span
        place, wanted = self.own[item]
        slot = np.minimum(np.searchsorted(place, which), len(place) - 1)
        mine = place[slot] == which
        at, slot = at[mine], slot[mine]
        weight = self.weight[place[slot]]
        # The hit ``wanted`` hits of the same shingle earlier: windows that hold it too have the shingle often enough.
        order = np.argsort(slot, kind="stable")
        rank = np.empty(len(at), np.int64)
        begin = np.searchsorted(slot[order], np.arange(len(place)))
        rank[order] = np.arange(len(at)) - begin[slot[order]]
        before = rank - wanted[slot]
        enough = np.where(before >= 0, at[order[np.maximum(begin[slot] + before, 0)]], -1)
        last = n_words - size
        enter, leave = np.maximum(at - span, 0), at + 1
        shared_from = np.maximum(enter, enough + 1)
        first = np.unique(np.r_[enter, shared_from, leave])
        first = first[first <= last]
        if not len(first):
            return 0.0, 0

        def over(enter: np.ndarray, value: np.ndarray) -> np.ndarray:
            """The sum of ``value`` over the hits between entering and leaving, at each of ``first``."""
            by = np.argsort(enter, kind="stable")
            come, go = np.r_[0, np.cumsum(value[by])], np.r_[0, np.cumsum(value)]
            return come[np.searchsorted(enter[by], first, side="right")] - go[np.searchsorted(leave, first, side="right")]

        ones = np.ones(len(at))
        shared, inside, hits = over(shared_from, weight), over(enter, weight), over(enter, ones)
        similarity = shared / (self.whole[item] + inside + (span + 1 - hits) * self.heaviest - shared)
        top = similarity.max()
        k = int(np.argmax(similarity >= top - 1e-9))
        return float(similarity[k]), int(first[k])

    def leaks(self, n_words: int, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, float]]:
        """(item number, first word, past last word, similarity) of each item's best window in one text.

        hits: for each shingle width, the positions that hold an item's shingle and which."""
        out = []
        for width, (at, which) in hits.items():
            if n_words < width or not len(at):
                continue
            for k in self.possible(np.unique(which), width):
                similarity, first = self.best_window(k, at, which, n_words)
                if similarity >= self.threshold - 1e-9:
                    out.append((k, first, min(first + int(self.length[k]), n_words), round(similarity, 9)))
        return sorted(out)


@dataclass
class Items:
    """A weighed benchmark: its table, its size and how many slices it is broadcast in."""

    table: DataFrame
    count: int
    slices: int
    width: int
    threshold: float
    max_bytes: int

    def slice(self, k: int) -> Benchmark:
        mine = self.table.where(F.pmod(F.xxhash64("item_id", "row"), F.lit(self.slices)) == k)
        size = mine.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if size > self.max_bytes:
            raise ValueError(f"a slice of the benchmark has {size} bytes, over {self.max_bytes}: raise max_bytes")
        rows = mine.orderBy("item_id", "row").select("item_id", "words", "shingles", "holders").collect()
        return Benchmark.build([tuple(r) for r in rows], self.count, self.width, self.threshold)


def load(benchmark: DataFrame, *, width: int = 5, threshold: float = 0.8, max_bytes: int = 64 << 20) -> Items:
    """The benchmark's items with their shingles and how many items hold each, as a table."""
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text"):
            words, cut = word_hashes(part.column("text"))
            full = np.flatnonzero(np.diff(cut))
            rows = [shingle_hashes(words[cut[i] : cut[i + 1]], int(min(width, cut[i + 1] - cut[i]))).view(np.int64) for i in full]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows or [np.zeros(0, np.int64)])))
            take = pa.array(full)
            size = np.diff(common.utf8(part.column("text"))[1])[full]
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(take), pa.array(np.diff(cut)[full]), pa.array(size), shingles], ["item_id", "words", "size", "shingles"])

    cut = known.mapInArrow(run, "item_id long, words long, size long, shingles array<long>")
    # Repeated items are told apart by a number within their id.
    cut = common.written(cut.withColumn("row", F.row_number().over(Window.partitionBy("item_id").orderBy("shingles"))))
    flat = cut.select("item_id", "row", F.posexplode("shingles").alias("at", "shingle"))
    holders = flat.select("item_id", "row", "shingle").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"))
    counted = flat.join(holders, "shingle").groupBy("item_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "holders"))), lambda x: x["holders"]).alias("holders"))
    table = common.written(cut.join(counted, ["item_id", "row"]))
    count, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Twice the slices that the size asks for leave room for an uneven deal.
    return Items(table, count, 1 if size <= max_bytes else 2 * -(-size // max_bytes), width, threshold, max_bytes)


def find_leaks(docs: DataFrame, items: Items) -> DataFrame:
    """``(doc_id, row_text, item_id, first_word, end_word, similarity)`` for each item found in a document.

    ``row_text`` is xxhash64 of the text, which tells apart rows that repeat a doc_id. Of several slices, each is
    broadcast, searched for and written before the next."""
    if items.slices == 1:
        return find_in_slice(docs, items.slice(0))[0]
    out = None
    for k in range(items.slices):
        found, shared = find_in_slice(docs, items.slice(k))
        found = common.written(found)
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def find_in_slice(docs: DataFrame, items: Benchmark) -> tuple[DataFrame, Broadcast]:
    """What ``find_leaks`` returns for some of the items, and their broadcast value."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row_text"))
    names = ["doc_id", "row_text", "item_id", "first_word", "end_word", "similarity"]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = shared.value
        widths = sorted(set(b.shape.tolist()))
        for part in common.pieces(batches, "text"):
            words, cut = word_hashes(part.column("text"))
            found = {}
            for width in widths:
                hashes = shingle_hashes(words, width)
                at = np.flatnonzero(b.filter[(hashes >> np.uint64(42)).astype(np.int64)])
                which = b.places(hashes[at])
                found[width] = at[which >= 0], which[which >= 0]
            touched = np.unique(np.concatenate([np.searchsorted(cut, at, side="right") - 1 for at, _ in found.values()] or [np.zeros(0, np.int64)]))
            rows = []
            for d in touched.tolist():
                start, end = int(cut[d]), int(cut[d + 1])
                hits = {}
                for width, (at, which) in found.items():
                    low, high = np.searchsorted(at, start), np.searchsorted(at, end - width, side="right")
                    hits[width] = at[low:high] - start, which[low:high]
                rows += [(d, *leak) for leak in b.leaks(end - start, hits)]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("row_text").take(take), pa.array([b.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())], names
            )

    return docs.mapInArrow(run, f"doc_id {id_type}, row_text long, item_id long, first_word long, end_word long, similarity double"), shared


def without_leaks(docs: DataFrame, items: Items) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    leaked = find_leaks(docs, items).select(F.col("doc_id").alias("_leak_id"), F.col("row_text").alias("_leak_text")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_leak_id")) & (F.xxhash64(docs["text"]) == F.col("_leak_text"))
    return docs.join(leaked, same, "left_anti")
