"""Hard-negative mining: ball trees over blocks of rows bound inner products from both sides.

Rows are dealt into blocks of bounded size, and each task builds a ball tree (centre and radius at every node) over its
block. An anchor ``q`` meets scores between ``q.centre - |q| radius`` and ``q.centre + |q| radius`` in a ball. A search goes
down the tree for many anchors at once and leaves a node aside for those whose score window lies wholly above or below its
bounds, whose current last hit is strictly above its upper bound (ties are broken by id, so an equal bound is still searched),
or whose label rules all its rows out. Each block returns its best rows; blocks' results are merged by a ranked window.

Two searches make the result: each anchor's nearest rows of its own label (its positives), then, for the score window that
each positive sets, the highest rows of other labels. Blocks come first in a task's input and anchors are streamed past them,
so memory is bounded by the block; an anchor crosses to every block once a search, which grows with blocks times anchors as
the exact search itself does: raise ``block_rows`` with the workers' memory. Which label a row has doesn't matter to its block,
so a label of any size is spread evenly.

Scores are exact: whole numbers in single or double precision while all sums fit, in 64-bit integers beyond; entries count as
at most 2**26 in size, so that scores fit. Rows with a null id, label, vector or entry take no part; rows equal in
id, label and vector count once; rows that share only their id are rows of their own, ties of score and id go by label and
vector. A row is never its own positive, nor is another row of its id. Vectors of different lengths don't meet. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common

LEAF = 64
LEAST_BLOCKS = 24
_NONE = -(1 << 62)
_HITS = "anchor long, window int, score long, row long, id long, label int"


@dataclass
class Tree:
    """A ball tree over ``order``: nodes are spans of it, children follow their parent; leaves have no left child."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """Splits each span at the median along the line between two far rows; equal rows may fall on both sides."""
        points = x.astype(np.float64)
        order = np.arange(len(x))
        begin, end, left, right, centre, radius = [0], [len(x)], [-1], [-1], [], []
        node = 0
        while node < len(begin):
            mine = points[order[begin[node] : end[node]]]
            mid = mine.mean(axis=0)
            far = np.sqrt(((mine - mid) ** 2).sum(axis=1))
            centre.append(mid)
            radius.append(far.max())
            if len(mine) > leaf and radius[-1] > 0:
                a = mine[far.argmax()]
                b = mine[((mine - a) ** 2).sum(axis=1).argmax()]
                half = len(mine) // 2
                order[begin[node] : end[node]] = order[begin[node] : end[node]][np.argpartition(mine @ (b - a), half)]
                left[node], right[node] = len(begin), len(begin) + 1
                begin += [begin[node], begin[node] + half]
                end += [begin[node] + half, end[node]]
                left += [-1, -1]
                right += [-1, -1]
            node += 1
        # Rounding of sums and roots is far below one part in 10**9 of the sizes; the bounds give way by as much.
        return cls(order, *(np.array(v) for v in (begin, end, left, right)), np.array(centre), np.array(radius) * (1 + 1e-9))


class Block:
    """One block's rows of one vector length, with their tree."""

    def __init__(self, row: np.ndarray, ident: np.ndarray, label: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.tree = t = Tree.of(x, leaf)
        self.row, self.ident, self.label, self.x = row[t.order], ident[t.order], label[t.order], x[t.order]
        self.most = int(np.abs(x).max(initial=0))
        self.labels = np.unique(label)
        held = np.zeros((len(t.begin), len(self.labels)), bool)
        at = np.searchsorted(self.labels, self.label)
        for node in range(len(t.begin) - 1, -1, -1):
            if t.left[node] < 0:
                held[node, at[t.begin[node] : t.end[node]]] = True
            else:
                held[node] = held[t.left[node]] | held[t.right[node]]
        self.held, self.pure = held, held.sum(axis=1) == 1
        self.searched = self.nodes = 0

    def search(self, ident: np.ndarray, label: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` places and scores of each anchor and score window, the place -1 where there are no more.

        ``low`` and ``high`` are (anchors, windows); a window whose ``low`` is above its ``high`` takes nothing."""
        t, n, d = self.tree, len(x), x.shape[1]
        bound = self.most * int(np.abs(x).max(initial=0)) * max(1, d)
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        rows, asked, fine = self.x.astype(kind), x.astype(kind), x.astype(np.float64)
        size = np.sqrt((fine**2).sum(axis=1))
        middle = fine @ t.centre.T
        reach = np.multiply.outer(size, t.radius + 1e-9 * np.sqrt((t.centre**2).sum(axis=1))) + 1e-6
        upper, lower = middle + reach, middle - reach
        best = np.full((*low.shape, k), _NONE, np.int64)
        place = np.full((*low.shape, k), -1, np.int64)
        own = np.searchsorted(self.labels, label)
        known = (own < len(self.labels)) & (self.labels[np.minimum(own, len(self.labels) - 1)] == label)
        own = np.minimum(own, len(self.labels) - 1)
        stack: list[tuple[int, np.ndarray]] = [(0, np.arange(n))]
        while stack:
            node, at = stack.pop()
            has = known[at] & self.held[node, own[at]]
            at = at[has if same else ~(has & self.pure[node])]
            last = best[at, :, -1]
            meets = (upper[at, node, None] >= np.maximum(low[at], last)) & (lower[at, node, None] <= high[at]) & (low[at] <= high[at])
            at = at[meets.any(axis=1)]
            self.nodes += len(at)
            if not len(at):
                continue
            if t.left[node] >= 0:
                nodes = (t.left[node], t.right[node])
                # The half with the higher bounds is searched first, so that the last hit rises early.
                for child in sorted(nodes, key=lambda c: upper[at, c].mean()):
                    stack.append((child, at))
                continue
            here = slice(t.begin[node], t.end[node])
            self.searched += len(at) * (t.end[node] - t.begin[node])
            scores = (asked[at] @ rows[here].T).astype(np.int64)
            allowed = (self.label[here] == label[at, None]) == same
            if same:
                allowed &= self.ident[here] != ident[at, None]
            for w in range(low.shape[1]):
                fits = allowed & (scores >= np.maximum(low[at, w], best[at, w, -1])[:, None]) & (scores <= high[at, w][:, None])
                for i in np.flatnonzero(fits.any(axis=1)):
                    found = np.flatnonzero(fits[i])
                    q = at[i]
                    s = np.concatenate([best[q, w], scores[i, found]])
                    p = np.concatenate([place[q, w], found + t.begin[node]])
                    first = np.lexsort((self.row[p], self.ident[p], -s))[:k]
                    best[q, w], place[q, w] = s[first], p[first]
        return place, best


def _searching(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        blocks: dict[int, Block] = {}
        now = None
        names = ("row", "id", "label")
        for batch in batches:
            at = 0
            block, kind = batch.column("block").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(edges, edges[1:]):
                if at == end:
                    continue
                piece = batch.slice(at, end - at)
                if block[at] != now:
                    now, parts, blocks = block[at], {}, {}
                fields = [piece.column(c).to_numpy() for c in names]
                vectors, windows = piece.column("x"), {c: piece.column(c) for c in ("low", "high")}
                starts = vectors.offsets.to_numpy()
                sizes, values = np.diff(starts), vectors.values.to_numpy()
                for d in np.unique(sizes):
                    own = np.flatnonzero(sizes == d)
                    x = values[starts[own][:, None] + np.arange(d)].astype(np.int64)
                    if not kind[at]:
                        parts.setdefault(int(d), []).append((*(f[own] for f in fields), x))
                        continue
                    if int(d) in parts:
                        blocks[int(d)] = Block(*(np.concatenate(c) for c in zip(*parts.pop(int(d)))))
                    if int(d) not in blocks:
                        continue
                    low, high = (np.stack([windows[c][int(i)].values.to_numpy() for i in own]) for c in ("low", "high"))
                    tree = blocks[int(d)]
                    place, best = tree.search(fields[1][own], fields[2][own], x, low, high, k, same)
                    hit, window, rank = np.nonzero(place >= 0)
                    if len(hit):
                        p = place[hit, window, rank]
                        arrays = [fields[0][own][hit], window.astype(np.int32), best[hit, window, rank], tree.row[p], tree.ident[p], tree.label[p].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["anchor", "window", "score", "row", "id", "label"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows of each anchor and window over all blocks, with their ``rank`` from 1."""
    window = F.array().cast("array<long>")
    table = rows.select(F.pmod("row", F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("anchor"), "row", "id", "label", "x", window.alias("low"), window.alias("high"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("anchor"), "row", "id", "label", "x", "low", "high")
    dealt = table.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "anchor", "row")
    found = dealt.mapInArrow(_searching(k, same), _HITS)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(rows: DataFrame, *, id: str, label: str, vector: str) -> DataFrame:
    """The rows that take part, numbered once in order of id, label and vector, as a table in the shared folder."""
    most = F.lit(1 << 26).cast("long")
    held = lambda x: F.greatest(F.least(x.cast("long"), most), -most)
    kept = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label"), F.col(f"`{vector}`").alias("x"))
    kept = kept.where("id is not null and label is not null and x is not null and not exists(x, e -> e is null)").withColumn("x", F.transform("x", held)).distinct()
    order = ["id", "label", "x"]
    return common.written(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))


def _hundredth(x: Column) -> Column:
    """A hundredth of a whole number, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(100).cast("long")), F.lit(100).cast("long"))


def mine(rows: DataFrame, anchors: Column, *, id: str = "vec_id", label: str = "label", vector: str = "x", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 16_384) -> DataFrame:
    """Hard negatives ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on the column ``id`` of whole-number vectors' rows. A negative's score lies between ``low``
    and ``high`` hundredths of the positive's, both included."""
    table = prepared(rows, id=id, label=label, vector=vector)
    # The numbers of one range follow one another, so they fill the blocks evenly; a block has at most about block_rows.
    blocks = max(LEAST_BLOCKS, -(-table.count() // block_rows))
    asked = table.where(anchors)
    every = F.array(F.lit(_NONE + 1).cast("long")), F.array(F.lit(-_NONE).cast("long"))
    near = common.written(_search(table, asked.withColumn("low", every[0]).withColumn("high", every[1]), blocks, positives, True))
    of_anchor = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    # 100 * score >= low * positive and 100 * score <= high * positive, in whole numbers.
    hundredfold = lambda p, share: F.lit(share).cast("long") * p["score"]
    least = F.transform("near", lambda p: -_hundredth(-hundredfold(p, low)))
    most = F.transform("near", lambda p: _hundredth(hundredfold(p, high)))
    pad = lambda a, filler: F.concat(a, F.array_repeat(F.lit(filler).cast("long"), F.lit(positives) - F.size(a)))
    again = asked.join(of_anchor.withColumnRenamed("anchor", "row"), "row").withColumn("low", pad(least, 1)).withColumn("high", pad(most, 0))
    hits = _search(table, again.select("row", "id", "label", "x", "low", "high"), blocks, negatives, False)
    of = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    joined = hits.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "window"]).join(names, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
