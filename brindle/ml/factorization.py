"""Matrix factorisation by stratified stochastic gradient descent (Gemulla et al. 2011).

Users and items fall into ``B`` blocks each by hash, ratings into a grid of B x B. A round works on B blocks of the grid that
share no user and no item, each in a task of its own with just its users' and items' factors; B rounds, each
with another diagonal of the grid, are a pass over all ratings. Between rounds only factors move. Steps are scaled by each
row's own past gradients (Adagrad), so a user or item with very many ratings takes no wild steps. A rating is the mean plus
both biases plus the product of the factors.

Users and items are numbered within their blocks by a window, and joined back by key; no list of them reaches the driver.
Ratings are packed into chunks once. Every round's factors are a table in the shared folder, and its order of ratings is
seeded, so work of a lost executor is repeated as it was. Rows without a rating take no part; users and items that the fit has not
seen have no score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources import scratch

CHUNK = 65_536
BATCH = 128
#: Ratings that a block row of the grid should hold at least, before there are more blocks than two.
BLOCK_RATINGS = 250_000
_FACTORS = "side int, block int, rows binary"
_PACKED = "ublock int, stratum int, chunk long, users binary, items binary, ratings binary"


def _block(key: str, blocks: int, salt: int):
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(blocks)).cast("int")


def _numbered(ratings: DataFrame, key: str, block: str) -> DataFrame:
    """Each distinct key with its place in its block."""
    place = F.row_number().over(Window.partitionBy(block).orderBy(key)) - 1
    return ratings.select(block, key).distinct().withColumn(f"{key}_at", place)


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ratings of one block of the grid, which come in a row."""
    held: list[tuple[np.ndarray, ...]] = []
    now, chunk = None, 0

    def packed() -> pa.RecordBatch:
        users, items, values = (np.concatenate(v) for v in zip(*held))
        held.clear()
        data = lambda v, kind: pa.array([v.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict({"ublock": pa.array([now[0]], pa.int32()), "stratum": pa.array([now[1]], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "users": data(users, np.int32), "items": data(items, np.int32), "ratings": data(values, np.float64)})

    for batch in batches:
        keys = np.stack([batch.column("ublock").to_numpy(), batch.column("stratum").to_numpy()], axis=1)
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and (tuple(keys[a]) != now or sum(len(h[0]) for h in held) >= CHUNK):
                yield packed()
                chunk += 1
            now = tuple(keys[a].tolist())
            held.append(tuple(batch.column(c).slice(a, b - a).to_numpy() for c in ("user_at", "item_at", "label")))
    if held:
        yield packed()


def descend(users: np.ndarray, items: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray], mean: float, rate: float, penalty: float, order: np.ndarray) -> None:
    """One pass over ratings in small batches, in place. A row is factors, bias, and the sums of squares of both's gradients."""
    k = users.shape[1] - 3
    for first in range(0, len(order), BATCH):
        u, i, r = (a[order[first : first + BATCH]] for a in at)
        p, q = users[u], items[i]
        error = mean + p[:, k] + q[:, k] + np.einsum("ij,ij->i", p[:, :k], q[:, :k]) - r
        steps = (error[:, None] * q[:, :k] + penalty * p[:, :k], error + penalty * p[:, k]), (error[:, None] * p[:, :k] + penalty * q[:, :k], error + penalty * q[:, k])
        for side, mine, (wide, single) in ((users, u, steps[0]), (items, i, steps[1])):
            rows, back = np.unique(mine, return_inverse=True)
            g = np.zeros((len(rows), k + 1))
            np.add.at(g, back, np.column_stack([wide, single]))
            side[rows, k + 1] += (g[:, :k] ** 2).mean(axis=1)
            side[rows, k + 2] += g[:, k] ** 2
            side[rows, :k] -= rate * g[:, :k] / np.sqrt(side[rows, k + 1] + 1e-12)[:, None]
            side[rows, k] -= rate * g[:, k] / np.sqrt(side[rows, k + 2] + 1e-12)


def _round(width: int, mean: float, rate: float, penalty: float, seed: tuple[int, int]):
    """Rows of one key come as its users' factors, its items' factors, then its chunks of ratings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, blocks = None, {}, {}

        def finished():
            for side, rows in sides.items():
                yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "block": pa.array([blocks[side]], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary())})

        for batch in batches:
            for i in range(batch.num_rows):
                key, kind, block = (batch.column(c)[i].as_py() for c in ("key", "kind", "block"))
                if key != now:
                    yield from finished()
                    now, sides, blocks = key, {}, {}
                read = lambda c, t, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_buffer(), t)
                if kind < 2:
                    sides[kind], blocks[kind] = read("a", np.float64).reshape(-1, width).copy(), block
                    continue
                at = read("a", np.int32), read("b", np.int32), read("c", np.float64)
                order = np.random.default_rng([*seed, key, i]).permutation(len(at[2]))
                descend(sides[0], sides[1], at, mean, rate, penalty, order)
        yield from finished()

    return run


def _beginning(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, block, n in zip(*(batch.column(c).to_pylist() for c in ("side", "block", "n"))):
                rows = np.zeros((n, width))
                k = width - 3
                rows[:, :k] = np.random.default_rng([seed, side, block]).normal(size=(n, k)) * 0.1
                yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "block": pa.array([block], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary())})

    return run


def _spread(width: int):
    """Each block's rows one by one: (side, block, place, vector of factors and bias)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = np.frombuffer(batch.column("rows")[i].as_buffer(), np.float64).reshape(-1, width)[:, : width - 2]
                n = len(rows)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (width - 2), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("side", "block")] + [pa.array(np.arange(n), pa.int32()), vectors], ["side", "block", "at", "vector"])

    return run


class StratifiedFactorization(Estimator):
    """Factors of ``_user`` and ``_item`` (texts) for the number ``label``."""

    rank = Param(Params._dummy(), "rank", "factors", TypeConverters.toInt)
    passes = Param(Params._dummy(), "passes", "passes over the ratings", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l2 penalty", TypeConverters.toFloat)
    blocks = Param(Params._dummy(), "blocks", "blocks of users and of items; 0: by the number of ratings", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rank: int = 32, passes: int = 20, rate: float = 0.1, penalty: float = 0.05, blocks: int = 0):
        super().__init__()
        self._setDefault(rank=32, passes=20, rate=0.1, penalty=0.05, blocks=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FactorizationModel:
        spark, g = df.sparkSession, self.getOrDefault
        ratings = df.select(F.col("_user").alias("user"), F.col("_item").alias("item"), F.col("label").cast("double").alias("label")).where("label is not null and not isnan(label)")
        stats = ratings.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
        blocks = g("blocks") or max(2, min(spark.sparkContext.defaultParallelism, stats["n"] // BLOCK_RATINGS))
        width = g("rank") + 3
        kept, trash = [], []

        def stored(frame: DataFrame, keep: bool = False) -> DataFrame:
            table, path = scratch.stored(frame)
            (kept if keep else trash).append(path)
            return table

        try:
            ratings = ratings.withColumn("ublock", _block("user", blocks, 1)).withColumn("iblock", _block("item", blocks, 2))
            users, items = (stored(_numbered(ratings, key, block)) for key, block in (("user", "ublock"), ("item", "iblock")))
            placed = ratings.join(users, ["ublock", "user"]).join(items, ["iblock", "item"])
            placed = placed.select("ublock", F.pmod(F.col("iblock") - F.col("ublock"), F.lit(blocks)).cast("int").alias("stratum"), "user_at", "item_at", "label")
            dealt = placed.repartitionByRange("ublock", "stratum", "user_at", "item_at", "label").sortWithinPartitions("ublock", "stratum", "user_at", "item_at", "label")
            packed = stored(dealt.mapInArrow(_packing, _PACKED))
            sizes = users.groupBy(F.lit(0).alias("side"), F.col("ublock").alias("block")).agg(F.count(F.lit(1)).alias("n")).unionByName(items.groupBy(F.lit(1).alias("side"), F.col("iblock").alias("block")).agg(F.count(F.lit(1)).alias("n")))
            factors, path = scratch.stored(sizes.mapInArrow(_beginning(width, 42), _FACTORS))
            trash.append(path)
            for k in range(g("passes")):
                for s in range(blocks):
                    held = factors.select(F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - s, F.lit(blocks))).alias("key"), F.col("side").alias("kind"), "block", F.lit(0).cast("long").alias("chunk"), F.col("rows").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"))
                    chunks = packed.where(F.col("stratum") == s).select(F.col("ublock").alias("key"), F.lit(2).alias("kind"), F.col("ublock").alias("block"), "chunk", F.col("users").alias("a"), F.col("items").alias("b"), F.col("ratings").alias("c"))
                    met = held.unionByName(chunks).repartitionById(blocks, F.col("key").cast("int")).sortWithinPartitions("key", "kind", "chunk", F.xxhash64("a", "b", "c"))
                    factors, fresh = scratch.stored(met.mapInArrow(_round(width, stats["mean"] or 0.0, g("rate"), g("penalty"), (k, s)), _FACTORS))
                    scratch.remove(spark, path)
                    path = fresh
                    trash.append(path)
            each = factors.mapInArrow(_spread(width), "side int, block int, at int, vector array<double>")
            named = [stored(each.where(F.col("side") == side).join(table.withColumnRenamed(block, "block").withColumnRenamed(f"{key}_at", "at"), ["block", "at"]).select(F.col(key).alias("name"), "vector"), keep=True) for side, table, key, block in ((0, users, "user", "ublock"), (1, items, "item", "iblock"))]
        finally:
            for p in trash:
                scratch.remove(spark, p)
        return FactorizationModel(float(stats["mean"] or 0.0), *kept)._with(*named)


class FactorizationModel(Model):
    """Factor tables of users and items; a fitted model's stay in the shared folder, a saved one has its own."""

    mean = Param(Params._dummy(), "mean", "mean rating", TypeConverters.toFloat)
    users = Param(Params._dummy(), "users", "folder of the users' factors", TypeConverters.toString)
    items = Param(Params._dummy(), "items", "folder of the items' factors", TypeConverters.toString)

    def __init__(self, mean: float = 0.0, users: str = "", items: str = ""):
        super().__init__()
        self._set(mean=mean, users=users, items=items)

    def _with(self, users: DataFrame, items: DataFrame) -> FactorizationModel:
        self.tables = users, items
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        users, items = (t.select(F.col("name").alias(key), F.col("vector").alias(f"{key}_v")) for t, key in zip(self.tables, ("_user", "_item")))
        met = df.join(users, "_user", "left").join(items, "_item", "left")
        last = F.size("_user_v") - 1
        product = F.aggregate(F.zip_with(F.slice("_user_v", F.lit(1), last), F.slice("_item_v", F.lit(1), last), lambda a, b: a * b), F.lit(self.getOrDefault("mean")), lambda s, v: s + v)
        score = product + F.element_at("_user_v", -1) + F.element_at("_item_v", -1)
        return met.withColumn("prediction", F.when(F.col("_user_v").isNotNull() & F.col("_item_v").isNotNull(), score)).drop("_user_v", "_item_v")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def load(cls, path: str) -> FactorizationModel:
        return cls.read().load(path)


class _Writer(MLWriter):
    def __init__(self, model: FactorizationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for table, name in zip(self.model.tables, ("users", "items")):
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> FactorizationModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = FactorizationModel(found["paramMap"]["mean"], f"{path}/users", f"{path}/items")
        model._resetUid(found["uid"])
        return model._with(*(self.sparkSession.read.parquet(f"{path}/{name}") for name in ("users", "items")))
