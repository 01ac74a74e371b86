"""Stratified matrix factorisation: planted factors, held-out error, strata, kept models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.ml import training
from brindle.ml.factorization import FactorizationModel, StratifiedFactorization, descend
from brindle.ml.trainers import spec


@pytest.fixture(scope="module")
def ratings(spark):
    r = np.random.default_rng(4)
    users, items = r.normal(size=(80, 3)), r.normal(size=(40, 3))
    rows = [(f"u{u}", f"i{i}", float(3 + users[u] @ items[i] + 0.05 * r.normal())) for u in range(80) for i in range(40) if r.random() < 0.6]
    return spark.createDataFrame(rows, "user string, item string, Label double").withColumn("held", F.pmod(F.xxhash64("user", "item"), F.lit(5)) == 0).persist()


def _train(rows, **more):
    p = {"userColumn": "user", "itemColumn": "item", "approximationRank": 4, "numberOfIterations": 15, "learningRate": 0.2} | more
    return training.train(spec("algo.rec.matrixFactorization", **p), rows, "Label")


def _rmse(scored):
    return scored.agg(F.sqrt(F.avg(F.pow(F.col("Score") - F.col("Label"), 2)))).first()[0]


def test_held_out_error_is_below_the_item_mean_and_the_rate_matters(ratings, tmp_path):
    fit, held = ratings.where("not held").drop("held"), ratings.where("held").drop("held")
    means = fit.groupBy("item").agg(F.avg("Label").alias("Score"))
    base = _rmse(held.join(means, "item"))
    t = _train(fit)
    found = _rmse(training.score(t, held))
    assert found < 0.4 * base
    assert _rmse(training.score(_train(fit, learningRate=0.001, numberOfIterations=2), held)) > 2 * found
    stage = t.model.stages[-1]
    stage.write().overwrite().save(str(tmp_path / "m"))
    again = FactorizationModel.load(str(tmp_path / "m"))
    ready = held.select(F.col("user").alias("_user"), F.col("item").alias("_item"))
    a, b = (m.transform(ready).agg(F.sum("prediction")).first()[0] for m in (stage, again))
    assert np.isclose(a, b)


def test_unknown_users_and_gaps_have_no_score(spark, ratings):
    t = _train(ratings.drop("held").limit(300).unionByName(spark.createDataFrame([("u1", "i1", None)], "user string, item string, Label double")), numberOfIterations=1)
    rows = spark.createDataFrame([("nobody", "i1", 1.0), (None, None, 1.0)], "user string, item string, Label double")
    assert [r["Score"] for r in training.score(t, rows).collect()] == [None, None]


def test_blocks_of_the_grid_cover_all_ratings_once(spark, ratings):
    """With a rate of 0 nothing moves; with any number of blocks every user and item has a vector."""
    ready = ratings.select(F.col("user").alias("_user"), F.col("item").alias("_item"), F.col("Label").alias("label"))
    model = StratifiedFactorization(rank=2, passes=1, rate=0.0, blocks=3).fit(ready)
    users, items = model.tables
    assert users.count() == ready.select("_user").distinct().count() and items.count() == ready.select("_item").distinct().count()
    assert model.transform(ready).where("prediction is null").count() == 0


def test_a_pass_lowers_the_squared_error_with_hot_rows():
    r = np.random.default_rng(0)
    u, i = np.zeros(3_000, np.int32), r.integers(0, 4, 3_000).astype(np.int32)
    y = np.array([1.0, -2.0, 3.0, 0.5])[i] + 0.1 * r.normal(size=3_000)
    users, items = np.zeros((1, 5)), np.zeros((4, 5))
    users[:, :2], items[:, :2] = 0.1, 0.1
    for _ in range(20):
        descend(users, items, (u, i, y), 0.0, 0.1, 0.0, r.permutation(3_000))
    p = users[0, 2] + items[i, 2] + items[i, :2] @ users[0, :2]
    assert ((p - y) ** 2).mean() < 0.05
